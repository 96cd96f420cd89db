"""Names, paths, addresses and line handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions.core import blank_to_null, col, text


def last_segment(path: Column | str) -> Column:
    """Last segment after a backslash or a slash."""
    return F.regexp_extract(col(path), r"([^\\/]*)$", 1)


def trimmed_basename(path: Column | str) -> Column:
    """Last segment with trailing separators ignored; the path itself when nothing is left."""
    clean = F.regexp_replace(col(path), r"[\\/]+$", "")
    return F.coalesce(blank_to_null(last_segment(clean)), col(path))


def bare_account(name: Column | str) -> Column:
    """User name without a domain prefix or a principal suffix."""
    return blank_to_null(F.trim(F.regexp_extract(last_segment(name), r"^([^@]*)", 1)))


def normalised_account(name: Column | str) -> Column:
    return F.lower(bare_account(F.trim(col(name))))


def exe_from_host(host: Column | str) -> Column:
    """Executable name of a command line: the quoted or the first token."""
    h = F.trim(col(host))
    quoted = F.regexp_extract(h, r'^"([^"]*)', 1)
    token = F.regexp_extract(h, r"^([^ ]*)", 1)
    path = F.when(h.startswith('"'), quoted).otherwise(token)
    return F.coalesce(blank_to_null(last_segment(path)), blank_to_null(path))


def first_line(value: Column | str, limit: int | None = None) -> Column:
    """First non-blank trimmed line, cut to ``limit`` characters if that is given."""
    lines = F.transform(F.split(col(value), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    first = F.get(F.filter(lines, lambda x: x != ""), F.lit(0))
    return blank_to_null(first if limit is None else F.left(first, F.lit(limit)))


def labelled_value(context: Column | str, tokens: list[str]) -> Column:
    """Value of the first ``label = value`` line whose label contains a token."""
    lines = F.split(col(context), r"\r?\n")

    def label_hit(line: Column) -> Column:
        label = F.regexp_extract(line, r"^([^=]*)=", 1)
        hit = F.lit(False)
        for token in tokens:
            hit = hit | label.contains(token)
        return line.contains("=") & hit

    line = F.get(F.filter(lines, label_hit), F.lit(0))
    return blank_to_null(F.trim(F.regexp_extract(line, r"^[^=]*=(.*)$", 1)))


def after_token(blob: Column | str, prefix: str) -> Column:
    """Text after the first occurrence of a prefix, to the end of its line."""
    value = col(blob)
    at = F.locate(prefix, value)
    rest = F.substr(value, at + F.lit(len(prefix)))
    line = F.regexp_replace(F.substring_index(rest, "\n", 1), r"\r+$", "")
    return F.when(at > 0, blank_to_null(F.trim(line)))


def volume_relative(path: Column | str) -> Column:
    """Lower case, backslashes, no drive letter; network paths stay."""
    low = F.replace(F.lower(col(path)), F.lit("/"), F.lit("\\"))
    rest = F.substr(low, F.lit(3))
    rooted = F.when(rest.startswith("\\"), rest).otherwise(F.concat(F.lit("\\"), rest))
    return F.when(low.rlike("^[a-z]:"), rooted).otherwise(low)


def segment_after(path: Column | str, folder_pattern: str) -> Column:
    """Path segment right after the first folder that matches, NULL when there is none."""
    return blank_to_null(F.regexp_extract(col(path), r"(?i)(?:^|[\\/])(?:" + folder_pattern + r")[\\/]([^\\/]*)", 1))


def parent_folder(path: Column | str) -> Column:
    return blank_to_null(F.regexp_extract(col(path), r"([^\\/]+)[\\/][^\\/]*$", 1))


def browser_account(path: Column | str, fallback: str | None = "browser") -> Column:
    found = F.coalesce(segment_after(path, "BROWSER"), parent_folder(path))
    return F.coalesce(found, F.lit(fallback)) if fallback is not None else found


def bitmap_account(path: Column | str) -> Column:
    """Segment after the collection folder, else the folder above ``Cache``, else ``unknown``."""
    direct = F.trim(F.regexp_extract(col(path), r"(?i)(?:^|[\\/])RDP_CACHE[\\/]([^\\/]+)", 1))
    usable = F.when((direct != "") & (F.lower(direct) != "cache"), direct)
    above = blank_to_null(F.trim(F.regexp_extract(col(path), r"(?i)([^\\/]+)[\\/]Cache(?:[\\/]|$)", 1)))
    return F.coalesce(usable, above, F.lit("unknown"))


def link_account(path: Column | str) -> Column:
    return segment_after(path, "LNK|JUMPLIST")


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(last_segment(path), r"\.[^.]*$", "")


def account_from_stem(stem: Column | str, suffix: str) -> Column:
    return F.regexp_replace(col(stem), suffix + "$", "")


def rot13(value: Column | str) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = upper.lower()
    turned = upper[13:] + upper[:13] + lower[13:] + lower[:13]
    return F.translate(col(value), upper + lower, turned)


def human_bytes(value: Column | str) -> Column:
    """Bytes with a binary unit: whole bytes, else one decimal, ties to even."""
    n = F.trim(col(value)).try_cast("bigint")
    size = n.cast("double")
    steps = [(1024.0**2, 1024.0, "KB"), (1024.0**3, 1024.0**2, "MB"), (1024.0**4, 1024.0**3, "GB")]
    shown = F.when(n < 0, F.lit(None).cast("string")).when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for below, unit, name in steps:
        shown = shown.when(size < below, F.format_string(f"%.1f {name}", F.bround(size / unit, 1)))
    return shown.otherwise(F.when(n.isNotNull(), F.format_string("%.1f TB", F.bround(size / 1024.0**4, 1))))


def listing_size(value: Column | str) -> Column:
    """Sizes of the file listing: blank at zero, two decimals from gigabytes on, ties up."""
    n = F.trim(col(value)).try_cast("double")
    return (
        F.when(~(n > 0), F.lit(None).cast("string"))
        .when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
        .when(n < 1024.0**2, F.format_string("%.1f KB", n / 1024.0))
        .when(n < 1024.0**3, F.format_string("%.1f MB", n / 1024.0**2))
        .otherwise(F.when(n.isNotNull(), F.format_string("%.2f GB", n / 1024.0**3)))
    )


def address_list(value: Column | str) -> Column:
    """JSON list of addresses as joined text without blanks and 0.0.0.0; other text stays."""
    s = F.trim(col(value))
    parsed = F.from_json(s, "array<string>")
    kept = F.array_join(F.filter(parsed, lambda x: (x != "") & (x != "0.0.0.0")), ", ")
    listed = F.when(parsed.isNull(), s).otherwise(kept)
    return blank_to_null(F.when(s.startswith("["), listed).otherwise(F.when(s != "0.0.0.0", s)))


def snake_case(name: Column | str) -> Column:
    split_acronym = F.regexp_replace(col(name), r"([A-Z])([A-Z][a-z])", "$1_$2")
    split_word = F.regexp_replace(split_acronym, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.replace(split_word, F.lit("-"), F.lit("_")))


# Spellings of yes and no found in the evidence.
TRUE_WORDS = ("1", "true", "yes", "enabled", "사용", "예")
FALSE_WORDS = ("0", "false", "no", "disabled", "미사용", "아니오")


def truth_value(value: Column | str) -> Column:
    word = F.lower(F.trim(col(value)))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def contains_folded(value: Column | str, needle: str) -> Column:
    """Case-insensitive substring test; nothing in the needle is a wildcard."""
    return F.lower(text(value)).contains(needle.lower())
