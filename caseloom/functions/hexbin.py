"""Fixed-offset reads on lower-case hex text. Hex pairs are reordered as text; bytes are never reversed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions import times
from caseloom.functions.core import blank_to_null, col

# Account control bits.
ACCOUNT_FLAGS = [
    (0x0001, "Disabled"), (0x0002, "HomeDirRequired"), (0x0004, "PwNotRequired"), (0x0008, "TempDuplicate"),
    (0x0010, "Normal"), (0x0020, "MNSLogon"), (0x0040, "DomainTrust"), (0x0080, "WorkstationTrust"),
    (0x0100, "ServerTrust"), (0x0200, "PwNoExpire"), (0x0400, "AutoLocked"),
]


def clean_hex(value: Column | str) -> Column:
    """Trimmed hex text, empty when its length is odd or a digit is bad."""
    h = F.trim(F.coalesce(col(value), F.lit("")))
    return F.when(h.rlike("^([0-9A-Fa-f]{2})*$"), F.lower(h)).otherwise(F.lit(""))


def byte_length(hex_text: Column) -> Column:
    return F.call_function("div", F.length(hex_text), F.lit(2))


def le_uint(hex_text: Column, offset: int, width: int) -> Column:
    """Little-endian unsigned number, 0 past the end. Eight-byte values beyond the signed range are NULL."""
    pairs = [F.substring(hex_text, 2 * (offset + i) + 1, 2) for i in reversed(range(width))]
    number = F.conv(F.concat(*pairs), 16, 10).try_cast("bigint")
    return F.when(F.length(hex_text) >= 2 * (offset + width), number).otherwise(F.lit(0).cast("bigint"))


def le_uint_at(hex_text: Column, offset: Column, width: int) -> Column:
    pairs = [F.substr(hex_text, (offset + i) * 2 + 1, F.lit(2)) for i in reversed(range(width))]
    number = F.conv(F.concat(*pairs), 16, 10).try_cast("bigint")
    return F.when(F.length(hex_text) >= (offset + width) * 2, number).otherwise(F.lit(0).cast("bigint"))


def filetime_at(hex_text: Column, offset: int) -> Column:
    return times.filetime(le_uint(hex_text, offset, 8))


def filetime_hex(value: Column | str) -> Column:
    h = clean_hex(value)
    return F.when(F.length(h) >= 16, filetime_at(h, 0))


def systemtime_hex(value: Column | str) -> Column:
    """Sixteen-byte calendar record: no zone, no milliseconds, blank for year 0."""
    h = clean_hex(value)
    year, month, day, hour, minute, second = [le_uint(h, at, 2) for at in (0, 2, 6, 8, 10, 12)]
    shown = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, month, day, hour, minute, second)
    return F.when((F.length(h) >= 32) & (year != 0), shown)


def utf16_text(hex_text: Column) -> Column:
    """UTF-16LE hex to text; unpaired surrogates become the replacement character."""
    units = F.regexp_replace(F.substr(hex_text, F.lit(1), F.call_function("div", F.length(hex_text), F.lit(4)) * 4), "(.{4})", "$1 ")
    high = r"[0-9a-f]{2}d[89ab] "
    low = r"[0-9a-f]{2}d[c-f] "
    fixed = F.regexp_replace(units, f"{high}(?!{low})", "fdff ")
    fixed = F.regexp_replace(fixed, f"(?<!{high}){low}", "fdff ")
    return F.decode(F.unhex(F.replace(fixed, F.lit(" "), F.lit(""))), "UTF-16LE")


def flag_names(mask: Column, table: list[tuple[int, str]], separator: str) -> Column:
    """Names of the set bits in table order."""
    entries = F.array(*[F.struct(F.lit(bit).cast("bigint").alias("bit"), F.lit(name).alias("name")) for bit, name in table])
    hit = F.filter(entries, lambda e: mask.bitwiseAND(e["bit"]) != 0)
    return F.array_join(F.transform(hit, lambda e: e["name"]), separator)


def account_record(h: Column) -> Column:
    """Fixed-offset account record of clean hex as a struct, NULL when it is too short."""
    acb = le_uint(h, 0x38, 2)
    record = F.struct(
        le_uint(h, 0x30, 4).cast("string").alias("rid"),
        filetime_at(h, 0x08).alias("last_login"),
        filetime_at(h, 0x18).alias("password_last_set"),
        filetime_at(h, 0x28).alias("last_failed_login"),
        le_uint(h, 0x42, 2).cast("string").alias("login_count"),
        le_uint(h, 0x40, 2).cast("string").alias("failed_login_count"),
        F.when(acb.bitwiseAND(F.lit(1).cast("bigint")) != 0, "yes").otherwise("no").alias("disabled"),
        blank_to_null(flag_names(acb, ACCOUNT_FLAGS, ", ")).alias("account_flags"),
    )
    return F.when(F.length(h) >= 2 * 0x44, record)


def account_names(h: Column) -> Column:
    """User name and full name: offset and length pairs into the text area that starts at 0xCC."""

    def field(index: int) -> Column:
        start = le_uint(h, index * 12, 4) + F.lit(0xCC)
        length = le_uint(h, index * 12 + 4, 4)
        raw = F.substr(h, start * 2 + 1, length * 2)
        return F.when((F.length(h) >= 2 * 0xCC) & (start * 2 < F.length(h)), blank_to_null(utf16_text(raw)))

    return F.struct(field(1).alias("username"), field(2).alias("full_name"))


def sid_text(value: Column | str) -> Column:
    """Binary security identifier to text; data shorter than its header stays hex."""
    h = clean_hex(value)
    count = le_uint(h, 1, 1)
    available = F.call_function("div", byte_length(h) - 8, F.lit(4))
    used = F.least(count, available)
    authority = F.conv(F.substring(h, 5, 12), 16, 10)
    parts = F.transform(
        F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(255).cast("bigint")), lambda i: i < used),
        lambda i: le_uint_at(h, i * 4 + 8, 4).cast("string"),
    )
    head = F.array(F.lit("S"), le_uint(h, 0, 1).cast("string"), authority)
    return F.when(F.length(h) < 16, h).otherwise(F.array_join(F.concat(head, parts), "-"))


def id_blob_text(value: Column | str) -> Column:
    """UTF-16LE blob without trailing NUL characters."""
    return F.regexp_replace(utf16_text(clean_hex(value)), "\u0000+$", "")
