"""Reading obfuscated script text: encodings on the JVM side, variable renaming as one Arrow-batched function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions import hexbin, urls
from caseloom.functions.core import col

# Names that keep their meaning and are never renamed.
AUTOMATIC_VARIABLES = {
    "_", "true", "false", "null", "args", "input", "this", "pscmdlet", "psboundparameters", "matches", "error",
    "host", "home", "pwd", "pid", "profile", "psscriptroot", "pscommandpath", "env", "foreach", "switch",
    "lastexitcode", "stacktrace", "ofs", "shellid", "executioncontext", "myinvocation", "nestedpromptlevel",
    "consolefilename", "eventargs", "event", "eventsubscriber", "sender", "psversiontable", "allnodes", "global",
    "script", "local", "private", "using", "variable", "workflow",
}
VARIABLE = re.compile(r"\$(\{[^}]+\}|[A-Za-z_][A-Za-z0-9_]*)")

NORMALISED = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("legend", T.ArrayType(T.StructType([
        T.StructField("alias", T.StringType()), T.StructField("original", T.StringType()),
    ]))),
])


def rename_variables(code: str) -> tuple[str, list[dict[str, str]]]:
    """User variables become ``$Value_n`` in first-seen order, ignoring case; returns the text and its legend."""
    # lower-case name -> (number, name as first written)
    spelled: dict[str, tuple[int, str]] = {}

    def swap(found: re.Match[str]) -> str:
        name = found.group(1).strip("{}") if found.group(1).startswith("{") else found.group(1)
        folded = name.lower()
        if folded in AUTOMATIC_VARIABLES:
            return found.group(0)
        return f"$Value_{spelled.setdefault(folded, (len(spelled) + 1, name))[0]}"

    renamed = VARIABLE.sub(swap, code)
    return renamed, [{"alias": f"$Value_{i}", "original": f"${name}"} for i, name in spelled.values()]


@F.pandas_udf(NORMALISED)
def normalise_variables(code: pd.Series) -> pd.DataFrame:
    done = [rename_variables(text or "") for text in code]
    return pd.DataFrame({"code": [d[0] for d in done], "legend": [d[1] for d in done]})


def _replacements(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit("�"), F.lit("")))


def decode_base64(selection: Column | str) -> Column:
    """Base64 as UTF-16LE or UTF-8, whichever has fewer replacement characters (a tie goes to UTF-16LE).

    A byte left over at the end is half a UTF-16 character and counts as one replacement.
    """
    cleaned = F.regexp_replace(col(selection), "[^A-Za-z0-9+/=]", "")
    raw = F.try_to_binary(F.when(F.length(cleaned) >= 4, cleaned), F.lit("base64"))
    half = F.when(F.octet_length(raw) % 2 == 1, F.lit("\ufffd")).otherwise("")
    wide = F.concat(hexbin.utf16_text(F.lower(F.hex(raw))), half)
    narrow = F.make_valid_utf8(raw.cast("string"))
    use_wide = (F.length(wide) > 0) & (_replacements(wide) <= _replacements(narrow))
    return F.struct(
        F.when(use_wide, "UTF-16LE").otherwise("UTF-8").alias("encoding"),
        F.octet_length(raw).alias("bytes"),
        F.when(use_wide, wide).otherwise(narrow).alias("output"),
    )


def decode_url_text(selection: Column | str) -> Column:
    return urls.url_decode(F.replace(F.trim(col(selection)), F.lit("+"), F.lit("%20")))


def decode_numbers(selection: Column | str) -> Column:
    """Numbers from 0 to 255 as text: UTF-8 when valid, else one character per number."""
    numbers = F.filter(
        F.transform(F.regexp_extract_all(col(selection), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("bigint")),
        lambda n: n.between(0, 255),
    )
    raw = F.unhex(F.array_join(F.transform(numbers, lambda n: F.lpad(F.hex(n), 2, "0")), ""))
    valid = F.is_valid_utf8(raw.cast("string"))
    latin = F.array_join(F.transform(numbers, lambda n: F.char(n)), "")
    return F.struct(
        F.when(valid, "UTF-8").otherwise("Latin1").alias("encoding"),
        F.size(numbers).alias("bytes"),
        F.when(valid, raw.cast("string")).otherwise(latin).alias("output"),
    )
