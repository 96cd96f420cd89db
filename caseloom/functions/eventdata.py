"""Event payload access: one JSON parse per row, only the wanted fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions.core import blank_to_null, col


def payload(raw: Column | str, fields: list[str], nested: dict[str, list[str]] | None = None) -> Column:
    """Struct of text fields (scalars to text, objects to JSON text) plus nested objects; all NULL on bad input."""
    parts = [f"`{name}` string" for name in fields]
    for name, inner in (nested or {}).items():
        parts.append(f"`{name}` struct<{', '.join(f'`{n}`: string' for n in inner)}>")
    return F.from_json(col(raw), ", ".join(parts))


def field(parsed: Column, *names: str, under: str | None = None) -> Column:
    """First non-empty of the names, a nested object first when one is given."""
    places = [parsed[under], parsed] if under else [parsed]
    return F.coalesce(*[blank_to_null(place[name]) for place in places for name in names])


def nested_first(parsed: Column, under: str, name: str) -> Column:
    """The nested object replaces the outer one when it is present."""
    return F.when(parsed[under].isNotNull(), blank_to_null(parsed[under][name])).otherwise(blank_to_null(parsed[name]))


#: Objects inside each other that are opened in place; deeper payloads go through the table function of ``operators.payloads``.
LEVELS = 4
LEAF = "struct<path:string,field:string,value:string>"


def leaf_text(value: Column) -> Column:
    """Text of a payload value that is no object; the elements of an array are joined with commas, nulls left out."""
    items = F.try_variant_get(value, "$", "array<string>")
    joined = F.array_join(F.filter(items, lambda x: x.isNotNull()), ", ")
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), joined).otherwise(F.try_variant_get(value, "$", "string"))


def deeply_nested(raw: Column | str) -> Column:
    """Whether objects are nested in each other more than ``LEVELS`` deep. Most payloads are settled by counting braces."""
    raw = col(raw)
    braces = F.length(raw) - F.length(F.replace(raw, F.lit("{")))
    # possessive, so that long texts neither backtrack nor need a deep stack
    left = F.regexp_replace(raw, r'"(?:[^"\\]++|\\.)*+"|[^{}"]++|"', "")
    for _ in range(LEVELS):
        left = F.replace(left, F.lit("{}"), F.lit(""))
    return F.coalesce(F.when(braces > LEVELS, F.contains(left, F.lit("{"))), F.lit(False))


def flattened(raw: Column | str) -> Column:
    """Array of (path, field, value) for every leaf of a payload that is not deeply nested; arrays are joined with commas.

    An object below ``LEVELS`` levels would stay JSON text here; ``payloads.with_leaves`` opens all of them.
    """
    variant_map = "map<string,variant>"

    def entries(prefix: Column | None, value: Column) -> Column:
        pairs = F.map_entries(value)
        return F.transform(
            pairs,
            lambda e: F.struct(
                (F.concat(prefix, F.lit("."), e["key"]) if prefix is not None else e["key"]).alias("path"),
                e["key"].alias("field"),
                e["value"].alias("value"),
            ),
        )

    level = entries(None, F.try_variant_get(F.try_parse_json(col(raw)), "$", variant_map))
    is_object = lambda e: F.schema_of_variant(e["value"]).startswith("OBJECT")

    def opened(entries_: Column) -> Column:
        return F.flatten(F.transform(
            entries_, lambda e: F.when(is_object(e), entries(e["path"], F.try_variant_get(e["value"], "$", variant_map))).otherwise(F.array(e))))

    for _ in range(LEVELS - 1):
        level = opened(level)
    leaves = F.transform(
        level, lambda e: F.struct(e["path"].alias("path"), e["field"].alias("field"), leaf_text(e["value"]).alias("value"))
    )
    return F.filter(leaves, lambda e: e["value"].isNotNull())


# Level numbers and logon types.
LEVEL_NAMES = {"0": "Information", "4": "Information", "1": "Critical", "2": "Error", "3": "Warning", "5": "Verbose"}
LOGON_TYPES = {
    "2": "interactive", "3": "network", "4": "batch", "5": "service", "7": "unlock",
    "8": "network cleartext", "9": "new credentials", "10": "remote desktop", "11": "cached credentials",
}
QUICK_FIELDS = [
    "LogonType", "TargetUserName", "TargetDomainName", "IpAddress",
    "WorkstationName", "ShareName", "ServiceName", "TaskName",
]


def level_name(level: Column | str) -> Column:
    value = col(level)
    return (
        F.when(value.isin("0", "4"), "Information").when(value == "1", "Critical").when(value == "2", "Error")
        .when(value == "3", "Warning").when(value == "5", "Verbose").otherwise(value)
    )


def quick_fields(raw: Column | str) -> list[Column]:
    """The payload fields an analyst sorts by, each as its own column; logon types get their name."""
    parsed = payload(raw, QUICK_FIELDS)
    columns = []
    for name in QUICK_FIELDS:
        value = blank_to_null(parsed[name])
        if name == "LogonType":
            label = F.when(F.lit(False), F.lit(""))
            for code, word in LOGON_TYPES.items():
                label = label.when(value == code, word)
            value = F.coalesce(label, value)
        columns.append(value.alias(f"ed_{name}"))
    return columns
