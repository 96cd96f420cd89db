"""References to files from other evidence, and the file listing that shows them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions import hexbin
from caseloom.functions import text as tx
from caseloom.functions.core import text
from caseloom.operators import trees
from caseloom.plans.common import HOST, union_all

# Shell item kinds, extension block mark, name offsets by block version.
EXTENSION_MARK = bytes.fromhex("0400efbe")
NAME_OFFSETS = [(9, 46), (8, 42), (0, 34)]
SHORT_NAME_OFFSET = 14
LINK_FIELDS = [
    "target_path", "app_id", "jumplist_type", "arguments", "working_directory", "machine_id", "timestamp",
    "created_time", "modified_time", "_source_file",
]

ITEM = T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType())])


def _zero_ended(raw: bytes, at: int) -> str:
    return raw[at:].split(b"\0", 1)[0].decode("utf-8", "replace").strip()


def _wide_zero_ended(raw: bytes, at: int) -> str:
    wide = raw[at:at + (len(raw) - at) // 2 * 2].decode("utf-16-le", "replace")
    return wide.split("\0", 1)[0]


def _longest_wide_run(raw: bytes) -> str:
    """Longest run of printable UTF-16 units; the first of equal length."""
    units = [int.from_bytes(raw[i:i + 2], "little") for i in range(0, len(raw) - 1, 2)]
    kept = "".join(chr(u) if 0x20 <= u <= 0xD7FF or 0xE000 <= u <= 0xFFFD else "\0" for u in units)
    return max(kept.split("\0"), key=len).strip() if kept else ""


def shell_item(raw: bytes) -> tuple[str, str | None]:
    """Kind and name of one shell item: root, volume, folder or unknown."""
    if len(raw) < 3:
        return "unknown", None
    family = raw[2] & 0x70
    if family == 0x10:
        return "root", None
    if family == 0x20:
        drive = _zero_ended(raw, 3).rstrip("\\")
        return ("volume", drive) if drive else ("unknown", None)
    if family != 0x30:
        return "unknown", None
    name = ""
    mark = raw.find(EXTENSION_MARK)
    if mark >= 4:
        block = mark - 4
        version = int.from_bytes(raw[block + 2:block + 4], "little")
        at = block + next(offset for least, offset in NAME_OFFSETS if version >= least)
        if at < len(raw) and 0x20 <= int.from_bytes(raw[at:at + 2], "little") <= 0xFFFD:
            name = _wide_zero_ended(raw, at).strip()
    if not name:
        run = _longest_wide_run(raw)
        name = run if len(run.encode("utf-8")) >= 2 else _zero_ended(raw, SHORT_NAME_OFFSET)
    return ("folder", name) if name else ("unknown", None)


@F.pandas_udf(ITEM)
def shell_items(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([shell_item(bytes(r) if r is not None else b"") for r in raw], columns=["kind", "name"])


def shellbag_folders(registry: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Folders browsed in the shell: each numbered value names a child of its key; names are joined up to the root.

    Key paths of different users can be equal, so the hive is part of the key.
    """
    keys = keys or [*HOST, "hive"]
    rows = registry.filter(
        F.lower("key_path").contains("bagmru") & F.col("value_name").rlike("^[0-9]") & (hexbin.clean_hex("value_data") != "")
    )
    items = rows.select(
        *keys, "hive", F.lower(F.concat_ws("\\", "key_path", "value_name")).alias("node"), F.lower("key_path").alias("parent"),
        F.col("_rowid"), F.unhex(hexbin.clean_hex("value_data")).alias("raw"),
    ) if "hive" not in keys else rows.select(
        *keys, F.lower(F.concat_ws("\\", "key_path", "value_name")).alias("node"), F.lower("key_path").alias("parent"),
        F.col("_rowid"), F.unhex(hexbin.clean_hex("value_data")).alias("raw"),
    )
    last = items.groupBy(*keys, "node", "parent").agg(F.max_by("raw", "_rowid").alias("raw"))
    named = last.select(*keys, "node", "parent", F.array(shell_items("raw")).alias("names"))
    chains = trees.climb(named, keys)
    chain = chains.withColumn("_c", F.col("names"))
    pick = lambda kind: F.transform(F.filter("_c", lambda n: n["kind"] == kind), lambda n: n["name"])
    parts = chain.withColumn("_dirs", pick("folder")).withColumn("_drive", F.get(F.reverse(pick("volume")), F.lit(0))).filter(F.size("_dirs") > 0)
    relative = F.concat(F.lit("\\"), F.array_join("_dirs", "\\"))
    shown = parts.select(*keys, F.lower(relative).alias("path"), F.concat(text("_drive"), relative).alias("display"), "node")
    account = F.substring_index("hive", "_", 1)
    host = [k for k in keys if k != "hive"]
    return shown.withColumn("account", account).groupBy(*host, "path", "account").agg(F.min_by("display", "node").alias("display"))


def link_references(links: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """Link targets as volume-relative paths with their account and the fields that have a value."""
    rows = links.filter(text("target_path") != "")
    fields = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(c) for c in LINK_FIELDS]), F.array(*[F.col(c) for c in LINK_FIELDS])),
        lambda _, v: v.isNotNull() & (v != ""),
    )
    return rows.select(
        *keys, tx.volume_relative("target_path").alias("path"), F.lit("Jumplist").alias("kind"),
        text(tx.link_account("_source_file")).alias("account"), F.col("target_path").alias("label"), fields.alias("fields"),
        F.lit("JumpList_Entries").alias("table_name"), F.col("_rowid").alias("rowid"),
    )


def path_references(links: DataFrame, registry: DataFrame | None, keys: list[str] = HOST) -> DataFrame:
    branches = [link_references(links, keys)]
    if registry is not None:
        bags = shellbag_folders(registry, [*keys, "hive"])
        branches.append(bags.select(
            *keys, "path", F.lit("Shellbag").alias("kind"), "account", F.col("display").alias("label"),
            F.create_map(F.lit("path"), F.col("display"), F.lit("account"), F.col("account")).alias("fields"),
            F.lit("").alias("table_name"), F.lit(-1).cast("bigint").alias("rowid"),
        ))
    return union_all(branches)


def file_tags(files: DataFrame, references: DataFrame, accounts: tuple[str, ...] | None = None, keys: list[str] = HOST) -> DataFrame:
    """(file, account, kind) for files that other evidence mentions; references are distinct before they meet the files."""
    refs = references.filter(F.col("account").isin(*accounts)) if accounts is not None else references
    distinct = refs.select(*keys, "path", "account", "kind").distinct()
    listed = files.select(*keys, "entry", F.lower("path").alias("path")).filter(text("path") != "")
    return listed.join(distinct, [*keys, "path"])


def children(files: DataFrame, parent_entry: int) -> DataFrame:
    """Entries of a folder: folders first, then by name; the folder itself is not listed."""
    here = files.filter((F.col("parent_entry") == parent_entry) & (F.col("entry") != parent_entry))
    return here.orderBy(F.desc("is_directory"), F.lower("file_name"))


def search_files(files: DataFrame, query: str, limit: int) -> DataFrame:
    """Files whose name or path contains the text: folders first, by path."""
    low = query.lower()
    hit = F.lower(text("file_name")).contains(low) | F.lower(text("path")).contains(low)
    return files.filter(hit).orderBy(F.desc("is_directory"), F.lower("path"), "entry").limit(limit)
