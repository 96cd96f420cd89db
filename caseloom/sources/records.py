"""Numeric and key-value records: application inventory, file system, journal, resource usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import hexbin, times
from caseloom.functions.core import blank_to_null
from caseloom.functions.lookups import FILE_ATTRIBUTES, JOURNAL_REASONS
from caseloom.functions.text import snake_case
from caseloom.operators import trees

# Legacy numeric value names of the program inventory.
LEGACY_PROGRAM_NAMES = {"0": "Name", "1": "Version", "2": "Publisher", "3": "Language"}


def _after_root(key_path: Column | str) -> Column:
    return F.split(F.regexp_extract(F.col(key_path), r"(?i)\\root\\(.*)$", 1), r"\\")


def inventory_records(registry: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Program and file records of the application inventory: the values of one key become one map per key.

    Values of one key are few; the hive as a whole is spread by key.
    """
    rows = registry.withColumn("_seg", _after_root("key_path"))
    group, parts = F.get("_seg", F.lit(0)), F.size("_seg")
    modern_program, legacy_program = (parts == 2) & (group == "InventoryApplication"), (parts == 2) & (group == "Programs")
    modern_file, legacy_file = (parts == 2) & (group == "InventoryApplicationFile"), (parts == 3) & (group == "File")
    legacy_name = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in LEGACY_PROGRAM_NAMES.items() for x in kv]), F.col("value_name")),
        F.col("value_name"),
    )
    named = rows.filter(modern_program | legacy_program | modern_file | legacy_file).withColumn(
        "_kind", F.when(modern_program | legacy_program, "program").otherwise("file")
    ).withColumn(
        "_name", F.when(legacy_program, legacy_name).when(F.col("_kind") == "file", snake_case("value_name")).otherwise(F.col("value_name"))
    )
    # The last value of a name wins; one entry per name makes the map unambiguous.
    per_name = named.groupBy(*keys, "_kind", "key_path", "_name").agg(
        F.max_by("value_data", "_rowid").alias("v"), F.max("last_write").alias("w"), F.max("_recovery").alias("r")
    )
    records = per_name.groupBy(*keys, "_kind", "key_path").agg(
        F.map_from_entries(F.collect_list(F.struct("_name", "v"))).alias("fields"),
        F.max("w").alias("timestamp"), F.max("r").alias("_recovery"),
    )
    programs = records.filter(F.col("_kind") == "program").drop("_kind")
    get = lambda name: F.try_element_at("fields", F.lit(name))
    strip = lambda c: F.when(F.length(c) > 4, F.substr(c, F.lit(5))).otherwise(c)
    file_id = F.when((get("file_id") != "0") & (F.length(get("file_id")) > 4), F.substr(get("file_id"), F.lit(5))).otherwise(get("file_id"))
    own_sha = F.when(
        (F.length(get("sha1")) > 4) & ~get("sha1").eqNullSafe(file_id), F.substr(get("sha1"), F.lit(5))
    ).otherwise(get("sha1"))
    derived = F.when((get("file_id") != "0") & (F.length(get("file_id")) > 4), file_id)
    size = F.regexp_replace(get("size"), "^(0x)+", "")
    decimal = F.when(size.rlike("^[0-9A-Fa-f]{1,15}$"), F.conv(size, 16, 10)).otherwise(get("size"))
    files = records.filter(F.col("_kind") == "file").select(
        *keys, "key_path", "timestamp", "_recovery", "fields",
        *[blank_to_null(get(n)).alias(n) for n in ("name", "publisher", "lower_case_long_path", "original_file_name", "product_name", "version", "link_date")],
        blank_to_null(decimal).alias("size"),
        blank_to_null(F.coalesce(own_sha, derived)).alias("SHA1"),
        blank_to_null(strip(get("program_id"))).alias("program_id"),
        blank_to_null(file_id).alias("file_id"),
    )
    return programs, files


# Fixed value: the root folder's record number.
ROOT_ENTRY = 5


def file_records(attributes: DataFrame, keys: list[str]) -> DataFrame:
    """One record per entry from its attribute rows: best file name, size, extension.

    ``attributes``: keys, entry, flags, attr_seq, kind ('name', 'data', 'info'), namespace, name, parent, size.
    """
    priority = (
        F.when(F.col("namespace").isin("Win32", "Win32AndDos"), 3).when(F.col("namespace") == "POSIX", 2).when(F.col("namespace") == "DOS", 1)
    )
    is_name, is_data = F.col("kind") == "name", (F.col("kind") == "data") & (F.coalesce("name", F.lit("")) == "")
    grouped = attributes.groupBy(*keys, "entry").agg(
        F.max("flags").alias("flags"),
        F.max_by(F.struct("name", "parent", "size"), F.when(is_name, F.struct(priority, -F.col("attr_seq")))).alias("best"),
        F.max_by("size", F.when(is_data, F.col("attr_seq"))).alias("data_size"),
        F.count_if(F.col("kind") == "info").alias("infos"),
    )
    is_dir = F.col("flags").bitwiseAND(F.lit(2)) != 0
    name = F.coalesce("best.name", F.lit(""))
    dot = F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1
    extension = F.when(~is_dir & (dot > 0), F.lower(F.substring_index(name, ".", -1)))
    return grouped.filter(F.col("best").isNotNull() | (F.col("infos") > 0)).select(
        *keys, "entry",
        name.alias("file_name"),
        F.coalesce("best.parent", F.lit(-1)).alias("parent_entry"),
        blank_to_null(extension).alias("extension"),
        F.when(is_dir, "Y").otherwise("N").alias("is_directory"),
        F.when(F.col("flags").bitwiseAND(F.lit(1)) != 0, "Y").otherwise("N").alias("in_use"),
        F.when(is_dir, F.lit(0)).otherwise(F.coalesce("data_size", "best.size", F.lit(0))).cast("bigint").alias("file_size"),
    )


def with_paths(records: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``path``. Only records that are somebody's parent take part in the climb; the rest needs one join.

    Missing, self-referencing and cyclic parents resolve to ``\\$Orphan``.
    """
    orphan = "\\$Orphan"
    index = records.filter(F.col("parent_entry") >= 0).select(*keys, F.col("entry").alias("node"), F.col("file_name"), F.col("parent_entry").alias("parent"))
    parents = records.select(*keys, F.col("parent_entry").alias("node")).distinct()
    folders = index.join(parents, [*keys, "node"], "left_semi").filter(F.col("node") != ROOT_ENTRY)
    # A record that names itself as parent ends the chain as an orphan.
    folders = folders.select(
        *keys, "node", F.array("file_name").alias("names"),
        F.when(F.col("parent") == F.col("node"), F.lit(-2)).otherwise(F.col("parent")).alias("parent"),
    )
    climbed = trees.climb(folders, keys)
    base = F.when(F.col("top") == ROOT_ENTRY, "").otherwise(orphan)
    resolved = climbed.select(
        *keys, F.col("node").alias("parent_entry"),
        F.when(F.col("names").isNull(), orphan).otherwise(F.concat(base, trees.path_text(F.col("names")))).alias("_parent_path"),
    )
    joined = records.join(resolved, [*keys, "parent_entry"], "left")
    parent_path = F.when(F.col("parent_entry") == ROOT_ENTRY, "").otherwise(F.coalesce("_parent_path", F.lit(orphan)))
    own = F.when(F.col("file_name") == "", parent_path).otherwise(F.concat(parent_path, F.lit("\\"), "file_name"))
    path = F.when((F.col("entry") == ROOT_ENTRY) | (F.col("file_name") == ".") | (own == ""), "\\").otherwise(own)
    return joined.withColumn("path", path).drop("_parent_path").select(*records.columns, "path")


def journal_records(raw: DataFrame) -> DataFrame:
    """Change-journal rows with named flags and record numbers without their sequence part."""
    low48 = F.lit(0xFFFFFFFFFFFF)
    return raw.select(
        *[c for c in raw.columns if c not in ("reason", "file_attributes")],
        blank_to_null(hexbin.flag_names(F.col("reason"), JOURNAL_REASONS, "|")).alias("reason"),
        blank_to_null(hexbin.flag_names(F.col("file_attributes"), FILE_ATTRIBUTES, "|")).alias("file_attributes"),
        F.col("file_reference").bitwiseAND(low48).alias("mft_entry"),
        F.col("parent_file_reference").bitwiseAND(low48).alias("parent_mft_entry"),
    )


def usage_table_name(guid: str, columns: list[str]) -> str:
    """Provider table name from its column signature."""
    have = set(columns)
    if have & {"BytesSent", "BytesRecvd", "BytesInBound", "BytesOutBound"}:
        return "SRUM_NetworkDataUsage"
    if "ForegroundCycleTime" in have:
        return "SRUM_ApplicationResourceUsage"
    if have & {"ConnectedTime", "ConnectStartTime"}:
        return "SRUM_NetworkConnectivityUsage"
    if {"DurationMS", "EndTime"} <= have:
        return "SRUM_ApplicationTimeline"
    if have & {"ChargeLevel", "DesignedCapacity"}:
        return "SRUM_EnergyUsage"
    if have & {"NotificationType", "PayloadSize"}:
        return "SRUM_PushNotifications"
    return "SRUM_" + guid.strip("{}").replace("-", "")


def id_names(id_map: DataFrame) -> DataFrame:
    """Readable text of the id map: type 3 is a security identifier, the rest UTF-16LE text; the last row of an id wins."""
    named = F.when(F.col("IdType") == 3, hexbin.sid_text("IdBlob")).otherwise(hexbin.id_blob_text("IdBlob"))
    keys = [c for c in ("case_id", "host_id") if c in id_map.columns]
    return id_map.withColumn("id_text", named).groupBy(*keys, "IdIndex").agg(F.max_by("id_text", "_rowid").alias("id_text"))


def resolve_usage(usage: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """App and user text by id. The map grows with the hosts, so the join strategy is left to size statistics."""
    app = names.select(*keys, F.col("IdIndex").alias("AppId"), F.col("id_text").alias("app"))
    user = names.select(*keys, F.col("IdIndex").alias("UserId"), F.col("id_text").alias("user"))
    return usage.join(app, [*keys, "AppId"], "left").join(user, [*keys, "UserId"], "left")


def usage_time(days: Column) -> Column:
    return times.ole_days(days)
