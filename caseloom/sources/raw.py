"""Scans of the raw zone. Row order is evidence: ``(_source_file, _rowid)`` is the scan order everywhere."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions import text as tx
from caseloom.functions.lookups import LOG_ALLOWLIST
from caseloom.schemas import PROVENANCE, raw_schema

SCAN_TIES = ("_source_file", "_rowid")


def scan_seq() -> Column:
    return F.struct(*[F.col(c) for c in SCAN_TIES])


#: Holds the text of a record that a reader cannot parse.
BROKEN = "_broken_record"


def read_table(spark: SparkSession, path: str, table: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """One raw table; a source that was not collected is an empty table, not an error.

    ``json`` (one record a line) and ``csv`` exports are read whole: see ``read_export``.
    """
    schema = raw_schema(table)
    try:
        if fmt in ("json", "csv"):
            return read_export(spark, path, schema, fmt, **options)
        return spark.read.schema(schema).format(fmt).options(**options).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return with_read_status(spark.createDataFrame([], schema)) if fmt in ("json", "csv") else spark.createDataFrame([], schema)
        raise


def read_export(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", **options: str) -> DataFrame:
    """Every line of an export as a row; one that cannot be read keeps its place with ``_status`` and ``_error``.

    A line that is no record of the schema (cut off, another type in a field, a wrong number of CSV fields) is ``corrupted``. Its
    readable fields stay, the others are NULL, and ``_error`` holds the reason and the line. A status that the record itself
    carries is kept when the line is fine. Empty lines are no records.
    """
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])).format(fmt)
    rows = reader.options(**({"header": "true"} if fmt == "csv" else {}) | options).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).load(path)
    return with_read_status(rows)


def with_read_status(rows: DataFrame) -> DataFrame:
    """Turn the reader's corrupt-record column into ``_status`` and ``_error``.

    Readers parse only the fields that a query needs and notice no fault in others. The status therefore mentions every column,
    so that a record has the same status in each query; queries that leave the status out still read their own columns only.
    """
    broken = F.lit(None).cast("string")
    if BROKEN in rows.columns:
        nothing = F.substring(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if c != BROKEN]).cast("string"), 1, 0)
        broken = F.concat(F.col(BROKEN), nothing)
    own = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
    status = F.when(broken.isNotNull(), F.lit("corrupted")).otherwise(own("_status"))
    error = F.when(broken.isNotNull(), F.concat(F.lit("unreadable record: "), broken)).otherwise(own("_error"))
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (BROKEN, "_status", "_error")]
    return rows.select(*kept, status.alias("_status"), error.alias("_error"))


def text_columns(df: DataFrame, keep: tuple[str, ...] = ("_rowid",)) -> DataFrame:
    """Every cell as text, binary as lower-case hex, row identity kept."""
    shown = []
    for field in df.schema.fields:
        if field.name in keep:
            shown.append(F.col(field.name))
        elif isinstance(field.dataType, T.BinaryType):
            shown.append(F.lower(F.hex(field.name)).alias(field.name))
        else:
            shown.append(F.col(field.name).cast("string").alias(field.name))
    return df.select(*shown)


def with_provenance(df: DataFrame) -> DataFrame:
    return df.withColumn("_source_file", F.coalesce(F.col("_metadata.file_name"), F.lit("")))


def is_live() -> Column:
    """Live registry rows: no recovery mark at all, or the mark ``live``; an empty mark is not live."""
    return F.col("_recovery").isNull() | (F.col("_recovery") == "live")


def logs_named(events: DataFrame, needle: str) -> DataFrame:
    """Events of all logs whose name contains the needle; ``log`` is a partition column, so other logs are not read."""
    return events.filter(F.contains(F.lower("log"), F.lit(needle.lower()))) if needle else events


def allowed_logs(files: DataFrame, name: str) -> DataFrame:
    return files.filter(F.lower(F.col(name)).isin(*[n.lower() for n in LOG_ALLOWLIST]))


def hive(registry: DataFrame, name: str) -> DataFrame:
    """Live rows of the hive with exactly this name, whatever its case."""
    return registry.filter((F.upper("hive") == name.upper()) & is_live())


def user_hives(registry: DataFrame) -> DataFrame:
    return registry.filter(F.upper("hive").endswith("NTUSER.DAT") & is_live())


def live_hives(registry: DataFrame) -> DataFrame:
    return registry.filter(is_live())


def record_key(table: str, stem: Column) -> Column:
    return F.when(stem != "", F.concat_ws("::", stem, F.lit(table), F.col("_rowid").cast("string")))


def source_stem() -> Column:
    return tx.file_stem("_source_file")


def foreign_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Copies of a browser history database: only with a ``urls`` table, internal tables skipped, all cells text."""
    # Bookkeeping tables.
    skipped = {"sqlite_sequence", "sqlite_stat1", "history_sync_metadata"}
    if "urls" not in tables:
        return {}
    return {
        name: text_columns(df, keep=())
        for name, df in tables.items()
        if name not in skipped and not name.startswith("sqlite_")
    }


def ordered_columns(preferred: list[str], present: list[str]) -> list[str]:
    """Preferred columns that occur, then the rest by name."""
    head = [c for c in preferred if c in present]
    return head + sorted(c for c in present if c not in head)


def write_table(df: DataFrame, path: str, preferred: list[str] | None = None) -> None:
    """Replace the written hosts' partitions of one result table."""
    keys = [k for k in ("case_id", "host_id") if k in df.columns]
    columns = ordered_columns(preferred or [], [c for c in df.columns if c not in keys])
    writer = df.select(*columns, *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def rows_by_source(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per input file of each artifact."""
    counted = [
        df.groupBy(F.col("_source_file")).agg(F.count(F.lit(1)).alias("rows")).withColumn("artifact", F.lit(name))
        for name, df in tables.items()
    ]
    result = counted[0]
    for part in counted[1:]:
        result = result.unionByName(part)
    return result.select("artifact", "_source_file", "rows")


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, counted by the job that uses them: rows, and rows without and with a parse status, with no scan of their own.

    The observation holds ``rows``, ``ok`` and ``failed`` once a job over the whole frame has ended.
    """
    seen = Observation(name)
    failed = F.col("_status").isNotNull() if "_status" in df.columns else F.lit(False)
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(~failed).alias("ok"), F.count_if(failed).alias("failed")]
    return df.observe(seen, *counts), seen


def status_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per parse status; a record without a status is fine."""
    return df.groupBy(*keys, F.coalesce(F.col("_status"), F.lit("ok")).alias("status")).agg(F.count(F.lit(1)).alias("rows"))


def evidence_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in PROVENANCE]
