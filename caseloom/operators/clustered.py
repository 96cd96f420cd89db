"""Result files in order, so that a page far from the start reads a few of them.

Rows are dealt by ranges of the order's keys and written sorted; an index holds the first and last key of every stretch of a
file. A page takes the index rows from its place on, as many as it needs rows, and opens only the files of these stretches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.operators.filters import beyond

#: Shorter files cost more to open than to read.
LEAST_ROWS = 100_000


@dataclass(frozen=True)
class OrderedFiles:
    """Rows in ``path`` by ``keys``, all ascending or all descending. The keys together should tell rows apart."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    descending: bool = False

    def write(self, rows: DataFrame, rows_per_file: int = 1_000_000) -> None:
        """Every ``rows_per_file`` rows have an index row; as many of these stretches share a file as ``LEAST_ROWS`` rows hold."""
        order = self._order()
        laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        # the lower 33 bits count the rows of a task
        stretch = F.floor(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(rows_per_file))
        laid.withColumn("_stretch", stretch).write.option("maxRecordsPerFile", max(rows_per_file, LEAST_ROWS)).parquet(f"{self.path}/rows")
        key = F.struct(*self.keys)
        schema = T.StructType([*rows.schema, T.StructField("_stretch", T.LongType())])
        files = self._rows(schema).groupBy(F.col("_metadata.file_path").alias("file"), "_stretch").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("rows")).drop("_stretch")
        files.write.parquet(f"{self.path}/index")

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index")

    def page(self, schema: T.StructType, limit: int, after: dict[str, object] | None = None) -> tuple[DataFrame, int]:
        """The ``limit`` rows after the given keys, in order, and the number of files they come from.

        At most ``limit`` + 1 index rows come to the driver: every stretch has a row, and only the first may lie before the place.
        """
        first, last = ("high", "low") if self.descending else ("low", "high")
        wanted = self.index()
        if after is not None:
            ends = wanted.select("*", *[F.col(f"{last}.{k}").alias(k) for k in self.keys])
            wanted = ends.filter(beyond({k: self.descending for k in self.keys}, after)).drop(*self.keys)
        begin = F.desc(first) if self.descending else F.asc(first)
        files, rows = [], 0
        for i, entry in enumerate(wanted.orderBy(begin).limit(limit + 1).collect()):
            if rows >= limit:
                break
            files.append(entry["file"])
            # How much of the first stretch lies behind the place is not known.
            rows += entry["rows"] if i or after is None else 0
        files = list(dict.fromkeys(files))
        if not files:
            return self.spark.createDataFrame([], schema), 0
        found = self.spark.read.schema(schema).parquet(*files)
        if after is not None:
            found = found.filter(beyond({k: self.descending for k in self.keys}, after))
        return found.orderBy(*self._order()).limit(limit), len(files)

    def _rows(self, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def _order(self) -> list[Column]:
        return [F.desc(k) if self.descending else F.asc(k) for k in self.keys]
