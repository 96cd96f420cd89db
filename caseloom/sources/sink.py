"""A result sink whose runs can be repeated, cut off and finished later without doubling or losing rows.

A run goes through three steps. ``stage`` writes the result below ``_runs/<run>`` and then its manifest: every host the run
has processed, with its rows and an order-independent digest. ``publish`` replaces exactly these hosts in the table, from the
staged files, and marks the run as done. ``recover`` publishes, in order, every run that has a manifest but no mark.

Staging without a manifest was cut off and counts for nothing; publishing may be repeated as often as it is cut off. Folders
with a leading underscore are not seen by readers of the table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.operators.compare import rows_digest
from caseloom.sources.raw import observed, ordered_columns


class SinkError(RuntimeError):
    """A published table does not hold what its manifest says."""


@dataclass(frozen=True)
class ResultSink:
    """One result table in ``path``, partitioned by ``keys`` (text; empty and NULL are one host).

    Run names sort in the order in which runs are to count.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...] = ("host_id",)

    def stage(self, df: DataFrame, run: str, hosts: DataFrame | None = None, preferred: list[str] | None = None) -> dict[str, int]:
        """Write one run aside and return its row counts. ``hosts``: all processed hosts; one without rows is emptied in the table.

        The result is computed once: its rows are counted by the writing job itself.
        """
        columns = ordered_columns(preferred or [], [c for c in df.columns if c not in self.keys])
        result = df.select(*columns, *self._key_texts())
        counted, seen = observed(result, f"sink {run}")
        counted.write.mode("overwrite").partitionBy(*self.keys).parquet(self._rows(run))
        staged = self.spark.read.schema(result.schema).parquet(self._rows(run))
        manifest = staged.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("rows"), rows_digest(result.columns).alias("digest"))
        if hosts is not None:
            empty = hosts.select(*self._key_texts()).distinct().select(*self.keys, F.lit(0).alias("no_rows"), F.lit(None).cast("string").alias("no_digest"))
            manifest = manifest.unionByName(empty.toDF(*self.keys, "rows", "digest")).groupBy(*self.keys).agg(F.sum("rows").alias("rows"), F.max("digest").alias("digest"))
        manifest.withColumn("schema", F.lit(result.schema.json())).write.mode("overwrite").parquet(self._manifest(run))
        written = self.manifest(run).agg(F.sum("rows")).first()[0] or 0
        if written != seen.get["rows"]:
            raise SinkError(f"run {run}: {seen.get['rows']} rows computed, {written} staged")
        return seen.get

    def publish(self, run: str) -> None:
        """Replace the run's hosts in the table by its staged rows. May be repeated."""
        schema = self._schema(run)
        if schema is not None:
            rows = self.spark.read.schema(schema).parquet(self._rows(run))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.keys).parquet(self.path)
            # Hosts that were processed without any row: a folder each, never more than the hosts of one run.
            for host in self.manifest(run).filter("rows = 0").toLocalIterator():
                folder = "/".join(f"{k}={self._folder_name(host[k])}" for k in self.keys)
                self._files().delete(self._hadoop_path(f"{self.path}/{folder}"), True)
            self.verify(run)
        self._files().create(self._hadoop_path(self._mark(run)), True).close()

    def verify(self, run: str) -> None:
        """Compare the run's hosts in the table with its manifest, by rows and digest."""
        table = self.read(run)
        now = table.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("rows_now"), rows_digest(table.columns).alias("digest_now")).alias("now")
        same = reduce(lambda a, b: a & b, [F.col(f"want.{k}").eqNullSafe(F.col(f"now.{k}")) for k in self.keys])
        both = self.manifest(run).alias("want").join(now, same, "left")
        wrong = both.filter((F.col("rows") != F.coalesce("rows_now", F.lit(0))) | ~F.col("digest").eqNullSafe(F.col("digest_now"))).limit(1).collect()
        if wrong:
            raise SinkError(f"run {run}: {wrong[0].asDict()}")

    def recover(self) -> list[str]:
        """Finish every staged run that is not published, in order of their names."""
        waiting = [run for run in self.runs() if not self._exists(self._mark(run))]
        for run in waiting:
            self.publish(run)
        return waiting

    def runs(self) -> list[str]:
        """Names of the runs that were staged completely."""
        top = self._hadoop_path(f"{self.path}/_runs")
        if not self._files().exists(top):
            return []
        found = sorted(status.getPath().getName() for status in self._files().listStatus(top))
        return [run for run in found if self._exists(f"{self._manifest(run)}/_SUCCESS")]

    def read(self, run: str | None = None) -> DataFrame:
        """The published rows, with the columns of the latest run (or the named one); no rows before the first run."""
        schemas = (self._schema(r) for r in ([run] if run else reversed(self.runs())))
        schema = next((s for s in schemas if s is not None), None)
        if schema is None:
            return self.spark.createDataFrame([], ", ".join(f"{k} string" for k in self.keys))
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], schema)
            raise

    def manifest(self, run: str) -> DataFrame:
        rows = self.spark.read.parquet(self._manifest(run))
        return rows.select(*self.keys, "rows", "digest")

    def _schema(self, run: str) -> T.StructType | None:
        described = self.spark.read.parquet(self._manifest(run)).select("schema").first()
        return T.StructType.fromJson(json.loads(described["schema"])) if described else None

    def _key_texts(self) -> list[Column]:
        return [F.nullif(F.col(k).cast("string"), F.lit("")).alias(k) for k in self.keys]

    def _folder_name(self, value: str | None) -> str:
        utils = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        return "__HIVE_DEFAULT_PARTITION__" if value is None else utils.escapePathName(value)

    def _rows(self, run: str) -> str:
        return f"{self.path}/_runs/{run}/rows"

    def _manifest(self, run: str) -> str:
        return f"{self.path}/_runs/{run}/manifest"

    def _mark(self, run: str) -> str:
        return f"{self.path}/_runs/{run}/published"

    def _hadoop_path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._hadoop_path(self.path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _exists(self, path: str) -> bool:
        return self._files().exists(self._hadoop_path(path))
