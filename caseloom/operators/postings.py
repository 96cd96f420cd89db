"""Evidence tables with a posting table of trigrams, so that a text search opens only files that can hold the text.

A posting is a (gram, file) pair: three characters in a row, case folded, that occur in some value of the file. A file in which a
gram of the needle is missing cannot hold the needle; all others are searched as before, so hits are the same with the postings,
without them, and with postings of a part of the files only.

Postings are built in the JVM: grams are made distinct per value, then per file before the shuffle, and stored in order of the
gram, so that a probe reads few row groups. They grow with the different grams of a file, not with its rows. A run (a host, a
day) is added on its own and may be added again after it was cut off: its files are searched in full until its postings stand.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters in a gram, and grams of one needle that are looked up. Any of them exclude files; more exclude few others.
GRAM, PROBED = 3, 10
#: Ends a value, so that its last characters begin grams too and a needle of two characters is the beginning of a gram.
END = "\0" * (GRAM - 1)

NAME = re.compile(r"[A-Za-z0-9_.-]+")


def grams(value: Column) -> Column:
    """Different grams of one folded value. The look-ahead advances by one character, so it is one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(F.concat(F.lower(value), F.lit(END)), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def probe(needle: str) -> list[str]:
    """At most ``PROBED`` different grams of a needle, spread over it; for a shorter needle, the needle."""
    folded = needle.lower()
    if len(folded) < GRAM:
        return [folded]
    found = sorted({folded[i:i + GRAM] for i in range(len(folded) - GRAM + 1)})
    return [found[i * len(found) // PROBED] for i in range(PROBED)] if len(found) > PROBED else found


@dataclass(frozen=True)
class PostedTables:
    """Tables below ``path``: ``rows/<table>/<run>``, ``postings/<run>`` and ``files/<run>``, the files that postings cover."""

    spark: SparkSession
    path: str
    #: Columns that are not searched.
    keys: tuple[str, ...] = ("host_id", "_rowid")

    def add(self, tables: dict[str, DataFrame], run: str, rows_per_file: int = 250_000) -> None:
        """Write one run's tables and their postings; rows are dealt by ranges of the keys. Replaces the run if it is there."""
        for name in (run, *tables):
            if not NAME.fullmatch(name):
                raise ValueError(f"not a name for a folder: {name}")
        schemas = [(name, run, df.schema.json()) for name, df in sorted(tables.items())]
        self.spark.createDataFrame(schemas, "table_name string, run string, schema string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/tables/{run}")
        pairs, files = [], []
        for name, df in sorted(tables.items()):
            order = [k for k in self.keys if k in df.columns]
            laid = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
            folder = f"{self.path}/rows/{name}/{run}"
            laid.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(folder)
            stored = self.spark.read.schema(df.schema).parquet(folder)
            file = F.substring_index("_metadata.file_path", "/", -3).alias("file")
            files.append(stored.groupBy(file).agg(F.count(F.lit(1)).alias("rows")))
            values = [F.col(f"`{c}`").cast("string") for c in df.columns if c not in self.keys]
            if values:
                each = stored.select(file, F.explode(F.array(*values)).alias("value")).filter(F.col("value").isNotNull())
                pairs.append(each.select("file", F.explode(grams(F.col("value"))).alias("gram")).distinct())
        for i, part in enumerate(pairs):
            ordered = part.repartitionByRange("gram", "file").sortWithinPartitions("gram", "file")
            ordered.write.mode("append" if i else "overwrite").parquet(f"{self.path}/postings/{run}")
        for i, part in enumerate(files):
            part.write.mode("append" if i else "overwrite").parquet(f"{self.path}/files/{run}")

    def candidates(self, needle: str) -> DataFrame:
        """Files whose postings hold every gram that is looked up."""
        wanted = probe(needle)
        postings = self._read("postings", "gram string, file string")
        if len(wanted[0]) < GRAM:
            return postings.filter(F.col("gram").startswith(wanted[0])).select("file").distinct()
        found = postings.filter(F.col("gram").isin(wanted)).groupBy("file").agg(F.count_distinct("gram").alias("grams"))
        return found.filter(F.col("grams") == len(wanted)).select("file")

    def narrowed(self, needle: str) -> tuple[list[tuple[str, DataFrame]], int, int]:
        """Tables with their rows in files that may hold the needle, the number of these files, and that of all.

        Only names of files come to the driver, as they do for any scan. Files that no posting covers are among them, so rows of
        a run whose postings were never finished are still found. Runs of one table that share their columns are one frame.
        """
        files = self._files()
        covered = {r["file"] for r in self._read("files", "file string, rows bigint").select("file").collect()}
        hit = {r["file"] for r in self.candidates(needle).collect()}
        kept = [f for f in files if f in hit or f not in covered]
        schemas = {(r["table_name"], r["run"]): r["schema"] for r in self._read("tables", "table_name string, run string, schema string").collect()}
        groups: dict[tuple[str, str], list[str]] = defaultdict(list)
        for file in kept:
            table, run, _ = file.split("/")
            groups[table, schemas[table, run]].append(f"{self.path}/rows/{file}")
        return list(self._frames(groups)), len(kept), len(files)

    def _frames(self, groups: dict[tuple[str, str], list[str]]) -> Iterator[tuple[str, DataFrame]]:
        for (table, schema), files in sorted(groups.items()):
            yield table, self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*files)

    def _files(self) -> list[str]:
        """All files of rows as table/run/name. A schema is given, so they are listed and not opened."""
        if not self._there(f"{self.path}/rows"):
            return []
        listed = self.spark.read.schema("_any int").option("recursiveFileLookup", "true").parquet(f"{self.path}/rows").inputFiles()
        return sorted("/".join(f.split("/")[-3:]) for f in listed)

    def _read(self, name: str, schema: str) -> DataFrame:
        """All runs of one of the small tables, by their folders; an empty one before the first run has come so far."""
        folder = f"{self.path}/{name}"
        if not self._there(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)

    def _there(self, folder: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(target)
