"""File inventory of a collection: discovery by name or content, content de-duplication, backup copies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.core import any_of
from caseloom.functions.text import last_segment
from caseloom.operators.ordered import first_per_key


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder. Content is only read where a later column needs it."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", "length", "content")
    )


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` and ``length`` of all files with content below a folder. No file is opened; empty ones hold no evidence and are left out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


#: Bytes of a file that a task holds at once.
BLOCK_BYTES = 8 << 20


def read_blocks(stream, size: int, markers: list[bytes]) -> tuple[str, list[bool], int]:
    """Digest of all bytes, whether each marker occurs, and the length, reading one block at a time.

    The end of a block is kept for the next one, so that a marker across the border is found.
    """
    digest, found, total = hashlib.sha256(), [not m for m in markers], 0
    keep, tail = max([len(m) for m in markers], default=1) - 1, b""
    while block := stream.read(size):
        digest.update(block)
        total += len(block)
        joined = tail + block
        found = [f or m in joined for f, m in zip(found, markers)]
        tail = joined[-keep:] if keep > 0 else b""
    return digest.hexdigest(), found, total


def digested(files: DataFrame, markers: dict[str, str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Listed files with ``digest`` (SHA-256 of the whole content), ``_error`` and one boolean per marker name.

    Tasks read the files in blocks through their storage's own client, so a file may be of any size. A marker is looked for as
    UTF-8 and as UTF-16LE. A file that cannot be read keeps its row, without a digest. ``files``: path, length, and any others.
    """
    names = list(markers or {})
    wanted = [text.encode(code) for text in (markers or {}).values() for code in ("utf-8", "utf-16-le")]
    fields = [*files.schema.fields, T.StructField("digest", T.StringType()), T.StructField("_error", T.StringType()), *(T.StructField(n, T.BooleanType()) for n in names)]
    place = files.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            digests, errors, hits = [], [], []
            for path in batch.column(place).to_pylist():
                try:
                    system, inner = fs.FileSystem.from_uri(_storage_uri(path))
                    with system.open_input_stream(inner, compression=None) as stream:
                        digest, found, _ = read_blocks(stream, block_bytes, wanted)
                    error = None
                except (OSError, ValueError, pa.ArrowException) as problem:
                    digest, found, error = None, [None] * len(wanted), str(problem)
                digests.append(digest)
                errors.append(error)
                hits.append([None if error else found[2 * i] or found[2 * i + 1] for i in range(len(names))])
            columns = [pa.array(digests, pa.string()), pa.array(errors, pa.string()), *(pa.array([h[i] for h in hits], pa.bool_()) for i in range(len(names)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[f.name for f in fields])

    # A listing is a few rows; they are dealt over all tasks, as each may stand for gigabytes.
    spread = files.repartition(F.col("path"))
    return spread.mapInArrow(run, T.StructType(fields))


def _storage_uri(path: str) -> str:
    """Spark gives plain paths and writes local ones as ``file:/x``; the storage client wants escaped ones and ``file:///x``."""
    uri = quote(path, safe="/:@")
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def same_content(digests: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First path per (size, digest) of digested files; unreadable files stay."""
    group = [*(keys or []), "length", "digest"]
    kept = first_per_key(digests.filter(F.col("digest").isNotNull()), group, F.col("path"))
    return kept.unionByName(digests.filter(F.col("digest").isNull()))


def named(names: list[str], path: str = "path") -> Column:
    return F.lower(last_segment(path)).isin(*[n.lower() for n in names])


def with_suffix(suffixes: list[str], path: str = "path") -> Column:
    """Extensions (with their dot) and longer endings alike."""
    name = F.lower(last_segment(path))
    return any_of([name.endswith(s.lower()) for s in suffixes])


def with_marker(marker: str, content: str = "content") -> Column:
    """Marker anywhere in the content, as UTF-8 or UTF-16LE. One character per byte keeps matches on byte positions."""
    whole = F.decode(F.col(content), "ISO-8859-1")
    return F.contains(whole, F.lit(marker.encode("utf-8").decode("latin-1"))) | F.contains(whole, F.lit(marker.encode("utf-16-le").decode("latin-1")))


def content_digest(content: str = "content") -> Column:
    """Digest of the whole content: files that differ anywhere are different."""
    return F.sha2(F.col(content), 256)


def dedupe_by_content(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First path per (size, digest); unreadable files stay. The content itself is never shuffled."""
    keyed = files.withColumn("digest", content_digest()).drop("content")
    group = [*(keys or []), "length", "digest"]
    kept = first_per_key(keyed.filter(F.col("digest").isNotNull()), group, F.col("path"))
    return kept.unionByName(keyed.filter(F.col("digest").isNull()))


def without_backup_copies(hives: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Drop a hive from the backup folder when a live hive of the same name exists."""
    rows = hives.withColumn("_name", F.upper(last_segment(path)))
    is_backup = F.col(path).rlike(r"(?i)[\\/]RegBack[\\/]")
    live = rows.filter(~is_backup).select(*keys, "_name").distinct()
    backups = rows.filter(is_backup).join(live, [*keys, "_name"], "left_anti")
    return rows.filter(~is_backup).unionByName(backups.select(*rows.columns)).drop("_name")
