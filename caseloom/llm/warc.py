"""Deterministic sharded WARC writer, and its reader.

Records are range-sorted by page id into shards whose bounds depend on the data alone, so a second run writes the same files.
Each shard is one task: it streams its rows in order, writes one gzip member per record, starts a new file when the compressed
size is reached, and regenerates record headers, lengths and digests. Files are written under temporary names that no other
attempt uses. The task's rows, its manifest, are stored as a table in the shared folder; only files named there are renamed to
their final names, so attempts of lost or speculative tasks leave nothing that a reader would see.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.llm.common import cut_lineage, ensure_checkpoint_dir, small_batches

#: Compressed bytes after which a file ends, and uncompressed payload bytes of a shard.
FILE_BYTES, SHARD_BYTES = 1 << 30, 1 << 31
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def shard_bounds(pages: DataFrame, size: str, target: int) -> list[int]:
    """Lower bounds of all shards but the first: a shard starts at the first id before which another ``target`` bytes lie.

    The bytes before an id are running sums inside the parts of a range sort, plus the sums of the parts before it. The driver
    sees one sum per part and one bound per shard. Bounds depend on the data alone, not on where the sort cuts.
    """
    spark = pages.sparkSession
    per_id = pages.filter("page_id IS NOT NULL").groupBy("page_id").agg(F.sum(size).alias("_n"))
    ordered = cut_lineage(per_id.repartitionByRange("page_id").select("page_id", "_n", F.spark_partition_id().alias("_part")))
    before, total = [], 0
    for part, n in sorted(map(tuple, ordered.groupBy("_part").agg(F.sum("_n")).collect())):
        before.append((part, total))
        total += n
    if total <= target:
        return []
    starts = spark.createDataFrame(before, "_part int, _before bigint")
    earlier = F.sum("_n").over(Window.partitionBy("_part").orderBy("page_id")) - F.col("_n")
    placed = ordered.withColumn("_earlier", earlier).join(F.broadcast(starts), "_part")
    shard = F.floor((F.col("_before") + F.col("_earlier")) / target)
    return sorted(r["_low"] for r in placed.groupBy(shard.alias("_shard")).agg(F.min("page_id").alias("_low")).collect())[1:]


def with_duplicates(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, _sha, refers_to) of the records that revisit an equal payload: same SHA-1, SHA-256 and length."""
    keyed = pages.filter(F.col("_size") >= least)
    groups = keyed.groupBy("_sha", "_sha2", "_size").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND refers_to IS NOT NULL")
    rows = keyed.select("page_id", "_sha", "_sha2", "_size").join(groups.drop("_n"), ["_sha", "_sha2", "_size"])
    return rows.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "_sha", "refers_to").distinct()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:caseloom:page:{'none' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the reply's headers, with the payload's length, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(block).hexdigest())}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES, revisit_from: int = 0) -> DataFrame:
    """Write one record per row of ``page_id, url, html`` below ``folder``; returns the committed manifest.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at least ``revisit_from`` bytes, the record with the
    smallest id is the response and the others revisit it. Null url is empty. Null ids come first and never are the response
    if the payload has an id; among null ids alone all are responses. Rows repeated with the same id and payload are all
    responses or all revisits. Other columns are not read. An empty table writes no file.

    Manifest: ``shard, file, path, records, bytes, sha256``. ``folder`` may be any URI that Spark and pyarrow both write to.
    """
    spark = pages.sparkSession
    small_batches(spark)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    sized = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    keyed = sized.select("page_id", F.sha1("payload").alias("_sha"), F.sha2("payload", 256).alias("_sha2"), F.octet_length("payload").cast("bigint").alias("_size"))
    bounds = shard_bounds(sized.select("page_id", (F.octet_length("payload") + 500).alias("_size")), "_size", shard_bytes)
    marks = with_duplicates(keyed, revisit_from).select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), F.col("_sha").alias("sha"), "refers_to")
    rows = sized.select("page_id", F.lit(1).alias("kind"), "url", "payload", F.sha1("payload").alias("sha"), F.lit(None).cast("bigint").alias("refers_to"))
    both = marks.unionByName(rows).withColumn("shard", _shard_of(bounds))
    sharded = both.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions(
        F.col("shard"), F.col("page_id").asc_nulls_first(), "kind", "sha", "url")
    root = folder.rstrip("/")
    temporary = f"{root}/_temporary"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(temporary)
        fs.create_dir(base, recursive=True)
        out = None
        shard, page, targets = None, object(), {}
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("shard", "page_id", "kind", "url", "payload", "sha", "refers_to")]
            for s, page_id, kind, url, body, sha, refers_to in zip(*columns):
                if s != shard:
                    if out:
                        yield out.close()
                    shard, out, number = s, None, 0
                if page_id != page:
                    page, targets = page_id, {}
                if kind == 0:
                    targets[sha] = refers_to
                    continue
                if out is None:
                    out = _Rolling(fs, base, shard, number)
                    number += 1
                out.add(record(page_id, url, body, base32_sha1(sha), targets.get(sha)))
                if out.size >= file_bytes:
                    yield out.close()
                    out = None
        if out:
            yield out.close()

    table = f"{root}/_written"
    sharded.mapInArrow(write, "shard int, file int, temporary string, records bigint, bytes bigint, sha256 string").write.mode("overwrite").parquet(table)
    return commit(spark, root)


class _Rolling:
    """One archive file under a temporary name of its own."""

    def __init__(self, fs, base: str, shard: int, number: int):
        self.row = {"shard": shard, "file": number, "temporary": f"{base}/{shard:06d}-{number:05d}-{uuid.uuid4().hex}.warc.gz"}
        self.out, self.size, self.records, self.sha = fs.open_output_stream(self.row["temporary"], compression=None), 0, 0, hashlib.sha256()

    def add(self, data: bytes) -> None:
        packed = gzip.compress(data, 6, mtime=0)
        self.out.write(packed)
        self.sha.update(packed)
        self.size, self.records = self.size + len(packed), self.records + 1

    def close(self) -> pa.RecordBatch:
        self.out.close()
        row = {**self.row, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest()}
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))


def _shard_of(bounds: list[int]):
    """Number of bounds at or below the id, by halving, so that many shards stay cheap."""
    def half(low: int, high: int):
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("page_id") >= bounds[middle], half(middle + 1, high)).otherwise(half(low, middle))
    return half(0, len(bounds)).cast("int")


def _file_system(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def commit(spark: SparkSession, root: str) -> DataFrame:
    """Rename the files that the stored task rows name, then store the manifest. Renaming again changes nothing."""
    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(root)
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                path = f"{base}/{row['shard']:06d}-{row['file']:05d}.warc.gz"
                if fs.get_file_info(row["temporary"]).type != pafs.FileType.NotFound:
                    fs.move(row.pop("temporary"), path)
                elif fs.get_file_info(path).size != row["bytes"]:
                    raise FileNotFoundError(f"{path}: neither the temporary nor the committed file is there")
                row["path"] = path
            columns = {n: [r[n] for r in rows] for n in ("shard", "file", "path", "records", "bytes", "sha256")}
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], k) for n, k in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=list(columns))

    manifest = f"{root}/manifest"
    spark.read.parquet(f"{root}/_written").mapInArrow(rename, "shard int, file int, path string, records bigint, bytes bigint, sha256 string").write.mode("overwrite").parquet(manifest)
    return spark.read.parquet(manifest)


def read_archives(manifest: DataFrame, root: str) -> DataFrame:
    """One row per record of the files of a manifest, in file order; lengths and digests are those found in the files.

    ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` (null for revisits), ``sound`` (block
    digest, payload digest and length agree with the headers).
    """
    small_batches(manifest.sparkSession)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "sound"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for row in records(stream):
                        rows.append(row)
                        size += len(row[6] or b"") + 200
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    # one file per task: files are large and few, and rows of this table are only their names
    files = manifest.select("path").repartitionByRange(max(1, manifest.count()), "path")
    return files.mapInArrow(read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary, sound boolean")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The contents of the gzip members of a stream, one after the other."""
    data = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not data:
                data = stream.read(chunk)
                if not data:
                    if parts:
                        raise EOFError("a member is cut off")
                    return
            parts.append(unpack.decompress(data))
            data = unpack.unused_data
        yield b"".join(parts)


def _page_of(identifier: str | None) -> int | None:
    page = identifier.split(":")[3] if identifier else "none"
    return None if page == "none" else int(page)


def records(stream) -> Iterator[tuple]:
    for content in members(stream):
        head, _, rest = content.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[:int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = fields["WARC-Type"] == "revisit"
        sound = fields["WARC-Block-Digest"] == f"sha1:{base32_sha1(hashlib.sha1(block).hexdigest())}"
        if not revisit:
            sound = sound and len(payload) == length and base32_sha1(hashlib.sha1(payload).hexdigest()) == digest
            length, digest = len(payload), base32_sha1(hashlib.sha1(payload).hexdigest())
        yield (_page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], length, digest, fields["WARC-Type"],
               _page_of(fields.get("WARC-Refers-To")) if revisit else None, None if revisit else payload, sound)


def archive_folder(spark: SparkSession) -> str:
    """A new folder under the shared one, for one run."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s, min(page_id) OVER (PARTITION BY b) AS m FROM p),
q AS (SELECT *, list_transform(range(0, 32), lambda k: list_sum(list_transform(range(0, 5), lambda j:
  CASE WHEN (('0x' || s[(5 * k + j) // 4 + 1])::INT >> (3 - (5 * k + j) % 4)) & 1 = 1 THEN 16 >> j ELSE 0 END))::INT) AS v FROM h)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(v, lambda x: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[x + 1]), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM q"""
