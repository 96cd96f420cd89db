"""Importance resampling towards a target distribution over hashed n-grams.

Text stays bytes: a table of 256 entries lower-cases A-Z and blanks every separator, ``bytes.split`` gives the words, and the
checksum of an n-gram continues the checksum of its first words. Tasks reduce their features with Counters, so that at most
one row per bucket leaves a task. The gain of a bucket compares its share in the target with its share in the corpus; a
document's weight is its mean gain, and adding Gumbel noise to it makes taking the highest scores a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import cut_lineage, in_order, small_batches

BUCKETS, NGRAMS, SEED, PERCENT, MIN_WORDS = 10_000, 1, 2024, 10, 20

#: What each byte becomes: A-Z lower case; digits, a-z and all bytes of non-ASCII characters themselves; others a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: bytes, ngrams: int) -> tuple[int, list[int]]:
    """Number of words, and the checksum of every run of 1 to ``ngrams`` words joined by one space."""
    words = text.translate(TABLE).split()
    runs = list(map(zlib.crc32, words))
    found = runs
    for size in range(2, ngrams + 1):
        runs = [zlib.crc32(b" " + word, seed) for seed, word in zip(runs, words[size - 1:])]
        found = found + runs
    return len(words), found


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Iterator[bytes]]]:
    for batch in batches:
        yield batch, (value.as_py() or b"" for value in batch.column(column))


def bucket_counts(docs: DataFrame, text_column: str = "text", ngrams: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``, the features that all texts have in it; buckets without any are left out."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for _, texts in _texts(batches, 0):
            for text in texts:
                total.update([c % buckets for c in features(text, ngrams)[1]])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["bucket", "n"])

    counted = docs.select(F.col(f"`{text_column}`").cast("binary").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket in thousandths; the two tables have at most ``buckets`` rows each, whatever the data."""
    s, t = ({r["bucket"]: r["n"] for r in counts.collect()} for counts in (corpus, target))
    of_corpus, of_target = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return [math.floor(1000 * math.log((t.get(b, 0) + 1) * of_corpus / ((s.get(b, 0) + 1) * of_target))) for b in range(buckets)]


def weighted(docs: DataFrame, gain: list[int], id_column: str = "doc_id", text_column: str = "text", ngrams: int = NGRAMS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight``, the mean gain of the document's features, rounded down (none: 0)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(gain)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain_of, buckets = shared.value.__getitem__, len(shared.value)
        for batch, texts in _texts(batches, 1):
            n_words, n_features, weights = [], [], []
            for text in texts:
                words, found = features(text, ngrams)
                n_words.append(words)
                n_features.append(len(found))
                weights.append(sum(map(gain_of, [c % buckets for c in found])) // max(len(found), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weights))],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    named = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("binary").alias("text"))
    return named.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, ngrams: int = NGRAMS, buckets: int = BUCKETS,
             seed: int = SEED, id_column: str = "doc_id", text_column: str = "text", target_text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row; ``rank`` is null unless drawn.

    Of the N rows with at least ``min_words`` words, floor(percent * N / 100) are drawn, numbered from 1 by falling score; ties go
    to the smaller id, null ids last. Null, empty and blank texts have no features and weight 0, whole texts of any length are
    read. Rows that share an id are rows of their own with one noise value; the noise of a null id is that of an empty id. Empty
    tables give no rows, an empty target the smoothed uniform one. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_column, ngrams, buckets), bucket_counts(target, target_text, ngrams, buckets), buckets)
    uniform = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((uniform.cast("double") + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = cut_lineage(weighted(docs, gain, id_column, text_column, ngrams).withColumn("score", F.col("weight") + noise))
    eligible = F.col("n_words") >= min_words
    placed, total = in_order(scored.filter(eligible), "_place", F.desc("score"), F.asc_nulls_last("doc_id"))
    rank = F.when(F.col("_place") < percent * total // 100, F.col("_place") + 1).cast("bigint")
    drawn = placed.withColumn("rank", rank).drop("_place")
    return drawn.unionByName(scored.filter(~eligible).withColumn("rank", F.lit(None).cast("bigint")))


def selected(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", **parameters) -> DataFrame:
    """The drawn documents with all their columns; rows that share an id stay or go together."""
    drawn = resample(docs, target, id_column=id_column, **parameters).filter("rank is not null")
    ids = drawn.select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col(f"`{id_column}`").eqNullSafe(F.col("_drawn")), "left_semi")


def oracle(percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> str:
    """The same rows for single words; the checksum is computed bit by bit, once per different word."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH RECURSIVE step(k, byte, crc) AS (
  SELECT 0, r::BIGINT, r::BIGINT FROM range(256) t(r)
  UNION ALL SELECT k + 1, byte, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END FROM step WHERE k < 8),
crcs AS (SELECT list(crc ORDER BY byte) AS entry FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
b AS (SELECT {words} AS words FROM benchmark),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(words) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM b) GROUP BY ALL),
different AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
hexed AS (SELECT w, hex(encode(w)) AS h FROM different),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i::INT, 2))::BIGINT)),
  lambda acc, x: xor(acc >> 8, entry[(xor(acc, x) & 255) + 1])), 4294967295) % {buckets} AS bucket FROM hexed, crcs),
s AS (SELECT bucket, sum(n)::DOUBLE AS n FROM dw JOIN hashed USING (w) GROUP BY ALL),
t AS (SELECT bucket, sum(n)::DOUBLE AS n FROM bw JOIN hashed USING (w) GROUP BY ALL),
gain AS (SELECT range AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + {buckets})
    / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + {buckets}))))::BIGINT AS g
  FROM range({buckets}) LEFT JOIN s ON s.bucket = range LEFT JOIN t ON t.bucket = range),
mean AS (SELECT r, sum(n) AS n, sum(n * g)::HUGEINT AS total FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r),
weights AS (SELECT d.r, doc_id, len(words)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN mean ON mean.r = d.r),
scores AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weights),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS total FROM scores WHERE n_features >= {min_words})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {percent} * total // 100 THEN place END::BIGINT AS rank
FROM scores LEFT JOIN drawn ON drawn.r = scores.r"""
