"""Benchmark decontamination: which documents contain a benchmark item.

An item is contained in a document when at least ``threshold`` of its distinct five-word shingles occur there. Items are short
and documents long, so a banded signature of a whole document would have a similarity of some thousandths with the item. The
search therefore keeps the MinHash sample on the item's side: items are partitioned by size, and each partition keeps as many
of an item's smallest shingle hashes (its bottom-k sketch) as its largest size requires for a document to be unable to reach
the threshold while missing all of them: a document that holds ``threshold`` of ``n`` shingles misses at most
``n - ceil(threshold * n)``, so one shingle more than that is enough. The rolling shingles of every whole document probe this
index; candidates are verified on the shingle texts themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import cut_lineage, once

WIDTH = 5
THRESHOLD = 0.8
#: Rows up to which an index or a candidate list, counted first, is broadcast (some 20 bytes a row).
BROADCAST_ROWS = 500_000


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits; punctuation and spacing don't tell texts apart."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _starts(width: Column | int) -> Column:
    """Numbers of the words that begin a run of ``width`` words; none in a shorter text."""
    return F.when(F.size("_words") >= width, F.sequence(F.lit(1), F.size("_words") - width + 1)).otherwise(F.array().cast("array<int>"))


def _run_hashes(width: int) -> Column:
    return F.transform(_starts(width), lambda i: F.xxhash64(*[F.get("_words", i + (k - 1)) for k in range(width)]))


def _item_hashes() -> Column:
    """Hash of each shingle of an item; an item of ``n`` words, under five, is one shingle of ``n`` words."""
    hashes = _run_hashes(WIDTH)
    for n in range(1, WIDTH):
        hashes = F.when(F.size("_words") == n, _run_hashes(n)).otherwise(hashes)
    return hashes


def _shingles(width: Column) -> Column:
    return F.array_distinct(F.transform(_starts(width), lambda i: F.array_join(F.slice("_words", i, width), " ")))


def _sized(df: DataFrame) -> DataFrame:
    """The frame, to be broadcast if it is counted small; ``df`` is a checkpoint, so that counting is cheap."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_index(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, width, hash) of the bottom-k sketch of each item, ``k`` by the size partition of the item."""
    words = once(items.select("item_id", plain_words(F.col("text")).alias("_w")), "_words", F.col("_w")).drop("_w")
    hashed = once(words, "_h", F.array_sort(F.array_distinct(_item_hashes()))).filter(F.size("_h") > 0)
    largest = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("_h"))))  # largest size of the partition
    k = (F.floor(largest * (1 - threshold) + 1e-9) + 1).cast("int")
    return hashed.select("item_id", F.least(F.size("_words"), F.lit(WIDTH)).alias("width"), F.explode(F.slice("_h", F.lit(1), k)).alias("hash"))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document and item it contains: ``doc_id``, ``item_id``, ``item_shingles``, ``shared_shingles``, ``containment``.

    ``items`` has ``item_id`` and ``text``. Null or wordless texts contain nothing and are contained in nothing. An item under
    five words is a single shingle of its words and is found wherever these follow each other; documents are only probed with
    the widths that items have. Very long texts are probed whole. Repeated rows give one result row. Null ids are ids like any
    other. Other columns are not read; empty tables give an empty result.
    """
    index = cut_lineage(item_index(items.select("item_id", "text"), threshold))
    widths = sorted(r["width"] for r in index.select("width").distinct().collect())
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("_text"))
    probes = rows.select("doc_id", F.xxhash64("_text").alias("_row"), plain_words(F.col("_text")).alias("_words"))
    probes = once(probes, "_w", F.col("_words")).select("doc_id", "_row", F.col("_w").alias("_words"))
    runs = [_run_hashes(n) for n in widths or [WIDTH]]
    probes = probes.select("doc_id", "_row", F.explode(runs[0] if len(runs) == 1 else F.concat(*runs)).alias("hash"))
    candidates = cut_lineage(probes.join(_sized(index.select("item_id", "hash")), "hash").select("doc_id", "_row", "item_id").distinct())
    held = candidates.select(F.col("doc_id").alias("_id"), "_row", "item_id")
    held = held.join(items.select(F.col("item_id").alias("_item"), F.col("text").alias("_item_text")), F.col("item_id").eqNullSafe(F.col("_item")))
    pairs = rows.join(_sized(held.drop("_item", "_item_text")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_row")))
    texts = items.select(F.col("item_id").alias("_item"), F.col("text").alias("_item_text"))
    pairs = pairs.join(texts, F.col("item_id").eqNullSafe(F.col("_item")))
    # the item's words say how wide the shingles of both are
    item = once(pairs.select("doc_id", "item_id", "_text", plain_words(F.col("_item_text")).alias("_w")), "_words", F.col("_w")).drop("_w")
    item = item.withColumn("_width", F.least(F.size("_words"), F.lit(WIDTH))).filter("_width > 0")
    item = once(item, "_want", _shingles(F.col("_width"))).drop("_words")
    doc = once(item.select("doc_id", "item_id", "_width", "_want", plain_words(F.col("_text")).alias("_w")), "_words", F.col("_w")).drop("_w")
    both = once(doc, "_doc", _shingles(F.col("_width")))
    counted = both.select("doc_id", "item_id", F.size("_want").cast("bigint").alias("item_shingles"), F.size(F.array_intersect("_want", "_doc")).cast("bigint").alias("shared_shingles"))
    return counted.filter(F.col("shared_shingles") >= F.lit(threshold) * F.col("item_shingles")).distinct().withColumn(
        "containment", F.col("shared_shingles") / F.col("item_shingles"))


def without_benchmark(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that contain no item, with all their columns. Rows that share an id with a row that does go with it."""
    hit = contained_items(docs.select(id_column, text_column), items, threshold, id_column, text_column).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(hit, docs[id_column].eqNullSafe(hit["_id"]), "left_anti")


_SQL_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_SQL_SHINGLES = "list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))"
ORACLE = f"""
WITH iw AS (SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
i AS (SELECT item_id, k, unnest({_SQL_SHINGLES}) AS s FROM iw), n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1),
d AS (SELECT doc_id, k, unnest({_SQL_SHINGLES}) AS s FROM (SELECT doc_id, {_SQL_WORDS} AS w FROM documents) JOIN (SELECT DISTINCT k FROM iw) ON len(w) >= k),
c AS (SELECT doc_id, item_id, count(*) AS m FROM d JOIN i USING (s, k) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS item_shingles, m AS shared_shingles, m / n AS containment FROM c JOIN n USING (item_id) WHERE m >= 0.8 * n"""
