"""Near-duplicate documents by SetSketch.

The distinct five-word shingles of a document drive one Poisson process each; a register holds the smallest point that falls to
it, truncated to a power of ``BASE``. Registers of a union are the register-wise maxima, and equal registers are the likelier
the more similar two sets are. Bands of registers bring candidates together; a pair's similarity is estimated jointly from the
numbers of larger, smaller and equal registers and the two known set sizes, by maximum likelihood; what may reach the threshold
is verified on the full sets.

Documents with the same shingle set are one class and are represented by their smallest id. A band bucket is not paired out:
all members are first compared with the member of smallest id. Most buckets then lie within one connected component. In the
others, only pairs from different components are left to look at; they are compared in blocks, where the estimate decides which
sets are intersected, and only links that join components leave the block. No partner is dropped and no bucket is cut.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm import rolling
from caseloom.llm.common import LOWER, UPPER, cut_lineage, small_batches

WIDTH = 5
#: Register base, and the value of a register whose smallest point is 1.
BASE, MIDDLE = 1.001, 9000
#: Share of pairs at the threshold that no band finds, at most.
MISSED = 1e-6
#: Standard errors that an estimate may lie below the threshold.
MARGIN = 5.0
#: Members of one block, and pairs with one centre in one verification group.
BLOCK, GROUP = 256, 256


def plan(threshold: float) -> tuple[int, int]:
    """Registers in a band, and bands, for a similarity threshold."""
    rows = max(1, round(math.log(0.36) / math.log(threshold)))
    return rows, math.ceil(math.log(MISSED) / math.log(1 - threshold ** rows))


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a column: A-Z lowered, words between white space, five words each."""
    data, offsets = rolling.text_bytes(column)
    data = rolling.LOWERED[data]
    starts, ends, count = rolling.word_bounds(data, offsets)
    words = rolling.range_hashes(data, starts, ends)
    wide = rolling.window_hashes(words, WIDTH)
    out = []
    for a, b in zip(count[:-1].tolist(), count[1:].tolist()):
        if b - a >= WIDTH:
            out.append(np.unique(wide[a:b - WIDTH + 1]))
        elif b > a:
            # the whole short text, apart from all wide shingles
            out.append(rolling.mixed(rolling.window_hashes(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """uint16 registers, one row per set; an empty set has zeros.

    Each element has points at a rate of ``m``, each in a register drawn at random. Points are made in rising order, and only up
    to a limit by which all registers of the set are filled, so that a large set costs little more than its size.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    state = rolling.mixed(np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64))
    owner = np.repeat(np.arange(len(sets)), sizes)
    least = np.full(len(sets) * m, np.inf)
    limit = (math.log(m) + 2) / np.maximum(sizes, 1)
    step = np.uint64(0xD1B54A32D192ED03)
    state = rolling.mixed(state + step)
    at = -np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / m
    while len(state):
        due = at <= limit[owner]
        if not due.any():
            open_ = np.isinf(least.reshape(len(sets), m)).any(axis=1)
            limit[open_] *= 2
            stay = open_[owner]
            state, at, owner = state[stay], at[stay], owner[stay]
            continue
        index = np.flatnonzero(due)
        while len(index):
            s, t, o = state[index], at[index], owner[index]
            np.minimum.at(least, o * m + (rolling.mixed(s ^ step) % np.uint64(m)).astype(np.int64), t)
            s = rolling.mixed(s + step)
            t = t - np.log(((s >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / m
            state[index], at[index] = s, t
            index = index[t <= limit[o]]
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(least) / math.log(BASE)) + MIDDLE
    value[np.isinf(least)] = 0
    return np.clip(value, 0, 65535).astype(np.uint16).reshape(len(sets), m)


def may_reach(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the joint estimate of each pair of register rows may belong to a pair at the threshold.

    The likelihood of (larger, smaller, equal) is concave in the similarity, so its maximum lies above a value exactly when it
    rises there. The value is the threshold less ``MARGIN`` standard errors.
    """
    possible = 100 * np.minimum(nx, ny) >= threshold * 100 * np.maximum(nx, ny) - 1e-6
    low = threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / x.shape[1])
    more, less = (x > y).sum(axis=1), (x < y).sum(axis=1)
    same = x.shape[1] - more - less
    if low <= 2e-4:
        return possible
    u, v = nx / (nx + ny), ny / (nx + ny)
    rise = lambda z: -np.log1p(-np.clip(z, 1e-12, None) * (BASE - 1) / BASE) / math.log(BASE)

    def log_likelihood(j):
        a, b = rise(u - v * j), rise(v - u * j)
        return more * np.log(a) + less * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-12, None))

    return possible & (log_likelihood(low + 1e-4) >= log_likelihood(low - 1e-4))


def sketches(docs: DataFrame, m: int, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, row_hash`` (of the text)``, n_shingles, set_id`` (digest of the set; null if empty)``, sketch``."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1))
            rows = registers(sets, m)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None for s in sets], pa.binary()),
                pa.array([r.tobytes() if len(s) else None for r, s in zip(rows, sets)], pa.binary())], names=["doc_id", "row_hash", "n_shingles", "set_id", "sketch"])

    return docs.select(id_column, text_column, F.xxhash64(text_column)).mapInArrow(run, f"doc_id {kind}, row_hash bigint, n_shingles bigint, set_id binary, sketch binary")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), -1)


def _estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose estimate may reach the threshold."""
    left = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("_na"), F.col("sketch").alias("_sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("_nb"), F.col("sketch").alias("_sb"))
    possible = F.least("_na", "_nb") >= F.greatest("_na", "_nb") * F.lit(threshold) - 1e-6

    @F.pandas_udf("boolean")
    def near(sa: pd.Series, sb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        return pd.Series(may_reach(_matrix(sa), _matrix(sb), na.to_numpy(), nb.to_numpy(), threshold))

    return pairs.join(left, "a").join(right, "b").filter(possible).filter(near("_sa", "_sb", "_na", "_nb")).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on the full sets.

    The texts of all partners of a centre ``a`` follow the centre's text through a task; a centre with many partners is dealt
    out to several tasks, each with the centre's text.
    """
    schema = "a bigint, b bigint"
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("_parts"))
    centres = size.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("b"))
    members = pairs.join(size, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("_parts")).cast("int").alias("part"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, centre = None, None
        for batch in batches:
            sets, found = shingle_sets(batch.column("text")), []
            for a, part, b, own in zip(batch.column("a").to_pylist(), batch.column("part").to_pylist(), batch.column("b").to_pylist(), sets):
                if b is None:
                    held, centre = (a, part), own
                    continue
                assert held == (a, part)
                both = len(np.intersect1d(centre, own, assume_unique=True))
                if 100 * both >= percent * (len(centre) + len(own) - both):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

    # one join brings the texts of centres and partners alike
    rows = centres.unionByName(members).join(nodes.select("node", "doc_id", "row_hash"), "node").join(texts, ["doc_id", "row_hash"]).select("a", "part", "b", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(compare, schema)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the links (a, b). Minimum labels with pointer jumping."""
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("_near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        upper = lower.select(F.col("node").alias("_n"), F.col("label").alias("_jump"))
        moved = cut_lineage(lower.join(upper, lower["label"] == upper["_n"], "left").select("node", "_old", F.least("label", "_jump").alias("label")))
        changed = moved.filter("_old <> label").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            break
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("component"))


def _overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of some sets: products of 0/1 matrices, over slices of the elements that two sets share."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, index, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    pick = count[index] > 1
    column, owner = shared[index[pick]], owner[pick]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        i, j = np.searchsorted(column, [low, low + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[i:j], column[i:j] - low] = 1
        total += part @ part.T
    return total.astype(np.int64)


def _cross_links(members: DataFrame, threshold: float, percent: int, n: int) -> DataFrame:
    """Links (a, b) between different components of a bucket, as many as join what is linked, verified on the full sets.

    ``members``: key, node, component, n_shingles, sketch, text. A bucket is dealt into blocks of about ``BLOCK`` members, fewer
    if they are long, and each two blocks meet in one group. There the estimate tells which members have a possible partner in
    another component; their sets are intersected, and a link is returned only if it joins two components of the group.
    """
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / (BLOCK * 4000))).cast("int")
    sizes = members.groupBy("key").agg(size.alias("_blocks"))
    dealt = members.join(sizes, "key").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    dealt = dealt.select("key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "node", "component", "n_shingles", "sketch", "text")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node").sort_values("node", ignore_index=True)
        node, part, size = (frame[c].to_numpy() for c in ("node", "component", "n_shingles"))
        sketch = _matrix(frame["sketch"])
        possible = np.zeros((len(node), len(node)), bool)
        for k in range(len(node)):
            other = k + 1 + np.flatnonzero(part[k + 1:] != part[k])
            if len(other):
                possible[k, other] = may_reach(sketch[other], np.broadcast_to(sketch[k], (len(other), sketch.shape[1])), size[other], np.broadcast_to(size[k], len(other)), threshold)
        chosen = np.flatnonzero(possible.any(axis=0) | possible.any(axis=1))
        links = []
        if len(chosen):
            both = _overlaps(shingle_sets(pa.array(frame["text"].iloc[chosen], pa.string())))
            sizes_ = size[chosen]
            linked = possible[np.ix_(chosen, chosen)] & (100 * both >= percent * (sizes_[:, None] + sizes_[None, :] - both))
            label = {p: p for p in part.tolist()}

            def root(x):
                while label[x] != x:
                    label[x] = label[label[x]]
                    x = label[x]
                return x

            for x, y in zip(*np.nonzero(linked)):
                p, q = root(part[chosen[x]]), root(part[chosen[y]])
                if p != q:
                    label[max(p, q)] = min(p, q)
                    links.append((node[chosen[x]], node[chosen[y]]))
        return pd.DataFrame({"a": [x for x, _ in links], "b": [y for _, y in links]}, dtype="int64")

    return dealt.repartition(n, "key", "i", "j").groupBy("key", "i", "j").applyInPandas(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets; ``component_id`` is the
    smallest id reachable over links. Null, empty and blank texts have no shingles and are linked with nothing; a text under
    five words is one shingle; very long texts are sketched and compared whole. Ids are whole numbers. Rows that share an id are
    judged by their own text: with equal sets they are one document, with different ones each has its own links. A row with a
    null id takes the component of the rows with the same set and never stands for it; ``component_id`` is null if no such row
    has an id. Other columns are not read; an empty table gives an empty result.
    """
    return _classified(docs, percent, id_column, text_column).drop("row_hash")


def _classified(docs: DataFrame, percent: int, id_column: str, text_column: str) -> DataFrame:
    """``near_duplicates`` with ``row_hash``, the hash of the row's text."""
    threshold = percent / 100
    rows, bands = plan(threshold)
    base = cut_lineage(sketches(docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")), rows * bands, "doc_id", "text"))
    # a node is a set; its number is its own, as an id may come with several sets
    nodes = cut_lineage(base.filter("doc_id IS NOT NULL AND set_id IS NOT NULL").groupBy("set_id").agg(F.min(F.struct("doc_id", "row_hash", "n_shingles", "sketch")).alias("_s"))
                        .select("set_id", F.monotonically_increasing_id().alias("node"), "_s.doc_id", "_s.row_hash", "_s.n_shingles", "_s.sketch"))
    key: Column = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("sketch", i * (2 * rows) + 1, F.lit(2 * rows))))
    banded = nodes.select("node", F.explode(key).alias("key"))
    centres = banded.groupBy("key").agg(F.min("node").alias("_centre"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    members = cut_lineage(banded.join(centres, "key"))
    texts = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(text_column).alias("row_hash"), F.coalesce(text_column, F.lit("")).alias("text"))
    stars = members.filter("node <> _centre").select(F.col("_centre").alias("a"), F.col("node").alias("b")).distinct()
    first = cut_lineage(_verified(cut_lineage(_estimated(stars, nodes, threshold)), nodes, texts, percent).distinct())
    known = cut_lineage(components(nodes, first))
    labelled = members.select("key", "node").join(known, "node")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low <> _high").select("key")
    open_ = labelled.join(mixed, "key").join(nodes.select("node", "doc_id", "row_hash", "n_shingles", "sketch"), "node").join(texts, ["doc_id", "row_hash"])
    second = cut_lineage(_cross_links(open_, threshold, percent, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    final = nodes.select("set_id", "node", "doc_id").join(components(nodes, first.union(second)), "node")
    names = final.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = final.join(names, "component").select(F.col("set_id").alias("_set"), "component_id")
    joined = base.select("doc_id", "row_hash", "n_shingles", "set_id").join(classes, F.col("set_id") == F.col("_set"), "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "row_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_copies(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stand for their group of near-duplicates, with all their columns."""
    dropped = _classified(docs.select(id_column, text_column), percent, id_column, text_column).filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), "row_hash").distinct()
    return docs.join(dropped, docs[id_column].eqNullSafe(dropped["_id"]) & (F.xxhash64(docs[text_column]) == dropped["row_hash"]), "left_anti")


def oracle(percent: int) -> str:
    """Links by counting shared shingles, components by their transitive closure."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {WIDTH} THEN list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS l FROM w),
s AS (SELECT doc_id, unnest(l) AS s FROM l), n AS (SELECT doc_id, CAST(len(l) AS BIGINT) AS n FROM l),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= {percent} * (a.n + b.n - k)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(c, n.doc_id)) AS component_id, n.doc_id <= coalesce(c, n.doc_id) AS kept FROM n LEFT JOIN c USING (doc_id)"""
