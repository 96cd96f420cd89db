"""Removal of repeated byte strings with suffix arrays.

Where a ``WINDOW``-byte string occurs twice, both places hold the same ``GRAM``-byte strings, and so the same one of smallest
hash: its anchor. Only anchors (about one in 100 bytes) are counted over the corpus; windows whose anchor occurs once can't be
repeated. The others are cut out as regions, runs of windows with one anchor. Regions with equal bytes are one region, which is
repeated as a whole if it has two places. The different regions of an anchor go to one shard.

A shard sorts the suffixes of its regions by Larsson-Sadakane refinement (groups of equal prefix are sorted by the rank of the
suffix behind that prefix, which doubles the prefix, and only groups of more than one are touched again), finds the common
prefixes of neighbours with Kasai's recurrence, in step over all regions, and so knows which windows occur twice. An anchor with
very many different regions is dealt to several shards; each sends its different windows, in order, to a merge, where the arrays
of two shards are searched for each other's windows by bisection.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import rolling
from caseloom.llm.anchors import PACKED, _bucket, _buckets, _by_home, _by_row, _dealt, _joined, compressed_texts
from caseloom.llm.common import cut_lineage, small_batches

WINDOW, GRAM = 400, 160
#: Bytes of regions in a shard.
SHARD = 2 << 20


#: Places of one anchor up to which all its regions go to one shard.
TOGETHER = 4000
#: Common anchors up to which their list, counted first, is broadcast.
BROADCAST_ROWS = 100_000
LOW = np.uint64((1 << 32) - 1)


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` neighbours by their upper 32 bits, the first of equals: a choice that depends on
    the neighbours alone."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, size = (values & ~LOW) | np.arange(len(values), dtype=np.uint64), 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return (np.minimum(low[:n], low[width - size:width - size + n]) & LOW).astype(np.int64)


class Runs:
    """The runs of windows with one anchor, over all texts of a batch."""

    def __init__(self, column: pa.Array, window: int, gram: int):
        self.data, self.offsets = rolling.text_bytes(column)
        data, offsets = self.data, self.offsets
        begins = np.arange(max(0, len(data) - gram + 1))
        hashes = rolling.range_hashes(data, begins, begins + gram)
        anchor = smallest(hashes, window - gram + 1)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(anchor)]
        inside = np.arange(len(anchor)) + window <= offsets[doc + 1]
        first = inside.copy()
        first[1:] &= (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        self.start = np.flatnonzero(first)
        self.doc = doc[self.start]
        # the upper bits of an anchor are the smallest around it, so near zero: mixed again, for buckets of even size
        self.hash = rolling.mixed(hashes[anchor[self.start]])
        ends = np.minimum(np.append(self.start[1:], len(anchor)), offsets[self.doc + 1] - window + 1)
        self.windows = ends - self.start
        # number of each run within its text
        self.number = np.arange(len(self.start)) - np.searchsorted(self.doc, self.doc)


def _anchors(rows: DataFrame, n: int, window: int, gram: int) -> DataFrame:
    """One row per batch and bucket: cut anchor hashes with the row and number of their runs.

    Of an anchor with several places in a batch one (doubled) is sent to its bucket; the others are known to be hits and go
    to a bucket of the batch, so that a very common anchor does not gather its places in one task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = Runs(batch.column("text"), window, gram)
            ids = batch.column("row").to_numpy()
            _, first, back, count = np.unique(runs.hash, return_index=True, return_inverse=True, return_counts=True)
            lead = np.zeros(len(runs.hash), bool)
            lead[first] = True
            packed = [[], [], [], [], []]

            def put(bucket, hashes, of, known):
                for c, v in zip(packed, (bucket, hashes.astype(np.uint32).tobytes(), ids[runs.doc[of]].astype(np.int64).tobytes(), runs.number[of].astype(np.int32).tobytes(), known.astype(np.int32).tobytes())):
                    c.append(v)

            rest = np.flatnonzero(~lead)
            if len(rest):
                put(int(ids[0]) % n, np.zeros(0), rest, count[back[rest]])
            lead = np.flatnonzero(lead)
            order, bounds = _dealt(_bucket(runs.hash[lead], n), n)
            for k in range(n):
                of = lead[order[bounds[k]:bounds[k + 1]]]
                if len(of):
                    put(k, runs.hash[of] & LOW, of, count[back[of]])
            yield pa.RecordBatch.from_arrays([pa.array(packed[0], pa.int32()), *[pa.array(c, pa.binary()) for c in packed[1:]]], names=["bucket", "hashes", "rows", "numbers", "counts"])

    return rows.mapInArrow(run, "bucket int, hashes binary, rows binary, numbers binary, counts binary")


def _hits(anchors: DataFrame, n: int) -> DataFrame:
    """(row, numbers, counts): runs whose anchor has other places, with the number of places that the sender or bucket knows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[], [], [], []]
        for batch in batches:
            for part in zip(*(batch.column(c).to_pylist() for c in ("hashes", "rows", "numbers", "counts"))):
                if part[0]:
                    for c, v in zip(held, part):
                        c.append(v)
                else:
                    yield _by_home(n, np.frombuffer(part[1], np.int64), np.frombuffer(part[2], np.int32), np.frombuffer(part[3], np.int32))
        hashes, rows, numbers, counts = (_joined(c, k) for c, k in zip(held, (np.uint32, np.int64, np.int32, np.int32)))
        _, back = np.unique(hashes, return_inverse=True)
        total = np.bincount(back, counts).astype(np.int64)[back] if len(hashes) else np.zeros(0, np.int64)
        hit = total > 1
        if hit.any():
            yield _by_home(n, rows[hit], numbers[hit], np.minimum(total[hit], 2 ** 31 - 1).astype(np.int32))

    return _by_row(anchors.mapInArrow(run, PACKED), n, ["numbers", "counts"])


def _regions(candidates: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, region, count, places): the hit runs' bytes; equal ones of a batch once, with all places packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = Runs(rolling.decompressed(batch.column("packed")), window, gram)
            ids = batch.column("row").to_numpy()
            first = np.searchsorted(runs.doc, np.arange(batch.num_rows))
            last = np.searchsorted(runs.doc, np.arange(batch.num_rows), "right")
            raw, found = runs.data.tobytes(), {}
            for d, (numbers, counts) in enumerate(zip(batch.column("numbers").to_pylist(), batch.column("counts").to_pylist())):
                numbers, counts = np.frombuffer(numbers, np.int32), np.frombuffer(counts, np.int32)
                ok = numbers < last[d] - first[d]
                for k, places in zip((first[d] + numbers[ok]).tolist(), counts[ok].tolist()):
                    start, n = int(runs.start[k]), int(runs.windows[k])
                    region = raw[start:start + n + window - 1]
                    key = (int(runs.hash[k].astype(np.int64)), region)
                    found.setdefault(key, [places, []])[1].append((int(ids[d]), start - int(runs.offsets[d])))
            rows = [(anchor, region, places, np.array(at, np.int64).tobytes()) for (anchor, region), (places, at) in found.items()]
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.binary()))], names=["anchor", "region", "count", "places"])

    return candidates.mapInArrow(run, "anchor bigint, region binary, count bigint, places binary")


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``data`` sorted by their first ``depth`` bytes, and the 8 bytes at each place as a number.

    Larsson-Sadakane: a suffix's rank is the first slot of its group; a group is refined by the ranks behind the bytes that its
    members share; a group of one is left alone.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
    eight = np.zeros(n + depth, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k:k + n + depth]
    order = np.argsort(eight[:n], kind="stable")
    sorted_ = eight[order]
    slot = np.arange(n)
    first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if n else np.zeros(0, bool)
    rank = np.zeros(n + depth, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, slot, 0))
    shared = 8
    while shared < depth:
        step = min(shared, depth - shared)
        ranks = rank[order]
        single = first & np.concatenate([first[1:], [True]])
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        members = order[slots]
        behind = members + step
        key = (ranks[slots].astype(np.uint64) << np.uint64(32)) | np.where(behind < n, rank[np.minimum(behind, n)] + 1, 0).astype(np.uint64)
        again = np.argsort(key, kind="stable")
        key, members = key[again], members[again]
        opens = np.concatenate([[True], key[1:] != key[:-1]])
        order[slots] = members
        first[slots] = opens
        rank[members] = slots[np.maximum.accumulate(np.where(opens, np.arange(len(slots)), 0))]
        shared += step
    return order, eight


def common_prefixes(order: np.ndarray, eight: np.ndarray, starts: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts in suffix order, and the common prefix of each with the one before, up to ``depth``.

    Kasai's recurrence: the common prefix at the next place is at least one less, if the neighbour's next place is a window start
    too and still comes before (strings that agree up to ``depth`` may change sides). Regions (``counts`` windows from
    ``starts``) advance side by side.
    """
    is_start = np.zeros(len(order) + 1, bool)
    edge = np.zeros(len(order) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts, -1)
    is_start[:-1] = np.cumsum(edge[:-1]) > 0
    chosen = order[is_start[order]]
    before = np.full(len(order) + 1, -1, np.int64)
    before[chosen[1:]] = chosen[:-1]
    slot = np.empty(len(order) + 1, np.int64)
    slot[order], slot[-1] = np.arange(len(order)), len(order)
    common = np.zeros(len(order), np.int64)
    height = np.zeros(len(starts), np.int64)
    last = np.full(len(starts), -2, np.int64)
    live = np.arange(len(starts))
    for p in range(int(counts.max()) if len(counts) else 0):
        live = live[counts[live] > p]
        here = starts[live] + p
        other = before[here]
        carried = (last[live] >= 0) & is_start[last[live] + 1] & (slot[last[live] + 1] < slot[here]) & (other >= 0)
        h = np.where(carried, np.maximum(height[live] - 1, 0), 0)
        open_ = np.flatnonzero((other >= 0) & (h < depth))
        while len(open_):
            x = eight[here[open_] + h[open_]] ^ eight[other[open_] + h[open_]]
            equal = x == 0
            whole = np.full(len(open_), 8, np.int64)
            if not equal.all():
                y = x[~equal]
                whole[~equal] = sum((y < (np.uint64(1) << np.uint64(8 * k))).astype(np.int64) for k in range(1, 8))
            h[open_] += whole
            open_ = open_[equal & (h[open_] < depth)]
        h = np.minimum(h, depth)
        common[here], height[live], last[live] = h, h, other
    return chosen, common[chosen]


def repeated_in(regions: list[bytes], window: int) -> list[np.ndarray]:
    """For each region, which of its windows occur twice in the regions."""
    data = np.frombuffer(b"".join(regions), np.uint8)
    sizes = np.array([len(r) for r in regions], np.int64)
    starts, counts = np.cumsum(sizes) - sizes, sizes - window + 1
    order, eight = suffix_order(data, window)
    chosen, common = common_prefixes(order, eight, starts, counts, window)
    same = common >= window
    twice = np.zeros(len(data), bool)
    twice[chosen[same]] = True
    twice[chosen[:-1][same[1:]]] = True
    return [twice[a:a + n] for a, n in zip(starts.tolist(), counts.tolist())]


def _intervals(flags: np.ndarray) -> np.ndarray:
    """(first, last + 1) of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def _shards(regions: DataFrame, window: int, shard: int) -> DataFrame:
    """(row, spans): repeated windows by place; for anchors in several parts also (anchor, slice, prints, owners): their different windows.

    Rows come sorted by anchor and part. A shard takes whole (anchor, part) groups up to ``shard`` bytes. A group that is larger
    than that stays within one shard: ``TOGETHER`` bounds it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, size = None, [], 0
        merged: dict[bytes, list] = {}

        def close():
            for region, places in merged.items():
                held.append((group, region, np.concatenate(places)))
            merged.clear()

        for batch in batches:
            for anchor, part, parts, region, places in zip(*(batch.column(c).to_pylist() for c in ("anchor", "part", "parts", "region", "places"))):
                if (anchor, part, parts) != group:
                    close()
                    size = sum(len(h[1]) for h in held)
                    if size >= shard:
                        yield _shard_rows(held, window)
                        held.clear()
                    group = (anchor, part, parts)
                merged.setdefault(region, []).append(np.frombuffer(places, np.int64).reshape(-1, 2))
        close()
        if held:
            yield _shard_rows(held, window)

    return regions.mapInArrow(run, "row bigint, spans binary, anchor bigint, slice int, prints binary, owners binary")


def _shard_rows(held: list[tuple], window: int) -> pa.RecordBatch:
    several: dict[tuple, int] = {}
    for group, _, _ in held:
        several[group] = several.get(group, 0) + 1
    # an anchor's only region needs no order: it is repeated as a whole, or nowhere
    sorted_ = [k for k, (group, _, _) in enumerate(held) if several[group] > 1 or group[2] > 1]
    flags = dict(zip(sorted_, repeated_in([held[k][1] for k in sorted_], window) if sorted_ else []))
    rows, spans, out = [], [], [[], [], [], []]
    for k, (group, region, places) in enumerate(held):
        twice = np.ones(len(region) - window + 1, bool) if len(places) > 1 else flags.get(k)
        if twice is None:
            continue
        if group[2] > 1:
            begins = np.arange(len(region) - window + 1)
            prints = rolling.range_hashes(np.frombuffer(region, np.uint8), begins, begins + window)
            piece = (prints >> np.uint64(32)) % np.uint64(group[2])
            for p in np.unique(piece).tolist():
                own = piece == p
                # windows that are known to be repeated need no answer: no owner
                owner = np.where(twice[own], -1, places[0, 1] + begins[own])
                for c, v in zip(out, (group[0], p, prints[own].tobytes(), np.concatenate([[group[1], places[0, 0]], owner]).astype(np.int64).tobytes())):
                    c.append(v)
        found = _intervals(twice)
        if len(found):
            for row, start in places.tolist():
                rows.append(row)
                spans.append((found + start).astype(np.int32).tobytes())
    n, m = len(rows), len(out[0])
    return pa.RecordBatch.from_arrays([
        pa.array(rows + [None] * m, pa.int64()), pa.array(spans + [None] * m, pa.binary()), pa.array([None] * n + out[0], pa.int64()),
        pa.array([None] * n + out[1], pa.int32()), pa.array([None] * n + out[2], pa.binary()), pa.array([None] * n + out[3], pa.binary())],
        names=["row", "spans", "anchor", "slice", "prints", "owners"])


def _across(shards: DataFrame) -> DataFrame:
    """(row, spans): windows of anchors in several parts that occur in another part.

    Each part's windows are sorted, and searched for by bisection in the sorted windows of every later part of the slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for anchor, slice_, prints, owners in zip(*(batch.column(c).to_pylist() for c in ("anchor", "slice", "prints", "owners"))):
                if (anchor, slice_) != group:
                    if held:
                        yield _merge(held)
                    group, held = (anchor, slice_), []
                held.append((np.frombuffer(prints, np.uint64), np.frombuffer(owners, np.int64)))
        if held:
            yield _merge(held)

    return shards.mapInArrow(run, "row bigint, spans binary")


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    prints = np.concatenate([p for p, _ in held])
    part = np.concatenate([np.full(len(p), o[0]) for p, o in held])
    row = np.concatenate([np.full(len(p), o[1]) for p, o in held])
    at = np.concatenate([o[2:] for _, o in held])
    order = np.lexsort((part, prints))
    prints, part, row, at = prints[order], part[order], row[order], at[order]
    low, high = np.searchsorted(prints, prints, "left"), np.searchsorted(prints, prints, "right")
    # the parts of equal windows are in order, so the ends of their range tell whether there is more than one
    found = (part[low] != part[high - 1]) & (at >= 0)
    spans = [np.array([a, a + 1], np.int32).tobytes() for a in at[found].tolist()]
    return pa.RecordBatch.from_arrays([pa.array(row[found], pa.int64()), pa.array(spans, pa.binary())], names=["row", "spans"])


def _kept(rows: DataFrame, window: int, carried: list[str], with_bytes: bool) -> DataFrame:
    """What is left of each text after removing the bytes under its repeated windows; without ``spans``, the whole text."""
    marked = "spans" in rows.columns
    rows = rows.select(*carried, *(["packed", "spans"] if marked else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = rolling.text_bytes(rolling.decompressed(batch.column("packed")) if marked else batch.column("text"))
            lists = batch.column("spans").to_pylist() if marked else [None] * batch.num_rows
            found = []
            for spans, a, b in zip(lists, offsets[:-1].tolist(), offsets[1:].tolist()):
                own = data[a:b]
                if spans:
                    ends = np.frombuffer(b"".join(spans), np.int32).reshape(-1, 2).astype(np.int64)
                    edge = np.zeros(len(own) + 1, np.int64)
                    np.add.at(edge, ends[:, 0], 1)
                    np.add.at(edge, ends[:, 1] + window - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    left = own[~gone].tobytes()
                    found.append((len(own), int(gone.sum()), len(_intervals(gone)), hashlib.sha256(left).hexdigest(), left))
                else:
                    left = own.tobytes()
                    found.append((len(own), 0, 0, hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*found)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][:5 if with_bytes else 4]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[*carried, *NAMES[:len(kinds)]])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    return rows.mapInArrow(run, f"{kinds}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_bytes else ""))


NAMES = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text",
                    with_bytes: bool = False, shard: int = SHARD, together: int = TOGETHER) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept`` (bytes).

    A byte of the UTF-8 text is removed when a string of ``window`` bytes over it also starts anywhere else, in the same document
    too, be it overlapping; strings are judged on the input. ``n_spans`` counts maximal removed runs; what is left may cut a
    character. ``gram`` only decides how anchors are found, ``shard`` and ``together`` how work is dealt; none changes a result.

    Null and empty texts have no bytes. A text shorter than the window loses nothing. Rows are told apart by a 64-bit hash of id
    and text: rows repeated with both are occurrences of each other. Null ids are ids like any other. Other columns are not read;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark, "2m")
    n = _buckets(spark)
    named = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    named = named.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    texts = named.select("row", "text")
    hits = _hits(_anchors(texts, n, window, gram).repartitionById(n, "bucket"), n)
    candidates = cut_lineage(compressed_texts(texts).join(hits, "row").select("row", "packed", "numbers", "counts"))
    regions = _regions(candidates, window, gram)
    # an anchor is common by the largest count that any of its places was told; rare ones are not in this small table
    common = cut_lineage(regions.filter(F.col("count") > together).groupBy("anchor").agg(F.ceil(F.max("count") / together).cast("int").alias("parts")))
    dealt = regions.join(F.broadcast(common) if common.count() <= BROADCAST_ROWS else common, "anchor", "left").select("anchor", F.coalesce("parts", F.lit(1)).alias("parts"), "region", "places")
    dealt = dealt.select("anchor", F.pmod(F.xxhash64("region"), F.col("parts")).cast("int").alias("part"), "parts", "region", "places")
    shards = cut_lineage(_shards(dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part"), window, shard))
    across = _across(shards.filter("anchor IS NOT NULL").select("anchor", "slice", "prints", "owners").repartition("anchor", "slice").sortWithinPartitions("anchor", "slice"))
    spans = shards.filter("row IS NOT NULL").select("row", "spans").union(across).groupBy("row").agg(F.collect_list("spans").alias("spans"))
    names = NAMES[:5 if with_bytes else 4]
    changed = _kept(candidates.select("row", "packed").join(spans, "row"), window, ["row"], with_bytes).dropDuplicates(["row"])
    changed = changed.select(F.col("row").alias("_row"), *[F.col(c).alias(f"_{c}") for c in names])
    # the results of whole texts need no shuffle of texts
    joined = _kept(named, window, ["doc_id", "row"], with_bytes).join(changed, F.col("row") == F.col("_row"), "left")
    return joined.select("doc_id", *[F.when(F.col("_row").isNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in names])


def oracle(window: int = WINDOW) -> str:
    """Bytes as pairs of hexadecimal digits."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - {window - 1})) AS i FROM d WHERE len(x) >= {2 * window}),
h AS (SELECT doc_id, i, md5(x[2 * i + 1:2 * i + {2 * window}]) AS h FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {window} THEN 0 ELSE 1 END AS opens FROM r),
g AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s),
q AS (SELECT doc_id, g, min(i) AS a, max(i) + {window} AS b FROM g GROUP BY 1, 2),
l AS (SELECT doc_id, list(a ORDER BY a) AS la, list(b ORDER BY a) AS lb, sum(b - a) AS n, count(*) AS spans FROM q GROUP BY 1)
SELECT d.doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN la IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(la) + 1), lambda j:
    x[CASE WHEN j = 0 THEN 1 ELSE 2 * lb[j] + 1 END:CASE WHEN j = len(la) THEN len(x) ELSE 2 * la[j + 1] END]), '') END)) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)"""
