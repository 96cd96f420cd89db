"""Removal of repeated word passages by fixed-block anchors.

Every text is cut into reference blocks of ``BLOCK`` words that don't overlap. A window of ``WINDOW = 2 * BLOCK - 1`` words holds
one of its own text's blocks in full, and when the window occurs elsewhere, so does that block, though at any offset: so all
rolling block-sized windows of all texts probe the index of reference blocks. Probes only have to be counted, and so travel as
packed arrays of 32 hash bits per bucket, without their places. Blocks that occur again are the hits.

A hit is then extended: the windows over it are compared by 64-bit fingerprints within buckets (again packed), which costs a
small share of the texts, and a run of repeated windows is a maximal exact repeat. False hits, from cut hashes, only cost time.
Hashes are taken of words, so white space doesn't count. Partitions grow with the data, and one repeated block or window sends
at most two entries per batch of documents to its bucket, however many documents hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import rolling
from caseloom.llm.common import cut_lineage, small_batches

WINDOW = 35
CUT = np.uint64(0xFFFFFFFF)


def _buckets(spark) -> int:
    """As many as shuffle partitions: a bucket is one task's work and is held in its memory, some bytes per word."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _dealt(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket (stable), and where each bucket begins."""
    order = np.argsort(bucket.astype(np.uint16 if n <= 65536 else np.uint32), kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1, dtype=np.uint64))


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = rolling.text_bytes(column)
    starts, ends, count = rolling.word_bounds(data, offsets)
    return rolling.range_hashes(data, starts, ends), count


def _at_most_twice(values: np.ndarray) -> np.ndarray:
    """The values, sorted, each once or twice."""
    values = np.sort(values)
    return values[np.concatenate([np.ones(min(2, len(values)), bool), values[2:] != values[:-2]])]


def _probes(rows: DataFrame, n: int, window: int, block: int) -> DataFrame:
    """One row per batch and bucket: cut hashes of the rolling windows, and of the reference blocks with their places.

    A block that the batch itself repeats is known to be a hit: its places go to a bucket of the batch, without a hash, so that a
    very common block does not gather its places in one task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, count = _words(batch.column("text"))
            ids = batch.column("row").to_numpy()
            rolled = rolling.window_hashes(words, block)
            place = np.arange(len(rolled))
            doc = np.searchsorted(count, place, "right") - 1
            inside = place + block <= count[doc + 1] if len(place) else np.zeros(0, bool)
            inside &= (count[1:] - count[:-1] >= window)[doc] if len(place) else True
            number = place - count[doc] if len(place) else place
            fixed = inside & (number % block == 0)
            probes = rolled[inside]
            order, bounds = _dealt(_bucket(probes, n), n)
            blocks, block_row, block_number = rolled[fixed], ids[doc[fixed]] if len(place) else np.zeros(0, np.int64), number[fixed] // block
            border, bbounds = _dealt(_bucket(blocks, n), n)
            packed, known = [[], [], [], [], []], []

            def put(*values):
                for column, v in zip(packed, values):
                    column.append(v)

            for k in range(n):
                p = probes[order[bounds[k]:bounds[k + 1]]] & CUT
                if not len(p):
                    continue
                p = _at_most_twice(p)
                b = border[bbounds[k]:bbounds[k + 1]]
                own = blocks[b] & CUT
                twice = np.searchsorted(p, own, "right") - np.searchsorted(p, own, "left") > 1
                known.append(b[twice])
                b, own = b[~twice], own[~twice]
                put(k, p.astype(np.uint32).tobytes(), own.astype(np.uint32).tobytes(), block_row[b].astype(np.int64).tobytes(), block_number[b].astype(np.int32).tobytes())
            known = np.concatenate(known) if known else np.zeros(0, np.int64)
            if len(known):
                put(int(ids[0]) % n, b"", b"", block_row[known].astype(np.int64).tobytes(), block_number[known].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(packed[0], pa.int32()), *[pa.array(c, pa.binary()) for c in packed[1:]]], names=["bucket", "probes", "blocks", "rows", "numbers"])

    return rows.mapInArrow(run, "bucket int, probes binary, blocks binary, rows binary, numbers binary")


def _joined(parts: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def _repeated(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values that occur twice or more."""
    values = np.sort(values)
    return np.unique(values[1:][values[1:] == values[:-1]])


def _found_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


PACKED = "home int, rows binary, runs binary, numbers binary"


def _by_home(n: int, rows: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Answers for many texts, packed into one row per home, the partition of ``n`` that a text's answers meet in.

    ``columns`` are numbers of 32 bits; those of a text stand together, column after column.
    """
    home = (rows.astype(np.uint64) % np.uint64(n)).astype(np.int64)
    order = np.lexsort((rows, home))
    rows, home = rows[order], home[order]
    bounds = np.searchsorted(home, np.arange(n + 1))
    packed: list[list] = [[], [], [], []]
    for k in range(n):
        a, b = bounds[k], bounds[k + 1]
        if a == b:
            continue
        own = rows[a:b]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        values = np.stack([c[order[a:b]] for c in columns]).astype(np.int32)
        for c, v in zip(packed, (k, own[first].tobytes(), np.diff(np.append(first, b - a)).astype(np.int32).tobytes(), values.tobytes())):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(packed[0], pa.int32()), *[pa.array(c, pa.binary()) for c in packed[1:]]], names=["home", "rows", "runs", "numbers"])


def _by_row(answers: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """(row, columns...): the answers of each text from all buckets, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, values = [np.zeros(0, np.int64)], [np.zeros((len(columns), 0), np.int32)]
        for batch in batches:
            for r, k, v in zip(*(batch.column(c).to_pylist() for c in ("rows", "runs", "numbers"))):
                rows.append(np.repeat(np.frombuffer(r, np.int64), np.frombuffer(k, np.int32)))
                values.append(np.frombuffer(v, np.int32).reshape(len(columns), -1))
        row, value = np.concatenate(rows), np.concatenate(values, axis=1)
        order = np.lexsort((value[0], row))
        row, value = row[order], value[:, order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(row))
        for at in range(0, len(first), 5000):
            part = slice(at, at + 5000)
            yield pa.RecordBatch.from_arrays([pa.array(row[first[part]], pa.int64()), *[pa.array([v[a:b].tobytes() for a, b in zip(first[part], ends[part])], pa.binary()) for v in value]], names=["row", *columns])

    return answers.repartitionById(n, "home").mapInArrow(run, "row bigint, " + ", ".join(f"{c} binary" for c in columns))


def _hits(probes: DataFrame, n: int) -> DataFrame:
    """(row, hits): reference blocks that occur again. One bucket per partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[], [], [], []]
        for batch in batches:
            for part in zip(*(batch.column(c).to_pylist() for c in ("probes", "blocks", "rows", "numbers"))):
                if part[0]:
                    for column, v in zip(held, part):
                        column.append(v)
                else:
                    yield _by_home(n, np.frombuffer(part[2], np.int64), np.frombuffer(part[3], np.int32))
        again = _repeated(_joined(held[0], np.uint32))
        hit = _found_in(_joined(held[1], np.uint32), again)
        if hit.any():
            yield _by_home(n, _joined(held[2], np.int64)[hit], _joined(held[3], np.int32)[hit])

    return _by_row(probes.mapInArrow(run, PACKED), n, ["hits"])


def _positions(column: pa.Array) -> list[np.ndarray]:
    """The packed numbers of each line."""
    return [np.frombuffer(v, np.int32) if v else np.zeros(0, np.int32) for v in column.to_pylist()]


def _covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in [start, start + width) for a start."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _windows(batch: pa.RecordBatch, window: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, row id and word number of every window over a hit."""
    words, count = _words(rolling.decompressed(batch.column("packed")))
    prints, ids, numbers = [], [], []
    rolled = rolling.window_hashes(words, window)
    for row, hits, a, b in zip(batch.column("row").to_pylist(), _positions(batch.column("hits")), count[:-1].tolist(), count[1:].tolist()):
        n = b - a - window + 1
        if n <= 0:
            continue
        # a window over block k begins at most window - block words before it
        begins = np.maximum(np.unique(hits).astype(np.int64) * block - (window - block), 0)
        near = np.flatnonzero(_covered(begins[begins < n], window - block + 1, n))
        prints.append(rolled[a + near])
        ids.append(np.full(len(near), row, np.int64))
        numbers.append(near)
    if not prints:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(prints), np.concatenate(ids), np.concatenate(numbers)


def _fingerprints(candidates: DataFrame, n: int, window: int, block: int) -> DataFrame:
    """One row per batch and bucket: fingerprints with row ids (as runs) and word numbers.

    Windows that the batch itself repeats are known to be repeated: their places go to a bucket of the batch, without
    fingerprints, and each fingerprint once, as ``seen``, to its own bucket.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, ids, numbers = _windows(batch, window, block)
            different, back, count = np.unique(prints, return_inverse=True, return_counts=True)
            twice = count[back] > 1
            seen = different[count > 1]
            packed = [[], [], [], [], [], []]

            def put(k, sent, of, witnesses):
                row = ids[of]
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
                for c, v in zip(packed, (k, sent.tobytes(), row[first].tobytes(), np.diff(np.append(first, len(row))).astype(np.int32).tobytes(), numbers[of].astype(np.int32).tobytes(), witnesses.tobytes())):
                    c.append(v)

            if twice.any():
                put(int(ids[0]) % n, seen[:0], np.flatnonzero(twice), seen[:0])
            single = np.flatnonzero(~twice)
            order, bounds = _dealt(_bucket(prints[single], n), n)
            sorder, sbounds = _dealt(_bucket(seen, n), n)
            for k in range(n):
                of, witnesses = single[order[bounds[k]:bounds[k + 1]]], seen[sorder[sbounds[k]:sbounds[k + 1]]]
                if len(of) or len(witnesses):
                    put(k, prints[of], of, witnesses)
            yield pa.RecordBatch.from_arrays([pa.array(packed[0], pa.int32()), *[pa.array(c, pa.binary()) for c in packed[1:]]], names=["bucket", "prints", "rows", "runs", "numbers", "seen"])

    return candidates.mapInArrow(run, "bucket int, prints binary, rows binary, runs binary, numbers binary, seen binary")


def _confirmed(fingerprints: DataFrame, n: int) -> DataFrame:
    """(row, repeats): windows whose fingerprint occurs twice or more. One bucket per partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[], [], [], [], []]
        for batch in batches:
            for part in zip(*(batch.column(c).to_pylist() for c in ("prints", "rows", "runs", "numbers", "seen"))):
                if part[0] or part[4]:
                    for column, v in zip(held, part):
                        column.append(v)
                else:
                    yield _by_home(n, np.repeat(np.frombuffer(part[1], np.int64), np.frombuffer(part[2], np.int32)), np.frombuffer(part[3], np.int32))
        prints = _joined(held[0], np.uint64)
        again = _found_in(prints, _repeated(np.concatenate([prints, _joined(held[4], np.uint64)])))
        if again.any():
            rows = np.repeat(_joined(held[1], np.int64), _joined(held[2], np.int32))
            yield _by_home(n, rows[again], _joined(held[3], np.int32)[again])

    return _by_row(fingerprints.mapInArrow(run, PACKED), n, ["repeats"])


RESULT = "n_words bigint, n_removed bigint, kept_sha256 string"


def _kept(rows: DataFrame, window: int, with_text: bool, carried: list[str]) -> DataFrame:
    """What is left of each text after removing the words under its repeated windows; without ``repeats``, the whole text."""
    marked = "repeats" in rows.columns
    rows = rows.select(*carried, *(["packed", "repeats"] if marked else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = rolling.text_bytes(rolling.decompressed(batch.column("packed")) if marked else batch.column("text"))
            starts, ends, count = rolling.word_bounds(data, offsets)
            marks = _positions(batch.column("repeats")) if marked else [None] * batch.num_rows
            raw = data.tobytes()
            totals, removed, texts = [], [], []
            for mark, a, b in zip(marks, count[:-1].tolist(), count[1:].tolist()):
                keep = np.arange(a, b)
                if mark is not None and len(mark):
                    keep = keep[~_covered(mark.astype(np.int64), window, b - a)]
                totals.append(b - a)
                removed.append(b - a - len(keep))
                texts.append(b" ".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist())]))
            out = [*[batch.column(c) for c in carried], pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            names = [*carried, "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out, names = [*out, pa.array([t.decode() for t in texts], pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    return rows.mapInArrow(run, f"{kinds}, {RESULT}" + (", kept_text string" if with_text else ""))


def compressed_texts(docs: DataFrame) -> DataFrame:
    """``row`` and ``packed``, the text compressed: for the one shuffle and the checkpoint of whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), rolling.compressed(batch.column("text"))], names=["row", "packed"])

    return docs.select("row", "text").mapInArrow(run, "row bigint, packed binary")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Texts (``row, packed, hits``, a checkpoint) with a hit, and their repeated windows (``row, repeats``: packed word numbers)."""
    n, block = _buckets(docs.sparkSession), (window + 1) // 2
    hits = _hits(_probes(docs, n, window, block).repartitionById(n, "bucket"), n)
    candidates = cut_lineage(compressed_texts(docs).join(hits, "row").select("row", "packed", "hits"))
    return candidates, _confirmed(_fingerprints(candidates, n, window, block).repartitionById(n, "bucket"), n)


def without_repeats(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256`` and, if asked for, ``kept_text``.

    A word is removed when a window of ``window`` words over it occurs anywhere else, in the same document too, be it overlapping.
    Windows are judged on the input. Words are runs of non-white space, compared as they are; kept words are joined by spaces.

    Null, empty and blank texts have no words. A text shorter than the window loses nothing. Rows are told apart by a 64-bit hash
    of id and text: rows repeated with both are occurrences of each other and lose all their windows. Null ids are ids like any
    other. Other columns are not read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession, "2m")
    named = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    named = named.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    candidates, repeats = repeated_windows(named.select("row", "text"), window)
    names = ["n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
    changed = _kept(candidates.select("row", "packed").join(repeats, "row"), window, with_text, ["row"]).dropDuplicates(["row"])
    changed = changed.select(F.col("row").alias("_row"), *[F.col(c).alias(f"_{c}") for c in names])
    # the results of whole texts need no shuffle of texts
    whole = _kept(named, window, with_text, ["doc_id", "row"])
    joined = whole.join(changed, F.col("row") == F.col("_row"), "left")
    return joined.select("doc_id", *[F.when(F.col("_row").isNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in names])


def oracle(window: int = WINDOW) -> str:
    return rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - {window - 2})) AS i, w FROM w WHERE len(w) >= {window}),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) AS h FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS i FROM r),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""
