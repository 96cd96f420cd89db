"""Hierarchical Pitman-Yor language model, trained and applied on Spark.

A restaurant per context (the word before) seats the words that follow it; every table it opens is a customer of the parent
restaurant of single words, which all contexts share; the parent's base is uniform over the known words and one unknown. Table
counts are sampled by Gibbs re-seating, and the predictive probabilities of several samples are averaged.

Every context word has a restaurant of its own, and every word its dish in the parent.

How the work is dealt: words with at least ``1 / FREQUENT`` of all training tokens are frequent (there are at most ``FREQUENT``
of them, so their table is broadcast); all others are rare. A token is dealt by what it has to meet:

* after a frequent word: by the token's word if that is rare, by word and context if both are frequent,
* a frequent word after a rare one: by the context,
* a rare word after a rare one: by the word.

So a bucket holds whole (context, word) dishes and whole rare words. What frequent words need from other buckets are sums of fixed
size, the tables of each frequent context and of each frequent word, which the driver adds and broadcasts. The restaurant of a
rare context lies in its own bucket but for the rare words after it: those buckets send their share of its customers and tables
to the context's bucket, which returns the sums to them. All this happens once, for all samples.

While it samples, a bucket sees the rest of a restaurant as an enlarged copy of its own share (buckets are dealt by hash), and
re-seats one customer of every dish at a time. The size of a rare context is known in its own bucket; where only rare words after
it meet, the size to expect for a rare context of its hash class stands in. Afterwards the exact sums are exchanged, so that
predictions are proper. Sampling is seeded per bucket, and its tables are stored for the scoring pass.
"""

from __future__ import annotations

import gc
import hashlib
import json
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import rolling
from caseloom.llm.anchors import _bucket, _buckets, _dealt
from caseloom.llm.common import cut_lineage, small_batches

#: Most frequent words, and classes of the rare ones, by hash, for which the size to expect is known everywhere.
FREQUENT, SHARED = 60_000, 4096
CONTEXTS = FREQUENT + SHARED
#: Discount and strength of the context restaurants and of the parent.
DISCOUNT, STRENGTH, PARENT_DISCOUNT, PARENT_STRENGTH = 0.75, 1.0, 0.75, 1.0
#: Re-seatings of each dish before the first sample and between samples; samples.
BURN_IN, BETWEEN, SAMPLES = 12, 4, 3
#: The end of a text, as a word; also the context of the first word.
END = rolling.mixed(np.array([0x5EED], np.uint64))[0]
HELD = np.uint16(1 << 15)
#: Different words that a task holds before it sends their counts.
HELD_WORDS = 1 << 21
#: Kinds of rows that buckets receive. Tokens: after a frequent word, of a frequent word after a rare one, of rare words after rare ones.
AFTER_FREQUENT, FREQUENT_AFTER_RARE, RARE_AFTER_RARE, TEXTS, TABLES, SHARES, COUNTS, SUMS = range(8)
ROW = "bucket int, kind int, a binary, b binary, c binary, d binary, e binary"


class Tokens:
    """Word hashes of a batch with an end after each text, the word before each, and the text's place in the batch."""

    def __init__(self, column: pa.Array):
        data, offsets = rolling.text_bytes(column)
        data = rolling.LOWERED[data]
        starts, ends, count = rolling.word_bounds(data, offsets)
        words = rolling.range_hashes(data, starts, ends)
        self.n = np.diff(count) + 1
        self.word = np.insert(words, count[1:], END)
        self.before = np.concatenate([[END], self.word[:-1]]) if len(self.word) else self.word
        self.doc = np.repeat(np.arange(len(column), dtype=np.int32), self.n)


def _packed(bucket: list[int], *columns: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], names=["bucket", *"abcdef"[:len(columns)]])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (bucket, kind, up to five binaries)."""
    columns = list(zip(*[(*r, *[b""] * (7 - len(r))) for r in rows])) or [()] * 7
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "kind", *"abcde"])


def _small(values: np.ndarray, rising: bool = False) -> bytes:
    """Numbers with few different high bytes, byte by byte of all; ``rising``: sorted, as differences."""
    values = np.diff(values, prepend=values.dtype.type(0)) if rising else np.ascontiguousarray(values)
    raw = values.reshape(-1).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _large(packed: bytes, kind, rising: bool = False) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(packed[8:], size, "zstd", asbytes=True), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
    return np.cumsum(values, dtype=kind) if rising else values


def _joined(parts: list[bytes], kind, rising: bool = False) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[_large(x, kind, rising) for x in parts]])


def _add(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    different, back = np.unique(words, return_inverse=True)
    return different, np.bincount(back, counts, len(different)).astype(np.int64)


def word_counts(docs: DataFrame, n: int) -> DataFrame:
    """(bucket, words, counts) of the training texts, exact, one row per bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def send():
            order, bounds = _dealt(_bucket(words, n), n)
            parts = [order[bounds[k]:bounds[k + 1]] for k in range(n)]
            return _packed([k for k, p in enumerate(parts) if len(p)], [words[p].tobytes() for p in parts if len(p)], [counts[p].astype(np.uint32).tobytes() for p in parts if len(p)])

        for batch in batches:
            tokens = Tokens(batch.column("text"))
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            new = np.unique(tokens.word[~held[tokens.doc]], return_counts=True)
            words, counts = _add(np.concatenate([words, new[0]]), np.concatenate([counts, new[1]]))
            if len(words) > HELD_WORDS:
                yield send()
                words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(words):
            yield send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, words, counts = None, [], []
        for batch in batches:
            for k, w, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                bucket = k
                words.append(np.frombuffer(w, np.uint64))
                counts.append(np.frombuffer(c, np.uint32))
        if words:
            w, c = _add(np.concatenate(words), np.concatenate(counts))
            yield _packed([bucket], [w.tobytes()], [c.tobytes()])

    sent = docs.mapInArrow(count, "bucket int, a binary, b binary")
    return sent.repartitionById(n, "bucket").mapInArrow(merge, "bucket int, a binary, b binary")


class Frequent:
    """What every task knows: totals, the frequent words with their counts, and the size of each context: that of a frequent
    word, or ``shared``, the size to expect for a rare word of a class."""

    def __init__(self, n_tokens: int, n_words: int, words: np.ndarray, counts: np.ndarray, shared: np.ndarray):
        order = np.argsort(words)
        self.n_tokens, self.n_words = n_tokens, n_words
        self.words, self.counts = words[order], counts[order]
        self.context_size = np.zeros(CONTEXTS, np.int64)
        self.context_size[:len(words)] = self.counts
        self.context_size[FREQUENT:] = shared

    def number(self, words: np.ndarray) -> np.ndarray:
        """Number of each frequent word, -1 for others."""
        if not len(self.words):
            return np.full(len(words), -1, np.int32)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1).astype(np.int32)
        at[self.words[at] != words] = -1
        return at

    def context(self, words: np.ndarray) -> np.ndarray:
        own = self.number(words)
        return np.where(own >= 0, own, FREQUENT + (words % np.uint64(SHARED)).astype(np.int32))


def learn_frequent(totals: DataFrame) -> Frequent:
    """Totals and frequent words from the stored ``word_counts``. At most ``FREQUENT`` words can have that share of the tokens, so
    what reaches the driver is bounded: two numbers per bucket, the frequent words, and for each class of rare words the sums that
    give the size of the restaurant of a token's context (large ones hold more tokens)."""
    def sizes(batches):
        for batch in batches:
            for w, c in zip(*(batch.column(i).to_pylist() for i in (1, 2))):
                c = np.frombuffer(c, np.int64)
                yield _frame([int(c.sum())], [len(c)])

    def _frame(tokens, words):
        return pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(words, pa.int64())], names=["tokens", "words"])

    first = totals.mapInArrow(sizes, "tokens bigint, words bigint").agg(F.sum("tokens"), F.sum("words")).first()
    n_tokens, n_words = first[0] or 0, first[1] or 0

    def split(batches):
        for batch in batches:
            for w, c in zip(*(batch.column(i).to_pylist() for i in (1, 2))):
                w, c = np.frombuffer(w, np.uint64), np.frombuffer(c, np.int64)
                often = c * FREQUENT >= n_tokens
                of = (w[~often] % np.uint64(SHARED)).astype(np.int64)
                rare = c[~often].astype(np.float64)
                key = np.concatenate([w[often].astype(np.int64), np.arange(2 * SHARED)])
                n = np.concatenate([c[often], np.bincount(of, rare, SHARED), np.bincount(of, rare * rare, SHARED)])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([True, False], [int(often.sum()), 2 * SHARED])), pa.array(key, pa.int64()), pa.array(n, pa.float64())], names=["often", "key", "n"])

    # counts are whole numbers below 2 ** 53
    rows = totals.mapInArrow(split, "often boolean, key bigint, n double").groupBy("often", "key").agg(F.sum("n").alias("n")).collect()
    often = [r for r in rows if r.often]
    sums = np.zeros(2 * SHARED)
    for r in rows:
        if not r.often:
            sums[r.key] = r.n
    shared = np.rint(sums[SHARED:] / np.maximum(sums[:SHARED], 1)).astype(np.int64)
    return Frequent(n_tokens, n_words, np.array([r.key for r in often], np.int64).astype(np.uint64), np.array([r.n for r in often], np.float64).astype(np.int64), shared)


def _dishes(tokens: Tokens, known: Frequent, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each token's word and of its context (-1: rare), kind, and bucket."""
    number = known.number(tokens.word)
    context = np.concatenate([known.number(tokens.before[:1]), number[:-1]])
    kind = np.where(context >= 0, AFTER_FREQUENT, np.where(number >= 0, FREQUENT_AFTER_RARE, RARE_AFTER_RARE))
    spread = np.where(kind == FREQUENT_AFTER_RARE, tokens.before, tokens.word)
    both = (number >= 0) & (context >= 0)
    spread[both] = rolling.mixed(spread[both] ^ (context[both].astype(np.uint64) * rolling.BASE))
    return number, context, kind, _bucket(spread, n).astype(np.uint32)


def _chunks(docs: DataFrame, known, n: int, scoring: bool) -> DataFrame:
    """Rows of a batch for each bucket and kind of token: what it is dealt by (sorted, as runs), and the other one of word and context,
    as number if it is frequent. For scoring all tokens with their texts, and a row per batch with the texts' ids, lengths and
    sides; for training the different dishes of the training texts with counts. Rare words after rare ones come with count 0
    from the texts held out, as their buckets need to hear of the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, batch in enumerate(batches):
            tokens = Tokens(batch.column("text"))
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            number, context, kind, bucket = _dishes(tokens, known.value, n)
            word, before, doc = tokens.word, tokens.before, tokens.doc
            train = ~held[doc]
            slot = bucket * np.uint32(3) + kind.astype(np.uint32)
            if not scoring:
                wanted = train | (kind == RARE_AFTER_RARE)
                number, context, slot, word, before, doc, train = (x[wanted] for x in (number, context, slot, word, before, doc, train))
            order, bounds = _dealt(slot, 3 * n)
            key = int.from_bytes(hashlib.sha256(f"{TaskContext.get().partitionId()}/{turn}".encode()).digest()[:8], "big", signed=True)
            meta, rows = np.array([key, len(tokens.n)], np.int64).tobytes(), []
            if scoring:
                ids = json.dumps(batch.column("doc_id").to_pylist()).encode()
                rows.append((key % n, TEXTS, ids, tokens.n.astype(np.int64).tobytes(), held.astype(np.uint8).tobytes(), b"", meta))
            for k in range(3 * n):
                o = order[bounds[k]:bounds[k + 1]]
                if not len(o):
                    continue
                # dealt by the word or the context, with the other
                by, other, packed = ((word, context, np.uint16), (before, number, np.uint16), (word, before, np.uint64))[k % 3]
                if scoring:
                    o = o[np.argsort(by[o], kind="stable")]
                    own, with_, extra = by[o], other[o], doc[o].astype(np.uint16) | np.where(held[doc[o]], HELD, 0).astype(np.uint16)
                else:
                    # different dishes, with counts
                    o = o[np.lexsort((other[o], by[o]))]
                    own, with_ = by[o], other[o]
                    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (with_[1:] != with_[:-1])]))
                    own, with_, extra = own[first], with_[first], np.add.reduceat(train[o].astype(np.uint32), first).astype(np.uint32)
                start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                with_ = with_.astype(packed)
                rows.append((k // 3, k % 3, _small(own[start], True), _small(np.diff(np.append(start, len(own))).astype(np.uint32)), with_.tobytes() if packed is np.uint64 else _small(with_), _small(extra), meta))
            yield _rows(rows)

    return docs.mapInArrow(run, ROW)


def tables_of(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Sampled numbers of tables after seating ``customers`` of a dish one after the other, when a new table weighs ``weight``
    against ``customers - discount * tables``.

    The chance ``p`` of a new table never rises while only customers are seated. So the next one who may open a table is drawn
    from the geometric distribution of ``p``, and opens it with the chance at that place over ``p``: the same distribution as a
    draw for every customer, in about as many steps as tables are opened.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    live = np.flatnonzero(customers > 1)
    total, new = customers[live].astype(np.int64), np.asarray(weight, np.float64)[live]
    seated, opened = np.ones(len(live), np.int64), np.ones(len(live), np.int64)
    while len(live):
        p = new / (new + seated - discount * opened)
        skipped = np.minimum(rng.geometric(p) - 1, total - seated)
        seated += skipped
        # past the last customer nobody is left to open a table
        opened += (seated < total) & (rng.random(len(live)) * p * (new + seated - discount * opened) < new)
        seated += 1
        going = seated < total
        if not going.all():
            tables[live[~going]] = opened[~going]
            live, total, new, seated, opened = (x[going] for x in (live, total, new, seated, opened))
    return tables


class Seating:
    """The dishes of one bucket: words (sorted), contexts, customers; samples their tables.

    ``sizes``: customers of each context, by its number here. ``words``: if given, ``word`` holds places among them, not words.
    """

    def __init__(self, bucket: int, word: np.ndarray, context: np.ndarray, count: np.ndarray, known: Frequent, sizes: np.ndarray | None = None, words: np.ndarray | None = None):
        self.known, self.sizes = known, known.context_size if sizes is None else sizes
        self.wide = len(self.sizes)
        if words is None:
            words, word = np.unique(word, return_inverse=True)
        self.words = words
        index = word.astype(np.int64)
        index *= self.wide
        index += context
        order = np.argsort(index, kind="stable")
        index = index[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(index)), bool), index[1:] != index[:-1]]))
        self.key = index[first]
        self.count = np.add.reduceat(count[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        del index, order
        self.word, self.context = self.key // self.wide, self.key % self.wide
        self.word_count = np.bincount(self.word, self.count, len(self.words)).astype(np.int64)
        self.number = known.number(self.words)
        often = self.number >= 0
        self.full_count = np.where(often, known.counts[np.maximum(self.number, 0)] if len(known.counts) else 0, self.word_count)
        self.rng = np.random.default_rng([bucket, 20])

    def samples(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each sample: tables per dish, and parent customers and tables per word of this bucket.

        For a frequent word, parent customers are this bucket's share and parent tables are left at 0: its tables are drawn when
        the shares have been added.
        """
        known, rng = self.known, self.rng
        local_context = np.bincount(self.context, self.count, self.wide)
        grow_context = self.sizes / np.maximum(local_context, 1)
        grow_word = self.full_count / np.maximum(self.word_count, 1)
        grow = known.n_tokens / max(1, int(self.count.sum()))
        many = np.flatnonzero(self.count > 1)
        tables = np.ones(len(self.count), np.int64)

        def weights(of):
            """Weight of a new table for each dish: (strength + discount * tables of the context) * parent's probability."""
            t_context = np.bincount(self.context, tables, self.wide) * grow_context
            t_word = np.bincount(self.word, tables, len(self.words)) * grow_word
            total = tables.sum() * grow
            p = (np.maximum(t_word - PARENT_DISCOUNT * np.minimum(t_word, 2), 0.25) + (PARENT_STRENGTH + PARENT_DISCOUNT * known.n_words) / (known.n_words + 1)) / (PARENT_STRENGTH + total)
            return (STRENGTH + DISCOUNT * t_context[self.context[of]]) * p[self.word[of]]

        tables[many] = tables_of(self.count[many], weights(many), DISCOUNT, rng)
        rounds = BURN_IN + BETWEEN * SAMPLES
        room = np.minimum(self.count[many], tables[many] + rounds)
        offset = np.cumsum(room) - room
        size = np.zeros(int(room.sum()), np.int64)
        t, c = tables[many], self.count[many]
        # at first all tables but the first seat one
        place = np.arange(len(size)) - np.repeat(offset, room)
        size[place < np.repeat(t, room)] = 1
        size[offset] = c - t + 1
        last = offset + room
        weight = weights(many)
        for turn in range(rounds):
            if len(many):
                sums = np.cumsum(size)
                before = sums[offset] - size[offset]
                chosen = np.searchsorted(sums, before + np.floor(rng.random(len(many)) * c).astype(np.int64), "right")
                size[chosen] -= 1
                empty = size[chosen] == 0
                end = offset[empty] + t[empty] - 1
                size[chosen[empty]] = size[end]
                size[end] = 0
                t[empty] -= 1
                new = rng.random(len(many)) * (weight + c - 1 - DISCOUNT * t) < weight
                share = np.cumsum(np.maximum(size - DISCOUNT, 0) * (size > 0))
                low = share[offset] - np.maximum(size[offset] - DISCOUNT, 0) * (size[offset] > 0)
                pick = np.searchsorted(share, low + rng.random(len(many)) * (share[last - 1] - low), "right")
                pick = np.clip(pick, offset, offset + np.maximum(t - 1, 0))
                pick = np.where(new | (t == 0), offset + t, pick)
                t += new | (t == 0)
                size[pick] += 1
                tables[many] = t
            if turn + 1 >= BURN_IN and (turn + 1 - BURN_IN) % BETWEEN == 0 and turn + 1 > BURN_IN:
                customers = np.bincount(self.word, tables, len(self.words)).astype(np.int64)
                weight0 = np.full(len(self.words), (PARENT_STRENGTH + PARENT_DISCOUNT * known.n_words) / (known.n_words + 1))
                own = np.where(self.number >= 0, 0, tables_of(customers, weight0, PARENT_DISCOUNT, rng))
                yield tables.astype(np.int32), customers, own
            if (turn + 1) % BETWEEN == 0:
                weight = weights(many)


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, dict[int, list[list]]]:
    """The bucket, and the five columns of its rows of each kind."""
    bucket, held = None, {kind: [[], [], [], [], []] for kind in range(8)}
    for batch in batches:
        if batch.num_rows:
            bucket = batch.column("bucket")[0].as_py()
        for kind, *parts in zip(*(batch.column(name).to_pylist() for name in ("kind", *"abcde"))):
            for column, part in zip(held[kind], parts):
                column.append(part)
    return bucket, held


class Dealt:
    """The tokens of a bucket: words and rare contexts (both sorted), and for each token the place of its word, its context (the
    number of a frequent one, or ``FREQUENT`` and the place of a rare one), and what its rows say of it."""

    def __init__(self, held: dict[int, list[list]], known: Frequent, extra):
        own, runs, other = [], [], []
        for kind, form in ((AFTER_FREQUENT, np.uint16), (FREQUENT_AFTER_RARE, np.uint16), (RARE_AFTER_RARE, np.uint64)):
            a, b, c = held[kind][:3]
            own.append(_joined(a, np.uint64, True))
            runs.append(_joined(b, np.uint32))
            other.append(np.frombuffer(b"".join(c), form) if kind == RARE_AFTER_RARE else _joined(c, form))
        here = np.flatnonzero(np.bincount(other[1], minlength=FREQUENT)) if len(other[1]) else np.zeros(0, np.int64)
        self.words = np.unique(np.concatenate([own[0], own[2], known.words[here]]))
        self.rare = np.unique(np.concatenate([own[1], other[2]]))
        frequent = np.zeros(FREQUENT, np.int32)
        frequent[here] = np.searchsorted(self.words, known.words[here])
        place = lambda found, among: np.searchsorted(among, found).astype(np.int32)
        self.word = np.concatenate([np.repeat(place(own[0], self.words), runs[0]), frequent[other[1]], np.repeat(place(own[2], self.words), runs[2])])
        self.context = np.concatenate([other[0].astype(np.int32), FREQUENT + np.repeat(place(own[1], self.rare), runs[1]), FREQUENT + place(other[2], self.rare)])
        kinds = (AFTER_FREQUENT, FREQUENT_AFTER_RARE, RARE_AFTER_RARE)
        said = [_large(x, extra) for kind in kinds for x in held[kind][3]]
        self.extra, self.lengths = np.concatenate([np.zeros(0, extra), *said]), np.array([len(x) for x in said], np.int64)
        self.meta = np.frombuffer(b"".join(x for kind in kinds for x in held[kind][4]), np.int64).reshape(-1, 2)
        for kind in kinds:
            held[kind].clear()


def _looked_up(wanted: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values (last axis) of the wanted keys, 0 where there is none. ``keys`` are sorted."""
    if not len(keys):
        return np.zeros((*values.shape[:-1], len(wanted)), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[..., at], 0)


#: Tokens that are scored at once; bounds memory only.
SCORED = 1 << 18
#: Entries in one row of the exchanged sums.
BLOCK = 4096


def exchange(docs: DataFrame, totals: DataFrame, known: Frequent, shared, n: int) -> tuple[list[dict], DataFrame]:
    """Per sample: tables of each frequent context, parent customers of each frequent word, all parent customers, parent tables of
    rare words. And stored rows for the buckets: tables that they sampled, and shares of rare contexts for the contexts' buckets.

    Each bucket sends arrays of fixed size; they are added in tasks, block by block, before the driver gets the sums.
    """
    wide = CONTEXTS + FREQUENT + 2
    blocks = -(-wide // BLOCK)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = _gathered(batches)
        if bucket is None:
            return
        dealt = Dealt(held, shared.value, np.uint32)
        # sizes of the rare contexts: known in their own bucket, which is not sent those of 1
        counted, size = _joined(held[COUNTS][0], np.uint64, True), _joined(held[COUNTS][1], np.uint32)
        size = np.maximum(_looked_up(dealt.rare, counted, size).astype(np.int64), 1)
        held.clear()
        train = dealt.extra > 0
        word, context, count = dealt.word[train], dealt.context[train], dealt.extra[train]
        n_rare = np.bincount(context[context >= FREQUENT] - FREQUENT, count[context >= FREQUENT], len(dealt.rare)).astype(np.int64)
        expected = shared.value.context_size[FREQUENT + (dealt.rare % np.uint64(SHARED)).astype(np.int64)]
        sizes = np.concatenate([shared.value.context_size[:FREQUENT], np.where(_bucket(dealt.rare, n) == bucket, size, np.maximum(n_rare, expected))])
        seating = Seating(bucket, word, context, count, shared.value, sizes, dealt.words)
        often = seating.number >= 0
        kept, t_rare = [], np.zeros((SAMPLES, len(dealt.rare)), np.uint32)
        for s, (tables, customers, own) in enumerate(seating.samples()):
            kept.append((tables, customers, own))
            t_context = np.bincount(seating.context, tables, seating.wide).astype(np.int64)
            t_rare[s] = t_context[FREQUENT:]
            sums = np.zeros(blocks * BLOCK, np.int64)
            sums[:FREQUENT] = t_context[:FREQUENT]
            sums[CONTEXTS + seating.number[often]] = customers[often]
            sums[wide - 2], sums[wide - 1] = customers.sum(), own.sum()
            # zeros are not sent
            used = [b for b in range(blocks) if sums[b * BLOCK:(b + 1) * BLOCK].any()]
            yield _rows([(s * blocks + b, SUMS, _small(sums[b * BLOCK:(b + 1) * BLOCK])) for b in used])
        # one table is the rule
        tables, customers, own = (np.array(x, np.int32) for x in zip(*kept))
        dish = np.flatnonzero((tables > 1).any(axis=0))
        parent = np.flatnonzero((own != np.minimum(customers, ~often)).any(axis=0))
        yield _rows([(bucket, TABLES, _small(dish.astype(np.uint32)), _small(tables[:, dish]), seating.words[parent].tobytes(), _small(own[:, parent]))])
        bounds = np.searchsorted(_bucket(dealt.rare, n), np.arange(n + 1, dtype=np.uint64))
        source = bucket.to_bytes(4, "little")
        # mostly zeros: customers without a table of their own
        more = n_rare.astype(np.uint32) - t_rare
        yield _rows([(k, SHARES, _small(dealt.rare[i:j], True), _small(n_rare[i:j].astype(np.uint32)), _small(more[:, i:j]), source) for k, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if j > i])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, sums in zip(batch.column("bucket").to_pylist(), batch.column("a").to_pylist()):
                sums = _large(sums, np.int64)
                total[key] = total[key] + sums if key in total else sums
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["key", "sums"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, w, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                w, c = np.frombuffer(w, np.uint64), np.frombuffer(c, np.int64)
                rare = (c > 1) & (c * FREQUENT < known_tokens)
                yield _rows([(k, COUNTS, _small(w[rare], True), _small(c[rare].astype(np.uint32)))])

    known_tokens = known.n_tokens
    counts = totals.mapInArrow(repeated, ROW)
    sent = cut_lineage(_chunks(docs, shared, n, False).unionByName(counts).repartitionById(n, "bucket").mapInArrow(sample, ROW))
    rows = sent.filter(F.col("kind") == SUMS).repartition(min(n, SAMPLES * blocks), "bucket").mapInArrow(add, "key int, sums binary").collect()
    out = []
    for s in range(SAMPLES):
        sums = np.zeros(blocks * BLOCK, np.int64)
        for row in rows:
            if row.key // blocks == s:
                b = row.key % blocks
                sums[b * BLOCK:(b + 1) * BLOCK] = np.frombuffer(row.sums, np.int64)
        customers = sums[CONTEXTS:CONTEXTS + FREQUENT]
        weight = np.full(FREQUENT, (PARENT_STRENGTH + PARENT_DISCOUNT * known.n_words) / (known.n_words + 1))
        tables = tables_of(customers, weight, PARENT_DISCOUNT, np.random.default_rng([s, 21]))
        out.append({"context_tables": sums[:FREQUENT], "customers": customers, "tables": tables, "all_customers": int(sums[wide - 2]), "all_tables": int(sums[wide - 1] + tables.sum())})
    return out, sent.filter(F.col("kind") != SUMS)


def _let_go(spark) -> None:
    """Free the shuffle files of the steps that are stored, before those of the next come. A plan is let go when Python collects its
    cycles, of which the driver hears within a second; then it can collect the plan itself."""
    gc.collect()
    time.sleep(2)
    spark._jvm.System.gc()


def rare_contexts(sent: DataFrame, n: int) -> DataFrame:
    """Customers and tables of rare contexts, added up in the context's bucket, for each bucket that has a share of them, which
    knows them by their order. The context's own bucket gets all, by name, since texts held out may bring it a context that only
    other buckets have met."""

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = _gathered(batches)
        if bucket is None:
            return
        parts, sizes, more, sources = held[SHARES][:4]
        parts = [_large(x, np.uint64, True) for x in parts]
        contexts, back = np.unique(np.concatenate(parts), return_inverse=True)
        add = lambda values: np.bincount(back, values, len(contexts)).astype(np.uint32)
        size = add(_joined(sizes, np.uint32))
        more = np.array([add(np.concatenate([_large(x, np.uint32).reshape(SAMPLES, -1)[s] for x in more])) for s in range(SAMPLES)])
        ends, own = np.cumsum([len(x) for x in parts]), bucket.to_bytes(4, "little")
        yield _rows([(bucket, SHARES, _small(contexts, True), _small(size), _small(more), own)])
        for part, end, source in zip(parts, ends.tolist(), sources):
            to, at = int.from_bytes(source, "little"), back[end - len(part):end]
            if to != bucket:
                yield _rows([(to, SHARES, b"", _small(size[at]), _small(more[:, at]), own)])

    return sent.filter(F.col("kind") == SHARES).repartitionById(n, "bucket").mapInArrow(home, ROW)


def probabilities(seating: Seating, samples, states: list, word: np.ndarray | None, context: np.ndarray, index: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Averaged predictive probability of each (word, context), and the word's training count. ``states``: the seating's samples.
    ``index``: the words' places in the seating, in place of ``word``, if all are there."""
    known, context = seating.known, context.astype(np.int64)
    if index is None:
        index = np.searchsorted(seating.words, word)
        index = np.where((index < len(seating.words)) & (seating.words[np.minimum(index, max(len(seating.words) - 1, 0))] == word) if len(seating.words) else False, index, -1)
        number = known.number(word)
    else:
        number = seating.number[index]
    local = seating.full_count[np.maximum(index, 0)] if len(seating.words) else np.zeros(len(context), np.int64)
    count = np.where(number >= 0, known.counts[np.maximum(number, 0)] if len(known.counts) else 0, np.where(index >= 0, local, 0))
    wanted = index.astype(np.int64) * seating.wide + context
    at = np.minimum(np.searchsorted(seating.key, wanted), max(len(seating.key) - 1, 0))
    met = (seating.key[at] == wanted) & (index >= 0) if len(seating.key) else np.zeros(len(context), bool)
    customers_here = np.where(met, seating.count[at], 0) if len(seating.key) else np.zeros(len(context), np.int64)
    total = np.zeros(len(context))
    for s, (tables, customers, own) in zip(samples, states):
        often = np.maximum(number, 0)
        c_word = np.where(number >= 0, s["customers"][often], np.where(index >= 0, customers[np.maximum(index, 0)], 0) if len(customers) else 0)
        t_word = np.where(number >= 0, s["tables"][often], np.where(index >= 0, own[np.maximum(index, 0)], 0) if len(own) else 0)
        p = (c_word - PARENT_DISCOUNT * t_word + (PARENT_STRENGTH + PARENT_DISCOUNT * s["all_tables"]) / (known.n_words + 1)) / (PARENT_STRENGTH + s["all_customers"])
        t_dish = np.where(met, tables[at], 0) if len(tables) else np.zeros(len(context), np.int64)
        t_context, c_context = s["context_tables"][context], seating.sizes[context]
        # a context without customers leaves all to the parent
        total += (customers_here - DISCOUNT * t_dish + (STRENGTH + DISCOUNT * t_context) * p) / (STRENGTH + c_context)
    return total / len(samples), count


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    A row is held out when crc32 of its id as text (null: empty) leaves 0 modulo 10; all others train. A-Z are lowered; a text's
    tokens are its words, then one end. ``score`` is log10 of the averaged predictive probabilities, ``base_score`` that of
    counts with 0.1 added. Null, empty and blank texts have the end alone. Repeated rows count and are scored each. Other columns
    are not read; an empty table gives an empty result; without training texts every token is unknown.
    """
    spark = docs.sparkSession
    small_batches(spark, "8m")
    n = _buckets(spark)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    rows = rows.withColumn("held_out", F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 10 == 0)
    totals = cut_lineage(word_counts(rows, n))
    known = learn_frequent(totals)
    shared = spark.sparkContext.broadcast(known)
    sums, sent = exchange(rows, totals, known, shared, n)
    samples = spark.sparkContext.broadcast(sums)
    n_tokens, n_words = known.n_tokens, known.n_words

    def out(key: int, kind: int, *parts: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([kind], pa.int32()), *[pa.array([x], pa.binary()) for x in parts]], names=["batch", "kind", "a", "b", "c"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = _gathered(batches)
        if bucket is None:
            return
        # a batch's ids, on their way to its sums
        for a, b, c, _, e in zip(*held[TEXTS]):
            yield out(np.frombuffer(e, np.int64)[0], 0, a, b, c)
        dealt = Dealt(held, shared.value, np.uint16)
        if not len(dealt.word):
            return
        train = (dealt.extra & HELD) == 0
        # sizes and tables of the rare contexts; those of other buckets are the ones of which this bucket sent its share
        size, t_rare = np.zeros(len(dealt.rare), np.int64), np.zeros((SAMPLES, len(dealt.rare)), np.int64)
        bounds = np.searchsorted(_bucket(dealt.rare, n), np.arange(n + 1, dtype=np.uint64))
        for contexts, customers, more, source in zip(*held[SHARES][:4]):
            source = int.from_bytes(source, "little")
            own = slice(bounds[source], bounds[source + 1])
            customers = _large(customers, np.uint32).astype(np.int64)
            tables = customers - _large(more, np.uint32).reshape(SAMPLES, -1)
            if contexts:
                contexts = _large(contexts, np.uint64, True)
                customers, tables = (_looked_up(dealt.rare[own], contexts, x) for x in (customers, tables))
            size[own], t_rare[:, own] = customers, tables
        sizes = np.concatenate([shared.value.context_size[:FREQUENT], size])
        seating = Seating(bucket, dealt.word[train], dealt.context[train], np.ones(int(train.sum()), np.int64), shared.value, sizes, dealt.words)
        # tables as sampled
        dish, tables = np.zeros(0, np.uint32), np.zeros((SAMPLES, 0), np.int32)
        parent, own = np.zeros(0, np.uint64), np.zeros((SAMPLES, 0), np.int32)
        for a, b, c, d in zip(*held[TABLES][:4]):
            dish, tables = _large(a, np.uint32), _large(b, np.int32).reshape(SAMPLES, -1)
            parent, own = np.frombuffer(c, np.uint64), _large(d, np.int32).reshape(SAMPLES, -1)
        held.clear()
        parent = np.searchsorted(dealt.words, parent)
        states, here = [], []
        for s, sample in enumerate(samples.value):
            t = np.ones(len(seating.count), np.int32)
            t[dish] = tables[s]
            customers = np.bincount(seating.word, t, len(seating.words)).astype(np.int64)
            drawn = np.minimum(customers, seating.number < 0)
            drawn[parent] = own[s]
            states.append((t, customers, drawn))
            here.append({**sample, "context_tables": np.concatenate([sample["context_tables"], t_rare[s]])})
        keys, one, batch = np.unique(dealt.meta[:, 0], return_index=True, return_inverse=True)
        docs_ = dealt.meta[one, 1]
        first = np.cumsum(docs_) - docs_
        place = np.repeat(first[batch].astype(np.int32), dealt.lengths)
        size = int(docs_.sum())
        base, own, seen = np.zeros(size), np.zeros(size), np.zeros(size, np.uint32)
        for at in range(0, len(dealt.word), SCORED):
            part = slice(at, at + SCORED)
            p, count = probabilities(seating, here, states, None, dealt.context[part], dealt.word[part])
            where = place[part] + (dealt.extra[part] & ~HELD)
            base += np.bincount(where, np.log10((count + 0.1) / (n_tokens + 0.1 * (n_words + 1))), size)
            own += np.bincount(where, np.log10(p), size)
            seen += np.bincount(where, count > 0, size).astype(np.uint32)
        for key, a, some in zip(keys.tolist(), first.tolist(), docs_.tolist()):
            yield out(key, 1, *[x[a:a + some].tobytes() for x in (base, own, seen)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head, sums = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["batch"] != key:
                    if key is not None:
                        yield _sums(head, sums)
                    key, head, sums = row["batch"], row, [0, 0, 0]
                    continue
                sums = [s + np.frombuffer(row[c], kind) for s, c, kind in zip(sums, "abc", (np.float64, np.float64, np.uint32))]
        if key is not None:
            yield _sums(head, sums)

    learnt = sent.filter(F.col("kind") == TABLES).unionByName(cut_lineage(rare_contexts(sent, n)))
    _let_go(spark)
    chunks = _chunks(rows, shared, n, True).unionByName(learnt).repartitionById(n, "bucket")
    parts = chunks.mapInArrow(apply, "batch bigint, kind int, a binary, b binary, c binary")
    added = parts.repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(add, "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return added.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("bigint").alias("train_tokens"),
                        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def _sums(head: dict, sums: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of one batch of texts. Every text has an end, so every batch has sums."""
    ids = [None if i is None else str(i) for i in json.loads(head["a"])]
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.string()), pa.array(np.frombuffer(head["c"], np.uint8).astype(bool)), pa.array(np.frombuffer(head["b"], np.int64)),
        pa.array(sums[2].astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
