"""Best-fit packing of tokenised documents into sequences, by linear grouping.

Lengths are whole numbers up to the capacity, so how many pieces have which length is a table of at most ``capacity`` rows,
however many documents there are. On this table the packing is planned: large lengths are rounded up within groups of equal
cardinality, a linear programme over the few rounded sizes says how often each configuration of them is used, actual lengths
take the places of the rounded ones, and the remaining and small ones go to the best-fitting sequences. The plan has at most
a few intervals per length. Pieces are then sorted by length, numbered, and each looks its place up by its number.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import cut_lineage, in_order, small_batches

CAPACITY, END = 2048, 0
#: Lengths over this share of the capacity are large; every share is planned and the fewest sequences win. With a half, large
#: pieces are alone and all others go to the best fit, so the plan never needs more than plain best fit by falling length.
SHARES = (1 / 4, 1 / 3, 1 / 2, 1 / 6)
#: Groups of equal cardinality.
GROUPS = 64
#: The public split pattern of the word tokenizer. Characters below the second value have the same class, lower case and composed
#: form in every version of Unicode, so chunks of them alone may be split here; others go through the library as they are.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
SIMPLE = "\u0130"
#: Chunks of text and bytes of a chunk that a worker remembers at most; neither changes a result.
REMEMBERED, REMEMBERED_BYTES = 400_000, 40

Class = tuple[int, tuple[tuple[int, int], ...]]


# --- tokens ----------------------------------------------------------------------------------------------------------

class Encoder:
    """Token ids as little-endian bytes. The tokenizer drops white space, so every chunk between ASCII blanks is encoded alone.

    Chunks and their words are remembered in tables of a bounded size, which start anew when they are full.
    """

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_buffer(content)
        self.library.no_truncation()
        self.library.no_padding()
        # The same merges alone, for words that are already normalised and split.
        self.merges = Tokenizer.from_buffer(content)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(PATTERN)
        self.known: dict[bytes, bytes] = {}
        self.known_words: dict[str, bytes] = {}

    def encode(self, text: bytes) -> bytes:
        # All letters of ASCII text are lower-cased by the tokenizer anyway; marks are found before that.
        if text.isascii() and b"<" not in text:
            text = text.lower()
        chunks = text.split()
        codes = list(map(self.known.get, chunks))
        if None in codes:
            at = [i for i, code in enumerate(codes) if code is None]
            fresh = self._codes_of({chunks[i] for i in at})
            if len(self.known) + len(fresh) > REMEMBERED:
                self.known.clear()
            self.known.update((c, code) for c, code in fresh.items() if len(c) <= REMEMBERED_BYTES)
            for i in at:
                codes[i] = fresh[chunks[i]]
        return b"".join(codes)

    def _codes_of(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        simple: dict[bytes, list[str]] = {}
        other = []
        for chunk in chunks:
            text = chunk.decode("utf-8", "replace")
            if (text.isascii() or max(text) < SIMPLE) and "<" not in text:
                core = text.rstrip(".,")
                simple[chunk] = [core.lower(), text[len(core):]] if core.isalpha() else self.pattern.findall(text.lower())
            else:
                other.append((chunk, text))
        code_of = self._words({w for words in simple.values() for w in words})
        found = {chunk: b"".join(map(code_of.__getitem__, words)) for chunk, words in simple.items()}
        found.update(zip((c for c, _ in other), _codes(self.library, [t for _, t in other])))
        return found

    def _words(self, words: set[str]) -> dict[str, bytes]:
        missing = list(words.difference(self.known_words))
        fresh = dict(zip(missing, _codes(self.merges, missing)))
        found = fresh | {w: self.known_words[w] for w in words.difference(fresh)}
        if len(self.known_words) + len(fresh) > REMEMBERED:
            self.known_words.clear()
        self.known_words.update((w, code) for w, code in fresh.items() if len(w) <= REMEMBERED_BYTES)
        return found


def _codes(tokenizer, texts: list[str]) -> list[bytes]:
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_LOADED: dict[str, Encoder] = {}


def _encoder(content: bytes) -> Encoder:
    key = hashlib.sha256(content).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Encoder(content)
    return _LOADED[key]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = True,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, with ``keep_ids``, ``ids`` (little-endian 32-bit).

    A document is the ids of its whole text and the end id, so null and empty texts have length 1. Only longer documents than
    the capacity are cut. Null ids, repeated rows and empty tables pass through; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_column].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value)
        for batch in batches:
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                codes = encoder.encode(text.as_py() or b"") + last
                for number, at in enumerate(range(0, len(codes), 4 * capacity)):
                    part = codes[at:at + 4 * capacity]
                    owner.append(row)
                    piece.append(number)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(part)
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.binary())] if keep_ids else [])], names=names)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if keep_ids else "")
    return docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("binary").alias("text")).mapInArrow(run, schema)


# --- the plan, on counts of lengths ----------------------------------------------------------------------------------

def grouped(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths with their counts, longest first, cut into groups of equal cardinality. Few lengths are groups of their own."""
    falling = sorted(counts.items(), reverse=True)
    if len(falling) <= groups:
        return [[run] for run in falling]
    total, out, filled = sum(counts.values()), [[]], 0
    for length, n in falling:
        while n:
            if filled >= -(-total * len(out) // groups):
                out.append([])
            take = min(n, -(-total * len(out) // groups) - filled)
            out[-1].append((length, take))
            filled, n = filled + take, n - take
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[float, np.ndarray]]:
    """How often to use which configuration of ``sizes`` (falling), so that few sequences hold the demand; a fractional solution.

    Column generation: from the prices of the sizes, a knapsack over the capacity finds the most valuable configuration, which
    enters the basis until none is worth more than a sequence.
    """
    m, s, d = len(sizes), np.array(sizes), np.array(demand, float)
    basis = np.diag(np.maximum(capacity // s, 1)).astype(float)
    amount = np.linalg.solve(basis, d)
    for _ in range(40 * m):
        price = np.linalg.solve(basis.T, np.ones(m))
        entering = _most_valuable(s, price, capacity)
        if price @ entering <= 1 + 1e-6:
            break
        direction = np.linalg.solve(basis, entering)
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, amount / np.where(up, direction, 1), np.inf)
        leaves = int(np.argmin(ratio))
        basis[:, leaves] = entering
        amount = np.maximum(np.linalg.solve(basis, d), 0)
    return [(float(x), basis[:, j].astype(int)) for j, x in enumerate(amount)]


def _most_valuable(sizes: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of greatest total price, by dynamic programming over one more item at a time."""
    useful = np.flatnonzero(price > 1e-12)
    value, choices = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        best, choice = value.copy(), np.full(capacity + 1, -1)
        for i in useful.tolist():
            size = int(sizes[i])
            offered = value[:capacity + 1 - size] + price[i]
            better = offered > best[size:] + 1e-12
            best[size:][better] = offered[better]
            choice[size:][better] = i
        if (choice < 0).all():
            break
        value = best
        choices.append(choice)
    out, left = np.zeros(len(sizes)), capacity
    for choice in reversed(choices):
        if (i := choice[left]) >= 0:
            out[i] += 1
            left -= int(sizes[i])
    return out


def substituted(counts: dict[int, int], capacity: int, groups: int) -> tuple[list[Class], dict[int, int]]:
    """Classes of alike sequences of large pieces, and the counts of pieces that no whole configuration took."""
    if not counts:
        return [], {}
    queues = [deque(g) for g in grouped(counts, groups)]
    sizes, demand = [q[0][0] for q in queues], [sum(n for _, n in q) for q in queues]
    # Groups that start with the same length are one size.
    merged: dict[int, int] = defaultdict(int)
    for size, n in zip(sizes, demand):
        merged[size] += n
    owner = {size: [q for q in queues if q[0][0] == size] for size in merged}
    own = {size: deque(run for q in owner[size] for run in q) for size in merged}
    falling = sorted(merged, reverse=True)
    left = dict(merged)
    classes: list[Class] = []
    for amount, configuration in configurations(falling, [merged[x] for x in falling], capacity):
        slots = [size for size, k in zip(falling, configuration.tolist()) for _ in range(k)]
        need = Counter(slots)
        times = min([int(amount + 1e-6), *(left[size] // k for size, k in need.items())])
        if not slots or times <= 0:
            continue
        runs = []
        for size in slots:
            runs.append(_taken(own[size], times))
            left[size] -= times
        classes += _side_by_side(runs)
    rest: dict[int, int] = defaultdict(int)
    for queue in own.values():
        for length, n in queue:
            rest[length] += n
    return classes, dict(rest)


def _taken(queue: deque[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    out = []
    while n:
        length, there = queue.popleft()
        take = min(n, there)
        out.append((length, take))
        if there > take:
            queue.appendleft((length, there - take))
        n -= take
    return out


def _side_by_side(runs: list[list[tuple[int, int]]]) -> list[Class]:
    """Sequences whose slots are filled by the given runs, alike neighbours together."""
    queues, out = [deque(r) for r in runs], []
    while queues[0]:
        n = min(q[0][1] for q in queues)
        out.append((n, tuple(Counter(q[0][0] for q in queues).items())))
        for q in queues:
            length, there = q.popleft()
            if there > n:
                q.appendleft((length, there - n))
    return out


def best_fit(classes: list[Class], counts: dict[int, int], capacity: int) -> list[Class]:
    """Put pieces, longest first, where the least room is left that still takes them; alike sequences are filled at once."""
    room: dict[int, list[Class]] = defaultdict(list)
    for n, content in classes:
        room[capacity - sum(length * k for length, k in content)].append((n, content))
    rooms = sorted(room)

    def put(left: int, item: Class) -> None:
        if not room[left]:
            insort(rooms, left)
        room[left].append(item)

    for length, n in sorted(counts.items(), reverse=True):
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, over = divmod(n, each)
                if full:
                    put(capacity - each * length, (full, ((length, each),)))
                if over:
                    put(capacity - over * length, (1, ((length, over),)))
                break
            left = rooms[at]
            there, content = room[left].pop()
            if not room[left]:
                del rooms[at]
            each = left // length
            full = min(there, n // each)
            over = n - full * each if full < there else 0
            if full:
                put(left - each * length, (full, (*content, (length, each))))
            if over:
                put(left - over * length, (1, (*content, (length, over))))
            if there > full + (over > 0):
                put(left, (there - full - (over > 0), content))
            n -= full * each + over
    return [item for items in room.values() for item in items]


def planned(counts: dict[int, int], capacity: int = CAPACITY, shares: tuple[float, ...] = SHARES, groups: int = GROUPS) -> list[Class]:
    """Classes of alike sequences: how many, and the lengths in each with their number."""
    full = [(counts[capacity], ((capacity, 1),))] if counts.get(capacity) else []
    cut = {x: n for x, n in counts.items() if x < capacity}
    fewest = -(-sum(x * n for x, n in cut.items()) // capacity)
    plans = []
    for share in shares:
        small = int(capacity * share)
        classes, rest = substituted({x: n for x, n in cut.items() if x > small}, capacity, groups)
        plans.append(best_fit(classes, rest | {x: n for x, n in cut.items() if x <= small}, capacity))
        if _number(plans[-1]) == fewest:
            break
    return full + min(plans, key=_number)


def _number(classes: list[Class]) -> int:
    return sum(n for n, _ in classes)


def intervals(classes: list[Class], counts: dict[int, int]) -> np.ndarray:
    """Rows (first piece, first sequence, pieces per sequence, first offset), pieces numbered by falling length.

    Inside a sequence lengths fall; a row holds the pieces of one length of one class.
    """
    first, before = {}, 0
    for length in sorted(counts, reverse=True):
        first[length] = before
        before += counts[length]
    rows, sequence = [], 0
    for n, content in classes:
        merged: dict[int, int] = defaultdict(int)
        for length, k in content:
            merged[length] += k
        offset = 0
        for length in sorted(merged, reverse=True):
            rows.append((first[length], sequence, merged[length], offset, length))
            first[length] += n * merged[length]
            offset += merged[length] * length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# --- on tables -------------------------------------------------------------------------------------------------------

def placed(parts: DataFrame, capacity: int = CAPACITY, shares: tuple[float, ...] = SHARES, groups: int = GROUPS) -> DataFrame:
    """``parts`` (stored rows with a ``length`` from 1 to the capacity) with ``sequence_id`` and ``offset``.

    Every row gets one place; offsets of a sequence leave no gap. A hot length is dealt over the tasks like any other rows.
    """
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.sparkContext.broadcast(intervals(planned(counts, capacity, shares, groups), counts))
    ordered, _ = in_order(parts, "_place", F.desc("length"))
    columns = parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, sequence, each, offset, length = table.value.T
        for batch in batches:
            number = batch.column(batch.num_columns - 1).to_numpy()
            at = np.searchsorted(first, number, side="right") - 1
            inside = number - first[at]
            found = [sequence[at] + inside // each[at], offset[at] + inside % each[at] * length[at]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found)], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return ordered.select(*columns, "_place").mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The pieces of all documents with their places. Odd rows as in ``pieces``; repeated rows are packed as often as they occur."""
    return placed(cut_lineage(pieces(docs, tokenizer_path, capacity, end, keep_ids, id_column, text_column)), capacity)


def sequences(docs: DataFrame, tokenizer_path: str, **parameters) -> DataFrame:
    """``sequence_id``, ``ids`` (array of at most ``capacity``) and ``doc_ids`` of the documents in it, in order."""
    rows = packed(docs, tokenizer_path, keep_ids=True, **parameters)
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in row.as_py()), "<u4") for row in batch.column(1)]
            owners = pa.array([[x["doc_id"] for x in row.as_py()] for row in batch.column(1)], pa.list_(batch.schema.field(1).type.value_type.field("doc_id").type))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), owners], names=["sequence_id", "ids", "doc_ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("sequence_id").agg(inside.alias("inside")).mapInArrow(run, f"sequence_id bigint, ids array<int>, doc_ids array<{kind}>")
