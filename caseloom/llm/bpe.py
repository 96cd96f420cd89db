"""Byte-level BPE encoding by speculation and verification, and decoding.

A word is first cut greedily into the longest vocabulary entries. That cut equals the merge procedure's result exactly when
every adjacent pair of tokens is compatible, that is when no merge across their boundary would have come before the merges
that built them. All different adjacent pairs of a batch are tested at once with array operations; only words with an
incompatible pair are merged step by step. Words are remembered per Python worker in a bounded table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from caseloom.llm.common import slices, small_batches

#: The public split pattern of byte-level BPE; white space is Unicode's.
PATTERN = r""" ?\p{L}++|'(?:[stmd]|re|ve|ll)| ?\p{N}++| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Words and bytes of a word that a worker remembers at most; neither changes a result.
REMEMBERED, REMEMBERED_BYTES = 200_000, 64

#: Stands for a pair that no merge joins.
NEVER = (1 << 62, -1)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next code point from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(spare)}


class Vocabulary:
    """Token bytes, merge ranks and the compatibility test of one tokenizer file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        symbols = byte_symbols()
        raw = lambda token: bytes(symbols[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes = [b""] * self.size
        for token, i in self.ids.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.names = [str(i) for i in range(self.size)]
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            a, b = raw(a), raw(b)
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges[x, y] = (r, z)
            self.rank[z], self.left[z], self.right[z] = r, x, y
        codes = np.array([x * self.size + y for x, y in self.merges], np.int64)
        ranks = np.array([r for r, _ in self.merges.values()], np.int64)
        order = np.argsort(codes)
        self.codes, self.code_rank = codes[order], ranks[order]
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.pattern = regex.compile(PATTERN)
        # every beginning of an entry, with the entry's id or -1
        self.prefixes: dict[bytes, int] = {}
        for token, i in self.ids.items():
            for end in range(1, len(token)):
                self.prefixes.setdefault(token[:end], -1)
            self.prefixes[token] = i
        self.known: dict[str, tuple[int, ...]] = {}

    def greedy(self, word: bytes) -> list[int]:
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        out, at, end, look = [], 0, len(word), self.prefixes.get
        while at < end:
            found, cut, stop = -1, at, at + 1
            while stop <= end and (i := look(word[at:stop])) is not None:
                if i >= 0:
                    found, cut = i, stop
                stop += 1
            out.append(found)
            at = cut
        return out

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For arrays of tokens that stand side by side: whether merging their joint bytes yields these two again.

        Walks back in time over the symbols at the boundary: the right edge of the first token and the left edge of the
        second. A merge of the two edge symbols that comes before either is taken into its own token breaks the pair. Equal
        ranks are performed from left to right.
        """
        x, y = first.copy(), second.copy()
        never = np.iinfo(np.int64).max
        x_until, y_until = np.full(len(x), never), np.full(len(x), never)
        good = np.ones(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            a, b = x[live], y[live]
            code = a * self.size + b
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            joins = self.codes[at] == code
            when = self.code_rank[at]
            broken = joins & (when < x_until[live]) & (when <= y_until[live])
            good[live[broken]] = False
            ra, rb = self.rank[a], self.rank[b]
            back_x = ra > rb
            more = ~broken & (np.maximum(ra, rb) >= 0)
            i = live[more & back_x]
            x_until[i], x[i] = self.rank[x[i]], self.right[x[i]]
            i = live[more & ~back_x]
            y_until[i], y[i] = self.rank[y[i]], self.left[y[i]]
            live = live[more]
        return good

    def merged(self, word: bytes) -> list[int]:
        """The merge procedure itself: always the lowest rank, then the leftmost place."""
        return self._merged_short(word) if len(word) <= 48 else self._merged_long(word)

    def _merged_short(self, word: bytes) -> list[int]:
        """Looks through all pairs before each merge."""
        ids, merges = [self.ids[word[i:i + 1]] for i in range(len(word))], self.merges
        ranks = [merges.get(p, NEVER)[0] for p in zip(ids, ids[1:])]
        while ranks and (lowest := min(ranks)) < NEVER[0]:
            i = ranks.index(lowest)
            ids[i:i + 2] = [merges[ids[i], ids[i + 1]][1]]
            del ranks[i]
            if i:
                ranks[i - 1] = merges.get((ids[i - 1], ids[i]), NEVER)[0]
            if i < len(ranks):
                ranks[i] = merges.get((ids[i], ids[i + 1]), NEVER)[0]
        return ids

    def _merged_long(self, word: bytes) -> list[int]:
        """Keeps the pairs in a queue: n log n for words of any length."""
        ids = [self.ids[word[i:i + 1]] for i in range(len(word))]
        after, before, merges = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], self.merges
        queue = [(merges[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (ids[left], ids[right]) in merges:
                    heapq.heappush(queue, (merges[ids[left], ids[right]][0], left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Speculate for all words, verify all their different adjacent pairs together, merge the words that fail."""
        raw = [w.encode() for w in words]
        cuts = [self.greedy(w) for w in raw]
        lengths = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = np.fromiter(chain.from_iterable(cuts), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(cuts)), lengths)
        inside = owner[1:] == owner[:-1]
        pairs, where = np.unique(flat[:-1][inside] * self.size + flat[1:][inside], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)
        for k in np.unique(owner[1:][inside][~good[where]]).tolist():
            cuts[k] = self.merged(raw[k])
        return [tuple(c) for c in cuts]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The text's words, special tokens alone between them."""
        at = 0
        if any(t in text for t in self.special):
            for m in self.split.finditer(text):
                yield self.pattern.findall(text, at, m.start()) if at else self.pattern.findall(text[:m.start()])
                yield [m[0]]
                at = m.end()
            text = text[at:]
        yield self.pattern.findall(text)

    def _learned(self, words: list[str]) -> list[tuple[int, ...]]:
        """The codes of words not all of which are remembered; new ones are, until the table is full."""
        different = set(words)
        known = {w: c for w in different if (c := self.known.get(w)) is not None}
        missing = list(different - known.keys())
        fresh = dict(zip(missing, self.encode_words(missing)))
        room = max(0, REMEMBERED - len(self.known))
        self.known.update(islice(((w, c) for w, c in fresh.items() if len(w) <= REMEMBERED_BYTES), room))
        known.update(fresh)
        return list(map(known.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for words in self.pieces(text):
            if len(words) == 1 and words[0] in self.special:
                out.append(self.special[words[0]])
                continue
            try:
                codes = list(map(self.known.__getitem__, words))
            except KeyError:
                codes = self._learned(words)
            out.extend(chain.from_iterable(codes))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(content: bytes) -> Vocabulary:
    """One parsed vocabulary per Python worker and file."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(content)
    return _LOADED[key]


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def tokens(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``ids``, the token ids of the whole text. The tokenizer file (of fixed size) is broadcast.

    Null and empty text have no tokens. Strings of special tokens become these tokens. Any row order, repeated rows, null ids
    and an empty table are passed through; other columns are not read.
    """
    return _mapped(docs, tokenizer_path, id_column, text_column, lambda v, text, ids: {"ids": ids}, [("ids", pa.list_(pa.int32()))], "ids array<int>")


def encoded(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``decoded_sha256`` of the text made from the ids. Otherwise like ``tokens``."""
    def row(v, text, ids):
        return {"n_tokens": len(ids), "ids": ids, "decoded_sha256": hashlib.sha256(v.decode(ids).encode()).hexdigest()}
    fields = [("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())]
    return _mapped(docs, tokenizer_path, id_column, text_column, row, fields, "n_tokens bigint, ids array<int>, decoded_sha256 string")


def token_digests(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas), ``decoded_sha256``, ``n_bytes``.

    The decoded text is made from the ids alone. Nulls, repeats and empty tables as in ``tokens``.
    """
    def row(v, text, ids):
        decoded = v.decode(ids)
        return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(",".join(map(v.names.__getitem__, ids)).encode()).hexdigest(),
                "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest(), "n_bytes": len(text.encode())}
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_bytes", pa.int64())]
    return _mapped(docs, tokenizer_path, id_column, text_column, row, fields, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint")


def _mapped(docs, tokenizer_path, id_column, text_column, row, fields, schema):
    spark = docs.sparkSession
    small_batches(spark)
    content = spark.sparkContext.broadcast(_file(tokenizer_path))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(content.value)
        for batch in slices(batches, 1):
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                rows.append(row(v, text, v.encode(text)))
            columns = [pa.array([r[name] for r in rows], kind_) for name, kind_ in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *[name for name, _ in fields]])

    return docs.select(id_column, text_column).mapInArrow(run, f"doc_id {kind}, {schema}")
