"""Array helpers over the bytes of many texts: word bounds, word hashes, rolling hashes. All arithmetic is modulo 2**64."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

#: Odd multiplier of the polynomial hash, and bytes whose powers are held at once.
BASE, SLICE = np.uint64(0x9E3779B97F4A7C15), 1 << 21
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: 1 for the white space between words.
IS_SPACE = np.zeros(256, np.uint8)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = 1
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); kept per worker up to the length of a slice."""
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, SLICE + 1), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if n <= SLICE + 1:
            _POWERS[int(base)] = held
    return held[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each row (and after the last)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = IS_SPACE[data] == 0
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    opens[inner] = solid[inner]
    starts = np.flatnonzero(opens)
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    closes[last] = solid[last]
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each range; starts and ends ascend. Works in slices, so that long texts need little memory."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * powers(BASE, high - low), out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * powers(INVERSE, high - low + 1)[s]
        i = j
    return mixed(out)


def window_hashes(items: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` values (already hashes); one fewer than ``width`` shorter than the input."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, doubled, size, done = np.zeros(n, np.uint64), items, 1, 0
    # runs of 1, 2, 4, ... values are put together from the halves; the bits of the width pick those that tile the window
    while done < width:
        if width & size:
            out = mixed(out * BASE + doubled[done:done + n])
            done += size
        if done < width:
            doubled = mixed(doubled[:-size] * BASE + doubled[size:])
        size *= 2
    return out


def compressed(column: pa.Array) -> pa.Array:
    """Each text by itself, for shuffles and checkpoints: long texts weigh about a third."""
    pack = zstandard.ZstdCompressor(level=3).compress
    return pa.array([pack(t) for t in column.fill_null("").cast(pa.binary()).to_pylist()], pa.binary())


def decompressed(column: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(t) for t in column.to_pylist()], pa.large_binary())
