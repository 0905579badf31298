"""Array kernels shared by the text operators.

Texts come in as Arrow string arrays; their UTF-8 bytes are read in place and
cut into chunks of bounded size, so that the arrays derived from them (eight
bytes a position) stay small whatever an Arrow batch holds.
"""

from __future__ import annotations

import ctypes
import sys
import types

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_C1, _C2, _C3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_MASK = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=U64)


def process_cache() -> dict:
    """A dict that lives as long as the Python worker, for tables built from constants."""
    home = sys.modules.setdefault("_lectern_cache", types.ModuleType("_lectern_cache"))
    return home.__dict__.setdefault("entries", {})


def trim() -> None:
    """Gives freed memory back to the system, so that idle Python workers stay small."""
    pa.default_memory_pool().release_unused()
    if (libc := process_cache().setdefault("libc", _libc())) is not None:
        libc.malloc_trim(0)


def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
    except OSError:
        return None
    return libc if hasattr(libc, "malloc_trim") else None


def text_chunks(column, limit: int = CHUNK_BYTES):
    """Yield (first row, bytes, offsets) of runs of rows; a null is an empty text.

    A run holds at most `limit` bytes unless one text alone is longer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = column.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if not n:
        return
    _, off_buf, data_buf = arr.buffers()
    offsets = np.frombuffer(off_buf, dtype=np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return data | (((data - np.uint8(65)) < 26).astype(np.uint8) << 5)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without \\x20 and \\x09-\\x0D), and the first word of each text.

    The third array has one entry more than there are texts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~((data == 32) | ((data - np.uint8(9)) < 5))
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(30))
    h *= _C2
    h ^= h >> U64(27)
    h *= _C3
    h ^= h >> U64(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step; every byte and the length count."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    h = mix(lengths.astype(U64) * _C1 + U64(seed))
    at, left, live = starts.astype(np.int64), lengths.astype(np.int64), None
    while len(at):
        v = lanes[at] & _MASK[np.minimum(left, 8)]
        if live is None:
            h = mix((h ^ v) * _C1 + v)
        else:
            h[live] = mix((h[live] ^ v) * _C1 + v)
        keep = np.flatnonzero(left > 8)
        live = keep if live is None else live[keep]
        at, left = at[keep] + 8, left[keep] - 8
    return h


def gram_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of n consecutive entries; the result is shorter by n - 1."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    acc = np.full(m, U64(seed + n), U64)
    for k in range(n):
        acc *= _C1
        acc += h[k : k + m]
    return mix(acc)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    m = len(values) - width + 1
    if m <= 0:
        return values[:0]
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[:m], out[width - span : width - span + m])
    return out[:m]


def text_shingle_sets(data, offsets, n: int):
    """For each text its sorted distinct hashes of n-word shingles.

    A text with fewer than n words gives its whole word sequence as one
    shingle, one without words gives an empty set.
    """
    starts, ends, first = word_bounds(data, offsets)
    wh = span_hashes(data, starts, ends - starts)
    grams = gram_hashes(wh, n)
    for k in range(len(offsets) - 1):
        a, b = int(first[k]), int(first[k + 1])
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield gram_hashes(wh[a:b], b - a)
        else:
            yield grams[:0]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
