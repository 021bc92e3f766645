"""Vectorised text kernels over Arrow string buffers.

A batch of documents is one UTF-8 buffer with offsets.  Words are found, hashed and combined for the whole
buffer at once, so that the cost per document is a few array slots and not a Python loop.  A word is a run
of ASCII letters, ASCII digits and non-ASCII characters; callers lower-case beforehand where they wish.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
WORD = np.zeros(256, bool)
for _a, _z in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD[_a:_z] = True
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INV = U64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(30))
    h *= _M1
    h ^= h >> U64(27)
    h *= _M2
    h ^= h >> U64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        m = max(n, CHUNK + 1)
        for i, base in enumerate((_BASE, _INV)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _pow[i] = np.multiply.accumulate(x)
    return _pow[0][:n], _pow[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32, n + 1, column.offset * (8 if large else 4)).astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive groups of whole documents of about ``size`` bytes."""
    raw, off = buffers(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """The words of a chunk: ``start``/``end`` byte positions, and ``off``, each document's slice of them."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, table: np.ndarray = WORD):
        n = len(raw)
        self.raw, self.byte_off = raw, off
        w = np.zeros(n + 1, bool)
        np.take(table, raw, out=w[:n])
        first = off[:-1][off[:-1] < n]
        begin = w[:n].copy()
        begin[1:] &= ~w[: n - 1]
        begin[first] = w[first]
        end = w[:n] & ~w[1:]
        last = first[first > 0] - 1
        end[last] = w[last]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.off = np.searchsorted(self.start, off)
        self.count = np.diff(self.off)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        up, down = powers(len(self.raw) + 1)
        total = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(_BYTE[self.raw] * up[:-1], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on; the last k-1 positions are missing."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    g = h[:m].copy()
    for j in range(1, k):
        g *= _BASE
        g += h[j : j + m]
    return mix(g)


def owners(off: np.ndarray) -> np.ndarray:
    """Document number of each word."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def starts_with_room(off: np.ndarray, k: int) -> np.ndarray:
    """Mask over words: do ``k`` words of the same document begin here?"""
    n = int(off[-1])
    ok = np.ones(n, bool)
    for j in range(1, k):
        at = off[1:] - j
        ok[at[(at >= off[:-1])]] = False
    return ok


def window_minima(g: np.ndarray, ok: np.ndarray, w: int) -> np.ndarray:
    """Positions of the minimum of each window of ``w`` hashes, without repetition, ascending.

    ``ok`` masks the positions at which w hashes of one document begin.  Equal hashes: the rightmost wins.
    """
    return chosen_minima(g, ok, w)[0]


def chosen_minima(g: np.ndarray, ok: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of window minima, where the first window that chooses each begins)."""
    m = len(g) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    best, at = g[:m].copy(), np.zeros(m, np.int32)
    for j in range(1, w):
        less = g[j : j + m] <= best
        np.copyto(best, g[j : j + m], where=less)
        np.copyto(at, j, where=less)
    keep = np.flatnonzero(ok[:m])
    at = keep + at[keep]  # ascending: a later window never chooses an earlier position
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    return at[new], keep[new]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array: ``counts[i]`` successive ``values`` in row i."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def fixed(values: np.ndarray) -> pa.Array:
    """A binary array: the bytes of each row of a matrix."""
    values = np.ascontiguousarray(values)
    size = values.dtype.itemsize * values.shape[1]
    off = np.arange(len(values) + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(values.tobytes())])


def scatter(key: np.ndarray, parts: int, columns: list[tuple[np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    """Rows (part, c0[], c1[], ...) that hold the entries of each part; ``key`` is a mixed hash of each entry.

    A shuffle then moves a few arrays in place of a row for each entry.
    """
    place = (((key >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    count = np.bincount(place, minlength=parts)
    used = np.flatnonzero(count)
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[lists(c[order], count[used], t) for c, t in columns]], ["part", *[f"c{i}" for i in range(len(columns))]])


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each part of a partition that is sorted by ``part``, the first column."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        part = b.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for lo, hi in zip(cut[:-1], cut[1:]):
            if hi > lo:
                if held and held[0].column(0)[0].as_py() != part[lo]:
                    yield held
                    held = []
                held.append(b.slice(lo, hi - lo))
    if held:
        yield held


def gather(batches: list[pa.RecordBatch], kinds: list[type]) -> list[np.ndarray]:
    """All entries of scattered rows, a column each."""
    found: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for b in batches:
        for have, c in zip(found, b.columns[1:]):
            have.append(c.flatten().to_numpy())
    return [np.concatenate(x) for x in found]
