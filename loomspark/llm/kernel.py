"""Small vectorised text helpers used inside Arrow tasks.

Words are runs of bytes outside ``\\x20\\x09-\\x0D``; these are single bytes in UTF-8, so cutting bytes
and cutting code points agree. Words and shingles are named by 64-bit hashes of their whole text.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_ROLL = U64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system: a worker that is used again does not keep its largest batch."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def sliced(batch: pa.RecordBatch, most: int = 2 << 20):
    """A batch in parts of about so many bytes, so that the other side needs no large buffers."""
    step = max(1, batch.num_rows * most // max(batch.nbytes, 1))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = np.array(x, dtype=U64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_EXACT = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]
_powers = {"n": 0, "up": None, "down": None}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    if _powers["n"] < n:
        n = max(n, CHUNK_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, b in (("up", _BASE), ("down", inverse)):
            p = np.full(n, b, dtype=U64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if not len(off):
        off = np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def chunks(off: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges of at most so many bytes, or one row: whole texts always stay together."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; data and off of one chunk, off[0] = 0."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = off[(off > 0) & (off < n)]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span; ``lower`` folds A-Z to a-z."""
    if not len(s):
        return np.zeros(0, U64)
    up, down = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((_LOWER if lower else _EXACT)[data] * up[: len(data)], out=total[1:])
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(U64))


def words(col: pa.Array, lower: bool = True):
    """For each chunk of rows: first row, row count, hash and row (counted in the chunk) of each word."""
    data, off = buffers(col)
    for i, j in chunks(off):
        part, own = data[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e, row = spans(part, own)
        yield i, j - i, hashes(part, s, e, lower), row


def sequences(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every run of k words inside one row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    acc = np.full(n, k, dtype=U64)
    for j in range(k):
        acc = acc * _ROLL + h[j : j + n]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(acc[at]), at


def shingles(h: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of the k-word shingles; a row with fewer words is one shingle."""
    out, at = sequences(h, row, k)
    own = row[at] if len(at) else np.zeros(0, np.int64)
    count = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, int)
    begin = np.cumsum(count) - count
    extra, extra_row = [], []
    for m in range(1, k):
        short = np.flatnonzero(count == m)
        if len(short):
            acc = np.full(len(short), m, dtype=U64)
            for j in range(m):
                acc = acc * _ROLL + h[begin[short] + j]
            extra.append(mix(acc))
            extra_row.append(short)
    if extra:
        out, own = np.concatenate([out, *extra]), np.concatenate([own, *extra_row])
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own


def sets(col: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) of every row of a string column."""
    for first, rows, h, row in words(col):
        out, own = shingles(h, row, rows, k)
        at = np.searchsorted(own, np.arange(rows + 1))
        for r in range(rows):
            x = out[at[r] : at[r + 1]]
            if len(x) > 1:
                x = np.sort(x)
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
            yield first + r, x
