"""Vectorised word and shingle hashing over Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = mix((np.arange(256, dtype=_U) + _U(1)) * _U(0xD6E8FEB86659FD93))
_cache: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("p", ())) < n:
        size = max(n, BLOCK + (1 << 16))
        _cache["p"], _cache["q"] = _powers(_BASE, size), _powers(_UNBASE, size)
    return _cache["p"], _cache["q"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n+1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(column: pa.Array, rows: int = 2000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of at most ``rows`` rows with about ``BLOCK`` bytes of text; a longer text stands alone."""
    sizes = np.diff(buffers(column)[1])
    group = (np.cumsum(sizes) - sizes) // BLOCK
    at = 0
    for end in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]:
        while at < end:
            yield at, min(at + rows, end)
            at = min(at + rows, end)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, and the n+1 bounds of each row's words.

    Works block by block, so a very long text needs no more memory than its words.
    """
    hashes, starts_all = [], []
    at, end = 0, len(data)
    mark = np.zeros(end + 1, bool)
    mark[off] = True
    while at < end:
        to = min(end, at + BLOCK)
        while to < end and not mark[to] and not _SPACE[data[to]]:  # a block ends between words
            step = data[to : to + 4096]
            stop = np.flatnonzero(_SPACE[step] | mark[to : to + len(step)])
            to += int(stop[0]) if len(stop) else len(step)
        part = _LOWER[data[at:to]]
        solid = ~_SPACE[part]
        edge = mark[at:to]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:]
        close = solid.copy()
        close[:-1] &= ~solid[1:] | edge[1:]
        s, e = np.flatnonzero(begin), np.flatnonzero(close) + 1
        p, q = _tables(to - at + 1)
        total = np.zeros(to - at + 1, _U)
        np.cumsum(_LETTER[part] * p[: to - at], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * q[s] + (e - s).astype(_U)))
        starts_all.append(s + at)
        at = to
    h = np.concatenate(hashes) if hashes else np.zeros(0, _U)
    s = np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)
    return h, np.searchsorted(s, off)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit hashes of each row's k-word shingles, row after row, and the n+1 bounds of the rows.

    A text of fewer words is one shingle; null and blank texts have none.
    """
    data, off = buffers(column)
    h, bound = words(data, off)
    odd = [_U((0x9E3779B97F4A7C15 * (2 * i + 3)) & 0xFFFFFFFFFFFFFFFF | 1) for i in range(k)]
    n = len(h)
    full = np.zeros(n, _U)
    if n >= k:
        part = h[: n - k + 1] * odd[0]
        for i in range(1, k):
            part += h[i : n - k + 1 + i] * odd[i]
        full[: n - k + 1] = mix(part)
    a, b = bound[:-1], bound[1:]
    size = np.where(b - a >= k, b - a - k + 1, np.minimum(b - a, 1))
    for i in np.flatnonzero((b - a > 0) & (b - a < k)).tolist():
        short = np.array([b[i] - a[i]], _U)
        for w in h[a[i] : b[i]]:
            short = short * _U(0x2545F4914F6CDD1D) + w
        full[a[i]] = mix(short)[0]
    for x, y in zip(a.tolist(), (a + size).tolist(), strict=True):
        full[x:y].sort()
    keep = np.zeros(n + 1, np.int64)
    np.add.at(keep, a, size > 0)
    np.add.at(keep, a + size, -(size > 0).astype(np.int64))
    inside = np.cumsum(keep[:n]) > 0
    first = np.ones(n, bool)
    first[1:] = full[1:] != full[:-1]
    first[a[size > 0]] = True
    inside &= first
    return full[inside], np.concatenate(([0], np.cumsum(inside)))[bound]


def shingles(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """``shingle_sets`` row by row."""
    flat, off = shingle_sets(column, k)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield flat[a:b]
