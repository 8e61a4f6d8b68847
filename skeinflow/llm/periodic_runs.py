"""Maximal periodic runs of words, found on a harmonic grid.

A run of period q is at least max(LEAST, TIMES * q) words long, so at least
step(q) = max(LEAST, TIMES * q) - q neighbouring words equal the word q after
them, and one of those stands at a multiple of step(q).  Over all q that is a
harmonic sum of pairs (period, grid point).  All pairs of a block of texts are
looked at together: those whose two words are equal and whose surroundings are,
by prefix hashes, go on to a binary search for the longest common extension to
both sides, all at once.  What is found is verified word by word; a run that is
found from several grid points, or for multiples of its period, is kept once,
with the smallest period.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm._bytes import _LETTER, _SPACE, BLOCK, _tables, buffers, mix, pieces
from skeinflow.llm._io import ship, tidied

#: A run has at least so many words and so many periods.
LEAST, TIMES = 6, 4
#: Pairs of period and grid point that are looked at together; bytes of words that are compared together.
PAIRS, BYTES = 1 << 20, 1 << 22
_U = np.uint64
#: Prefix hashes are taken in two prime fields: (modulus, base).
FIELDS = ((2147483647, 1103515245), (2147483629, 1566083941))
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words ``[^\\x20\\x09-\\x0D]+`` and the n+1 bounds of each row's words; block by block."""
    small = np.int32 if len(data) < 1 << 31 else np.int64
    hashes, starts, ends = [np.zeros(0, _U)], [np.zeros(0, small)], [np.zeros(0, small)]
    mark = np.zeros(len(data) + 1, bool)
    mark[off] = True
    at = 0
    while at < len(data):
        to = min(len(data), at + BLOCK)
        while to < len(data) and not mark[to] and not _SPACE[data[to]]:  # a block ends between words
            ahead = data[to : to + 4096]
            stop = np.flatnonzero(_SPACE[ahead] | mark[to : to + len(ahead)])
            to += int(stop[0]) if len(stop) else len(ahead)
        part, edge = data[at:to], mark[at:to]
        solid = ~_SPACE[part]
        begin, close = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:]
        close[:-1] &= ~solid[1:] | edge[1:]
        s, e = np.flatnonzero(begin), np.flatnonzero(close) + 1
        p, q = _tables(len(part) + 1)
        total = np.zeros(len(part) + 1, _U)
        np.cumsum(_LETTER[part] * p[: len(part)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * q[s] + (e - s).astype(_U)))
        starts.append((s + at).astype(small))
        ends.append((e + at).astype(small))
        at = to
    s = np.concatenate(starts)
    return np.concatenate(hashes), s, np.concatenate(ends), np.searchsorted(s, off)


class Prefix:
    """Prefix hashes of a row of words: stretches of equal length are compared in constant time."""

    def __init__(self, h: np.ndarray, most: int):
        self.fields = []
        for p, base in FIELDS:
            powers = np.ones(len(h) + 1, _U)
            n = 1
            while n < len(powers):  # twice as many with each step
                m = min(n, len(powers) - n)
                powers[n : n + m] = powers[:m] * _U(pow(base, n, p)) % _U(p)
                n += m
            total = np.zeros(len(h) + 1, _U)
            np.cumsum(h % _U(p) * powers[:-1] % _U(p), out=total[1:])  # fits 64 bits below 2^33 words
            self.fields.append((_U(p), total, powers[: most + 1].copy()))

    def same(self, x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether t words from x on equal those from y >= x on."""
        out = np.ones(len(x), bool)
        for p, total, powers in self.fields:
            out &= (total[x + t] - total[x]) % p * powers[y - x] % p == (total[y + t] - total[y]) % p
        return out


def _longest(fits: Callable[[np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
    """For each item the largest t <= most for which ``fits(t)`` holds, by binary search; t = 0 always holds."""
    low, high = np.zeros(len(most), np.int64), most.astype(np.int64)
    while (low < high).any():
        mid = (low + high + 1) // 2
        fine = fits(mid)
        low, high = np.where(fine, mid, low), np.where(fine, high, mid - 1)
    return low


def _pairs(bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first word of the row, end of the row, word at the grid point, period, step) of all pairs, some at a time."""
    n = np.diff(bound)
    periods = np.where(n >= LEAST, n // TIMES, 0)
    where = np.flatnonzero(periods)
    row = np.repeat(where, periods[where])
    q = np.arange(len(row)) - np.repeat(np.cumsum(periods[where]) - periods[where], periods[where]) + 1
    step = np.maximum(LEAST, TIMES * q) - q
    points = -(-(n[row] - q) // step)
    upto = np.cumsum(points)
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        k = points[at:to]
        x = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        r, period, gap = (np.repeat(v[at:to], k) for v in (row, q, step))
        yield bound[r], bound[r + 1], bound[r] + x * gap, period, gap
        at = to


def grid_runs(h: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the runs in each row of words, positions over all rows; by hashes alone."""
    found, prefix = [np.zeros((0, 3), np.int64)], None
    for first, last, x, q, step in _pairs(bound):
        hit = h[x] == h[x + q]
        first, last, x, q, step = (v[hit] for v in (first, last, x, q, step))
        if not len(x):
            continue
        if prefix is None:
            prefix = Prefix(h, int(np.diff(bound).max()) // TIMES)
        half = (step + 1) // 2
        ahead, back = x + half <= last - q, x - (step - half + 1) >= first
        hit = np.zeros(len(x), bool)
        hit[ahead] = prefix.same(x[ahead], (x + q)[ahead], half[ahead])
        y = x - (step - half + 1)
        hit[back] |= prefix.same(y[back], (y + q)[back], (step - half + 1)[back])
        # the first grid point of a stretch is enough
        before = hit & (x - step >= first)
        hit[before] &= ~prefix.same((x - step)[before], (x - step + q)[before], step[before])
        first, last, x, q, step = (v[hit] for v in (first, last, x, q, step))
        ahead = _longest(lambda t: prefix.same(x, x + q, t), last - q - x)
        back = _longest(lambda t: prefix.same(x - t, x - t + q, t), x - first)
        hit = ahead + back >= step
        found.append(np.column_stack((x - back, x + ahead + q, q))[hit])
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]  # of one stretch the smallest period comes first
    new = np.ones(len(every), bool)
    new[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    return every[new]


def plain_runs(names: np.ndarray) -> np.ndarray:
    """The same for one row of exact names, period by period: what is left if hashes deceived."""
    out = []
    for q in range(1, len(names) // TIMES + 1):
        same = np.concatenate(([False], names[:-q] == names[q:], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a + q >= max(LEAST, TIMES * q):
                out.append((a, b + q, q))
    best: dict = {}
    for a, b, q in out:
        best.setdefault((a, b), q)
    return np.array([(a, b, q) for (a, b), q in sorted(best.items())], np.int64).reshape(-1, 3)


def _verified(data: np.ndarray, s: np.ndarray, e: np.ndarray, source: np.ndarray, run: np.ndarray) -> bool:
    """Whether the words of a run equal those a period later, letter by letter."""
    a, b, q = run.tolist()
    step = max(1, BYTES // 64)
    for at in range(a, b - q, step):
        x, y = source[at : min(at + step, b - q)], source[at + q : min(at + step, b - q) + q]
        other = x != y
        x, y = x[other], y[other]
        size = (e[x] - s[x]).astype(np.int64)
        if (size != e[y] - s[y]).any():
            return False
        upto = np.cumsum(size)
        for i in range(0, len(x), 4096):
            part = slice(i, i + 4096)
            within = np.arange(size[part].sum()) - np.repeat(upto[part] - size[part] - (upto[i] - size[i]), size[part])
            if (data[np.repeat(s[x[part]], size[part]) + within] != data[np.repeat(s[y[part]], size[part]) + within]).any():
                return False
    return True


def _joined(data: np.ndarray, s: np.ndarray, e: np.ndarray, words: np.ndarray | range) -> bytes:
    """Words by one space, some at a time; a range of them is cut out whole."""
    out = []
    for at in range(0, len(words), 1 << 16):
        some = words[at : at + (1 << 16)]
        if isinstance(some, range):
            out.append(b" ".join(data[s[some[0]] : e[some[-1]]].tobytes().split()))
        else:
            low, high = int(s[some].min()), int(e[some].max())
            text = data[low:high].tobytes()
            out.append(b" ".join([text[x:y] for x, y in zip((s[some] - low).tolist(), (e[some] - low).tolist(), strict=True)]))
    return b" ".join(out)


def _scan(echo: Callable[[int | None, int], np.ndarray | None] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                data, off = buffers(part.column(1))
                h, s, e, bound = spans(data, off)
                source = np.arange(len(h), dtype=s.dtype)
                ids, moved = part.column(0).to_pylist(), set()
                for i, name in enumerate(ids if echo else ()):
                    n = int(bound[i + 1] - bound[i])
                    if n and (order := echo(name, n)) is not None:
                        source[bound[i] : bound[i + 1]] = bound[i] + order
                        moved.add(i)
                runs = grid_runs(h[source] if moved else h, bound)
                own = np.searchsorted(runs[:, 0], bound)
                rows, texts = [], []
                for i in range(len(ids)):
                    a, b = int(bound[i]), int(bound[i + 1])
                    mine = runs[own[i] : own[i + 1]]
                    if not all(_verified(data, s, e, source, r) for r in mine):
                        names: dict[bytes, int] = {}
                        mine = plain_runs(np.array([names.setdefault(data[s[w] : e[w]].tobytes(), len(names)) for w in source[a:b].tolist()])) + [a, a, 0]
                    rows.append([{"start": x - a, "length": y - x, "period": q} for x, y, q in mine.tolist()])
                    if i not in moved and not len(mine):
                        texts.append(_joined(data, s, e, range(a, b)))
                        continue
                    change = np.zeros(b - a + 1, np.int64)
                    np.add.at(change, mine[:, 0] + mine[:, 2] - a, 1)
                    np.add.at(change, mine[:, 1] - a, -1)
                    texts.append(_joined(data, s, e, source[a:b][np.cumsum(change)[:-1] == 0]))
                yield pa.record_batch([part.column(0), pa.array(rows, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", echo: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row per input row: the id, its ``runs`` (start, length, period; by start, then period) and the ``collapsed`` text.

    A run is a stretch of words with smallest period q, at least max(6, 4 q) words
    long, that no neighbouring word extends keeping the period; word numbers start
    at 0.  The collapsed text has the words that stand in no run after its first q
    words, joined by one space.  ``echo`` may give, for an id and a number of
    words, the positions to read instead of 0, 1, ...; None leaves a text as it is.
    Null and empty texts and those of white space have no words, no runs and an
    empty collapsed text; a null id stays null; repeated rows are each searched.
    An empty table gives an empty table.  Other columns are not read.
    """
    ship(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = "id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return chosen.mapInArrow(tidied(_scan(echo)), kind).withColumnRenamed("id", id_col)
