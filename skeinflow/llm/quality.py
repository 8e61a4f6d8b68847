"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a vector of ``FEATURES`` smooth statistics (logs and log-odds
of counts, so very short texts lie near the middle).  Per class, the sums that
fix mean and covariance are added up over all labelled training rows; the
covariances are shrunk towards the pooled one and towards its diagonal, and
their Cholesky factors are kept.  A score is the logistic of the difference of
the log densities, each from a Mahalanobis distance by forward substitution
with the kept factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm._bytes import BLOCK, buffers, pieces
from skeinflow.llm._io import FEW, Scratch, ship, tidied

#: Shares of the pooled covariance and of the diagonal in each class's covariance, and the score from which a text is good.
POOLED, DIAGONAL, ACCEPT = 0.3, 0.05, 0.7
FEATURES = ("length", "word_length", "letters", "capitals", "stops", "symbols", "pipes", "exclaims", "lines", "repeats", "line_repeats", "doubles")
_KIND = np.zeros(256, np.uint8)  # 0 other, 1 white, 2 lower, 3 upper, 4 digit, 5 stop, 6 symbol, 7 pipe, 8 exclamation, 9 later byte of a character
_KIND[[32, *range(9, 14)]] = 1
_KIND[97:123] = 2
_KIND[65:91] = 3
_KIND[48:58] = 4
_KIND[[ord(c) for c in ".,;:'\"()?-"]] = 5
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 6
_KIND[124], _KIND[33] = 7, 8
_KIND[0x80:0xC0] = 9
_KIND[0xC0:] = 2


def _odds(part: np.ndarray, whole: np.ndarray, share: float, weight: float = 20.0) -> np.ndarray:
    """Log-odds of a share, with ``weight`` made-up counts at its usual value."""
    return np.log((part + weight * share) / (whole - part + weight * (1 - share)))


def _repeats(owner: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """How many of a row's items are no first occurrence."""
    if not len(owner):
        return np.zeros(rows)
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.lexsort((mixed, owner))
    o, h = owner[order], mixed[order]
    again = (o[1:] == o[:-1]) & (h[1:] == h[:-1])
    return np.bincount(o[1:][again], minlength=rows).astype(float)


_powers: dict[str, np.ndarray] = {}
_BASE, _PAIR = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _tallies(column: pa.Array) -> np.ndarray:
    """Per row: ten counts by kind of byte, words, lines, pairs of words, repeated pairs, repeated lines, doubled words."""
    data, off = buffers(column)
    rows, n = len(off) - 1, len(data)
    if len(_powers.get("p", ())) < n + 2:
        base = np.full(max(n + 2, 2 * BLOCK), _BASE, np.uint64)
        base[0] = 1
        _powers["p"] = np.cumprod(base, dtype=np.uint64)
    powers = _powers["p"]
    kind = _KIND[data]
    owner = np.repeat(np.arange(rows), np.diff(off))
    count = np.bincount(owner * 10 + kind, minlength=rows * 10).reshape(rows, 10).astype(float)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    solid = kind != 1
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    close = solid.copy()
    close[:-1] &= ~solid[1:] | edge[1:n]
    a, b = np.flatnonzero(begin), np.flatnonzero(close) + 1
    words = np.bincount(owner[a], minlength=rows).astype(float)
    new = np.flatnonzero(data == 10)
    line_begin = np.unique(np.concatenate((off[:-1], new + 1)))
    line_begin = line_begin[line_begin < n]
    line_end = np.minimum(np.append(new, n)[np.searchsorted(new, line_begin)], off[1:][owner[line_begin]])
    full = line_end > line_begin
    line_begin, line_end = line_begin[full], line_end[full]
    lines = np.bincount(owner[line_begin], minlength=rows).astype(float)
    backwards = len(powers) - 1

    def hashed(x, y):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=total[1:])
        return (total[y] - total[x]) * powers[backwards - x]

    pair_owner, pair_hash = owner[a][:-1], np.zeros(0, np.uint64)
    double = np.zeros(rows)
    if len(a) > 1:
        h = hashed(a, b)
        pair_hash = h[:-1] * _PAIR + h[1:]
        inside = owner[a][1:] == pair_owner
        double = np.bincount(pair_owner[inside & (h[1:] == h[:-1])], minlength=rows).astype(float)
        pair_owner, pair_hash = pair_owner[inside], pair_hash[inside]
    pairs = np.bincount(pair_owner, minlength=rows).astype(float)
    again, lines_again = _repeats(pair_owner, pair_hash, rows), _repeats(owner[line_begin], hashed(line_begin, line_end), rows)
    return np.column_stack([count, words, lines, pairs, again, lines_again, double])


class _Runs:
    """Hashes of the runs of marked bytes of one text that comes block by block; a run may lie across many blocks."""

    def __init__(self):
        self.hash, self.length = 0, 0  # of a run that reached the end of the last block

    def feed(self, part: np.ndarray, marked: np.ndarray) -> np.ndarray:
        begin, close = marked.copy(), marked.copy()
        begin[1:] &= ~marked[:-1]
        close[:-1] &= ~marked[1:]
        a, b = np.flatnonzero(begin), np.flatnonzero(close) + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers["f"][: len(part)], out=total[1:])
        out = (total[b] - total[a]) * _powers["u"][a]
        if self.length and marked[0]:
            out[0] = (self.hash + pow(_BASE, self.length, 1 << 64) * int(out[0])) % (1 << 64)
            self.length += int(b[0])
        elif self.length:
            out = np.append(np.uint64(self.hash), out)
            self.length = 0
        if marked[-1]:
            self.hash, whole = int(out[-1]), len(a) == 1 and a[0] == 0
            self.length = self.length if whole and self.length else int(b[-1] - a[-1])
            return out[:-1]
        self.length = 0
        return out

    def end(self) -> np.ndarray:
        return np.full(int(self.length > 0), self.hash, np.uint64)


def _again(hashes: list[np.ndarray]) -> float:
    """How many of the hashes are no first occurrence."""
    flat = np.concatenate(hashes)
    flat.sort()
    return float((flat[1:] == flat[:-1]).sum())


def _long_tallies(data: np.ndarray) -> np.ndarray:
    """``_tallies`` of one long text, block by block: what stays are eight bytes for each pair of words and each line."""
    if "f" not in _powers:
        for key, base in (("f", _BASE), ("u", pow(_BASE, -1, 1 << 64))):
            table = np.full(BLOCK, base, np.uint64)
            table[0] = 1
            _powers[key] = np.cumprod(table, dtype=np.uint64)
    count, double = np.zeros(10), 0
    word_runs, line_runs, last = _Runs(), _Runs(), np.zeros(0, np.uint64)
    pairs, lines, words = [], [], 0
    for at in range(0, len(data) + 1, BLOCK):
        part = data[at : at + BLOCK]
        if len(part):
            kind = _KIND[part]
            count += np.bincount(kind, minlength=10)
            found = word_runs.feed(part, kind != 1)
            lines.append(line_runs.feed(part, part != 10))
        if at + BLOCK > len(data):
            found = np.append(found, word_runs.end()) if len(part) else word_runs.end()
            lines.append(line_runs.end())
        words += len(found)
        h = np.append(last, found)
        pairs.append(h[:-1] * _PAIR + h[1:])
        double += int((h[1:] == h[:-1]).sum())
        last = h[-1:]
    return np.array([*count, words, sum(map(len, lines)), sum(map(len, pairs)), _again(pairs), _again(lines), double], float)


def statistics(column: pa.Array) -> np.ndarray:
    """The feature matrix of a text column; nulls count as empty.  A text of more than ``BLOCK`` bytes is taken block by block."""
    data, off = buffers(column)
    long = np.diff(off) > BLOCK
    if long.any():
        tally = np.zeros((len(long), 16))
        tally[~long] = _tallies(column.filter(pa.array(~long)))
        for i in np.flatnonzero(long):
            tally[i] = _long_tallies(data[off[i] : off[i + 1]])
    else:
        tally = _tallies(column)
    count, (words, lines, pairs, again, lines_again, double) = tally[:, :10], tally[:, 10:].T
    letters = count[:, 2] + count[:, 3]
    visible = count.sum(1) - count[:, 1] - count[:, 9]
    return np.column_stack(
        [
            np.log1p(words),
            np.log((visible + 20 * 5.0) / (words + 20)),
            _odds(letters, visible - count[:, 4], 0.95),
            _odds(count[:, 3], letters, 0.03),
            _odds(count[:, 5], visible, 0.03),
            _odds(count[:, 6], visible, 0.005),
            _odds(count[:, 7], visible, 0.002),
            _odds(count[:, 8], visible, 0.002),
            np.log((lines + 1) / (words + 10)),
            _odds(again, pairs, 0.03),
            _odds(lines_again, lines, 0.03, 5.0),
            _odds(double, pairs, 0.01),
        ]
    )


def forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """z with factor @ z = b for a lower triangular factor: forward substitution, all columns of b at once."""
    z = np.zeros_like(b)
    for i in range(len(factor)):
        z[i] = (b[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


@dataclass
class Discriminant:
    """Per class (bad, good): mean, Cholesky factor of the covariance, and log of prior over root determinant."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]

    @classmethod
    def fit(cls, n: np.ndarray, s: np.ndarray, ss: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
        """From counts (2), sums (2, d) and sums of products (2, d, d) of the classes; a class of at most d rows takes the pooled covariance."""
        d = s.shape[1]
        if not n.any():
            return cls([np.zeros(d)] * 2, [np.eye(d)] * 2, [0.0, 0.0])
        total = s.sum(0) / n.sum()
        means = [s[k] / n[k] if n[k] else total for k in (0, 1)]
        scatter = [ss[k] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
        pool = (scatter[0] + scatter[1]) / n.sum()
        factors, offsets = [], []
        for k in (0, 1):
            own = scatter[k] / n[k] if n[k] > d else pool
            mixed = (1 - pooled) * own + pooled * pool
            mixed = (1 - diagonal) * mixed + diagonal * np.diag(np.diag(mixed)) + 1e-6 * np.eye(d)
            factor = np.linalg.cholesky(mixed)
            factors.append(factor)
            offsets.append(float(np.log((n[k] + 1) / (n.sum() + 2)) - np.log(np.diag(factor)).sum()))
        return cls(means, factors, offsets)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of the good class for each row."""
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            z = forward(factor, (x - mean).T)
            logs.append(offset - 0.5 * (z * z).sum(0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class: the count, the sums and the sums of products of the statistics of a task's rows (y, text)."""
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        for a, b in pieces(batch.column(1)):
            part = batch.slice(a, b - a)
            y, x = part.column(0).to_numpy(zero_copy_only=False), statistics(part.column(1))
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
    yield pa.record_batch(
        [pa.array(np.repeat([0, 1], total.shape[1])), pa.array(np.tile(np.arange(total.shape[1]), 2)), pa.array(total.ravel())],
        names=["k", "i", "v"],
    )


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Discriminant:
    """Fit on all rows of ``docs`` whose id ``labels`` marks 0 or 1; statistics are taken of those rows alone.

    What reaches the driver is 2 * (1 + d + d * d) sums.  An id with several
    labels counts once if they agree, else not at all.  With no labels, every
    score is one half; with one class, its own density decides against itself.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    clear = marks.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y1")).where("y = y1").select("id", "y")
    clear = scratch.put(clear, "labels")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # few labels come to the texts; texts are shuffled only for more
    marked = texts.join(F.broadcast(clear) if clear.limit(FEW + 1).count() <= FEW else clear, "id")
    sums = marked.select(F.col("y").cast("long").alias("y"), "text").mapInArrow(_sums, "k long, i long, v double")
    d = len(FEATURES)
    flat = np.zeros((2, 1 + d + d * d))
    for k, i, v in sums.groupBy("k", "i").agg(F.sum("v")).collect():
        flat[k, i] = v
    scratch.drop(clear)
    return Discriminant.fit(flat[:, 0], flat[:, 1 : d + 1], flat[:, d + 1 :].reshape(2, d, d))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: str | None = None) -> DataFrame:
    """One row per input row: the id, ``held_out``, ``score`` and ``predicted``.

    ``fold`` is a condition on the id column that holds for rows whose labels
    are not learnt from.  Null and empty texts are scored as texts without
    words; a null id is scored and never learnt from; rows that repeat an id are
    each scored, and each learnt from.  An empty table gives an empty table.
    Other columns are not read.
    """
    held = F.expr(fold) if fold else F.lit(False)
    marks = labels.where(~F.coalesce(held, F.lit(True))) if fold else labels
    model = fit(docs, marks, id_col, text_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                part = batch.slice(a, b - a)
                yield pa.record_batch([part.column(0), pa.array(model.score(statistics(part.column(1))))], names=["id", "score"])

    ship(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = chosen.mapInArrow(tidied(run), "id long, score double").withColumnRenamed("id", id_col)
    return out.select(id_col, F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``least``; a model of all labels.

    Null and empty texts are scored as texts without words; rows without an id
    and rows that repeat one are judged like any other, by their own text.  An
    empty table gives an empty table; without labels, every score is one half.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(where)):
                part = batch.slice(a, b - a)
                good = model.score(statistics(part.column(where))) >= least
                yield part.filter(pa.array(good))

    return docs.mapInArrow(tidied(run), docs.schema)
