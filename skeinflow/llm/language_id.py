"""Language identification by error-correcting output codes.

Every language has a codeword of ``code_length`` bits; the words are taken one
after another so that they lie as far apart as possible.  For each bit, a binary
naive Bayes classifier over hashed n-grams of bytes (one to three, within words)
tells the languages with a one from those with a zero.  A text's mean log-odds
per n-gram, put through a slope, is a soft bit; decoding adds up each codeword's
logistic losses, weighted by how well the bit tells languages apart, and takes
the nearest.  A small lead over the second is flagged as ambiguous.

Classifiers follow from one table of counts (language, n-gram bucket), which is
added up over all training rows; its size depends on the number of languages,
not of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm._bytes import BLOCK, buffers, pieces
from skeinflow.llm._io import ship, tidied

BUCKETS = 1 << 14
#: Made-up count of every bucket; slope of a soft bit per n-gram; lead below which a text is ambiguous.
SMOOTH, SLOPE, LEAD = 0.5, 8.0, 0.2
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_MIX = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)]


def has_letter(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n of one to three: the buckets of all n-grams of the texts, and the row of each, ascending.

    A text of more than ``BLOCK`` bytes is taken block by block, with the two
    bytes before a block, so its n-grams come in several turns.
    """
    data, off = buffers(pc.utf8_lower(column))
    sizes = np.diff(off)
    at = 0
    for i in [*np.flatnonzero(sizes > BLOCK).tolist(), len(sizes)]:
        if i > at:
            text = _FOLD[data[off[at] : off[i]]]
            yield from _grams(text, np.repeat(np.arange(at, i, dtype=np.int32), sizes[at:i]))
        if i < len(sizes):
            seen = np.zeros(0, np.uint8)
            for x in range(int(off[i]), int(off[i + 1]), BLOCK):
                part = _FOLD[data[x : min(x + BLOCK, int(off[i + 1]))]]
                inside = part != 32
                before = np.append(x > off[i] and _FOLD[data[x - 1]] != 32, inside[:-1])
                text = np.append(seen, part[inside | before])  # one space ends a word
                yield from _coded(text, np.full(len(text), i, np.int32), np.zeros(len(text), bool), len(seen))
                seen = text[-2:]
        at = i + 1


def _grams(text: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    inside = text != 32
    keep = inside.copy()
    keep[1:] |= inside[:-1] & (owner[1:] == owner[:-1])  # one space ends a word
    text, owner = text[keep], owner[keep]
    first = np.ones(len(text), bool)
    first[1:] = owner[1:] != owner[:-1]
    yield from _coded(text, owner, first, 0)


def _coded(text: np.ndarray, owner: np.ndarray, first: np.ndarray, seen: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-grams that do not lie within the first ``seen`` bytes."""
    x = text.astype(np.uint32)
    one = x * _MIX[0]
    for size in (1, 2, 3):
        if len(x) < size:
            return
        code = one[: len(x) - size + 1].copy()
        ok = text[: len(code)] != 32 if size == 1 else np.ones(len(code), bool)
        for k in range(1, size):
            code = code * np.uint32(31) + x[k : len(code) + k] * _MIX[k]
            ok &= ~first[k : len(code) + k]
        if size == 3:
            ok &= text[1:-1] != 32  # not across words
        ok[: max(0, seen - size + 1)] = False
        code ^= code >> np.uint32(15)
        code = (code + np.uint32(size)) * np.uint32(0x2C1B3C6D)
        yield (code >> np.uint32(18))[ok].astype(np.int32), owner[: len(code)][ok]


def codewords(languages: int, length: int = 0) -> np.ndarray:
    """A matrix of -1 and 1, one row a language; each next column keeps the least distance of rows greatest.

    Every column tells at least one language from another.  Ties go to the
    column that is evenly split, then to the smaller number.
    """
    if languages < 2:
        return np.ones((languages, 1))
    length = length or max(7, 2 * int(np.ceil(np.log2(languages))) + 3)
    if languages <= 10:
        pool = [[1 if m >> i & 1 else -1 for i in range(languages)] for m in range(1, 1 << (languages - 1))]
    else:
        rng = np.random.default_rng(languages)
        pool = [r for r in rng.choice([-1, 1], (2000, languages)).tolist() if abs(sum(r)) < languages]
    pool = np.array(pool)
    a, b = np.triu_indices(languages, 1)
    apart = pool[:, a] != pool[:, b]
    even = -np.abs(pool.sum(1))
    total, used, chosen = np.zeros(len(a)), np.zeros(len(pool)), []
    for _ in range(length):
        after = total + apart
        best = min(range(len(pool)), key=lambda i: (used[i], -after[i].min(), -after[i].sum(), -even[i], i))
        chosen.append(best)
        used[best] += 1
        total = total + apart[best]
    return pool[chosen].T.astype(float)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits, log-odds
    trust: np.ndarray  # bits

    @classmethod
    def fit(cls, languages: list[str], counts: np.ndarray) -> Model:
        """From counts (languages, buckets): each language weighs the same, whatever its share of rows."""
        code = codewords(len(languages))
        share = (counts + SMOOTH) / (counts + SMOOTH).sum(1, keepdims=True)
        weights = np.zeros((counts.shape[1], code.shape[1]), np.float32)
        trust = np.ones(code.shape[1])
        for bit in range(code.shape[1]):
            one, zero = code[:, bit] > 0, code[:, bit] < 0
            if one.any() and zero.any():
                p, q = share[one].mean(0), share[zero].mean(0)
                weights[:, bit] = np.log(p / q)
                # how far the nearest languages of both sides lie from the border
                margin = share @ weights[:, bit]
                trust[bit] = max(0.05, min(margin[one].min(), -margin[zero].max()))
        return cls(languages, code, weights, trust / trust.sum() if len(trust) else trust)

    def decode(self, soft: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest language, its score, lead over the second) of rows of soft bits."""
        if len(self.languages) < 2:
            n = len(soft)
            return np.zeros(n, int), np.ones(n), np.ones(n)
        loss = np.log1p(np.exp(-np.clip(soft[:, None, :] * self.code[None], -50, 50))) @ self.trust
        belief = np.exp(-loss * self.code.shape[1])
        belief /= belief.sum(1, keepdims=True)
        order = np.argsort(-belief, axis=1, kind="stable")
        row = np.arange(len(soft))
        top = belief[row, order[:, 0]]
        return order[:, 0], top, top - belief[row, order[:, 1]]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous) of every text."""
        n = len(column)
        named, scores, unsure = ["und"] * n, np.zeros(n), np.ones(n, bool)
        if not self.languages:
            return named, scores, unsure
        letters = has_letter(column)
        for a, b in pieces(column):
            soft, size = np.zeros((b - a, self.code.shape[1])), np.zeros(b - a)
            for bucket, owner in grams(column.slice(a, b - a)):
                if len(owner):
                    at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                    soft[owner[at]] += np.add.reduceat(self.weights[bucket], at, axis=0)
                    size[owner[at]] += np.diff(np.append(at, len(owner)))
            # a short text has seen little: its bits are softer
            which, top, lead = self.decode(SLOPE * soft / (size[:, None] + 10.0))
            for i in np.flatnonzero(letters[a:b]).tolist():
                named[a + i] = self.languages[which[i]]
            scores[a:b] = np.where(letters[a:b], top, 0.0)
            unsure[a:b] = ~letters[a:b] | (lead < LEAD)
        return named, scores, unsure


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(1).dictionary_encode()
        which = names.indices.to_numpy()
        for a, b in pieces(batch.column(0)):
            for bucket, owner in grams(batch.column(0).slice(a, b - a)):
                mine = which[a:b][owner]
                for k in np.unique(mine).tolist():
                    name = names.dictionary[k].as_py()
                    total[name] = total.get(name, 0) + np.bincount(bucket[mine == k], minlength=BUCKETS)
    for name in sorted(total):
        some = np.flatnonzero(total[name])
        yield pa.record_batch([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(total[name][some].astype(np.int64))], names=["lang", "bucket", "n"])


def fit(training: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 1000) -> Model:
    """Learn from every row that has a text and a language.

    The driver gets at most ``BUCKETS`` sums a language; more than ``most``
    languages are an error.
    """
    ship(training.sparkSession)
    rows = training.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).limit(most + 1).toArrow()
    if got.num_rows > most:
        raise ValueError(f"more than {most} languages")
    languages = sorted(got["lang"].to_pylist())
    counts = np.zeros((len(languages), BUCKETS))
    for name, c in zip(got["lang"].to_pylist(), got["c"].combine_chunks(), strict=True):
        flat = c.values
        counts[languages.index(name), flat.field("bucket").to_numpy()] = flat.field("n").to_numpy()
    return Model.fit(languages, counts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    Null texts and those without a letter are ``und`` with score 0, and so is
    every text under a model without languages.  Repeated rows and null ids are
    kept.  An empty table gives an empty table.  Other columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                part = batch.slice(a, b - a)
                named, scores, unsure = shared.value.predict(part.column(1))
                yield pa.record_batch([part.column(0), pa.array(named), pa.array(scores), pa.array(unsure)], names=["id", "lang_pred", "score", "ambiguous"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(tidied(run), f"id {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is found without ambiguity; all columns, ``lang_col`` filled in where it is null.

    The model is learnt from the rows of ``docs`` that have a language; if none
    has, and where a text is null or has no letter, the language is ambiguous.
    Rows without an id and rows that repeat one are judged like any other.  An
    empty table gives an empty table.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col, lang_col))
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(text_at)):
                part = batch.slice(a, b - a)
                named, _, unsure = model.value.predict(part.column(text_at))
                cols = list(part.columns)
                cols[lang_at] = pc.coalesce(cols[lang_at], pa.array(named, cols[lang_at].type))
                yield pa.record_batch(cols, schema=part.schema).filter(pa.array(~unsure))

    return docs.mapInArrow(tidied(run), docs.schema)
