"""Secrets in whole texts: three fixed patterns, and guess cost of what stands where a credential would.

The patterns are kinds ``assign``, ``access`` and ``hex``.  The method adds kind
``guess``: each value in a credential context (an assignment to a password-like
name, a bearer header, the password of a URL) is cut into words, dates, repeats,
keyboard walks and brute-force spans so that the sum of their costs, in bits of
guessing, is least.  A value of at least ``BITS`` bits is a secret; placeholders
and easily guessed words are not.

Texts are screened in whole batches (RE2 and byte tables); only those that may
hold something are looked at one by one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm._bytes import buffers, pieces
from skeinflow.llm._io import ship, tidied

BITS = 40.0
KINDS = ("assign", "access", "hex", "guess")
SPANS = "array<struct<kind:string,start:long,end:long,bits:double>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())])

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CONTEXT = re.compile(
    r"""(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|auth)[_-]?key|credentials?)["']?[\x20\t]*(?::|=>?)[\x20\t]*["']?"""
    r"""|authorization:[\x20\t]*(?:basic|bearer)[\x20\t]+|bearer[\x20\t]+|://[^\s:/@]+:)([^\s"'<>,;@]{6,})""",
    re.I | re.A,
)
#: Holds wherever ASSIGN, ACCESS or CONTEXT may match: an alternative added to one of them needs its own here.
_SCREEN = r"(?i)pass|pwd|secret|token|key|credential|authorization:|bearer|AKIA|://[^\s:/@]+:"

#: Words that guessers try first, the likelier ones earlier.
WORDS = """password pass admin secret welcome login love dragon master monkey letmein sunshine princess shadow
football baseball superman batman trust hello freedom whatever michael jordan hunter ranger buster soccer hockey
killer george charlie andrew thomas summer winter spring autumn flower orange banana cookie cheese pepper ginger
the and you that this have with for not are from your all can will one about out who get make when time just know
take people into year good some could them see other than then now look only come over think also back after use
two how our work first well way even new want because any give day most test demo example sample change default
user username root guest server database system token access private public key api changeme placeholder null none
true false insert here value string todo dummy fake redacted xxxx abc qwerty asdf company internet computer
january february march april june july august september october november december monday tuesday wednesday
thursday friday saturday sunday money lucky magic star diamond silver golden purple yellow green black white blue""".split()
_RANK = {w: math.log2(i + 2) for i, w in reversed(list(enumerate(WORDS)))}
_LONGEST = max(map(len, WORDS))
_PLAIN = str.maketrans({"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t"})
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_AT = {c: (x + 0.5 * y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)", re.A)
_LOG2 = {unit: math.log2(unit) for unit in (2, 3, 4)}
#: Bits for telling where a segment ends and of which kind it is.
CUT = 2.0


def _alphabet(value: str) -> float:
    """Bits of a brute-force character: of the classes that the value draws on."""
    if re.fullmatch(r"[0-9a-fA-F-]+", value) and re.search("[0-9]", value) and re.search("[a-fA-F]", value):
        return 4.0
    size = 26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value)) + 10 * bool(re.search("[0-9]", value))
    size += 33 * bool(re.search(r"[!-/:-@\[-`{-~]", value)) + 100 * bool(re.search(r"[^\x00-\x7f]", value))
    return math.log2(max(size, 10))


def _near(a: str, b: str) -> bool:
    p, q = _AT.get(a), _AT.get(b)
    return bool(p and q and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


class _Starts:
    """Starts of a segment that may still be best: ``least(i)`` is the least of cost + log2(i - start).

    What an older start loses by its length shrinks as i grows, so once it is
    better than a younger one it stays so; each start enters and leaves once.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[int, float, float]] = []  # start, cost, and when the one below gets better

    def _until(self, older: tuple[int, float, float], start: int, cost: float) -> float:
        """The i from which ``older`` is better than the younger start."""
        gap = cost - older[1]
        if gap > 1000:
            return 0.0
        ratio = 2.0**gap
        return (ratio * start - older[0]) / (ratio - 1) if ratio > 1 else math.inf

    def add(self, start: int, cost: float, i: int) -> None:
        self._drop(i)
        s = self.stack
        while s and (t := self._until(s[-1], start, cost)) > i and t >= s[-1][2]:
            s.pop()
        until = self._until(s[-1], start, cost) if s else math.inf
        if until > i:
            s.append((start, cost, until))

    def _drop(self, i: int) -> None:
        while self.stack and self.stack[-1][2] <= i:
            self.stack.pop()

    def least(self, i: int) -> float:
        self._drop(i)
        start, cost, _ = self.stack[-1]
        return cost + math.log2(i - start)


def guess_bits(value: str) -> float:
    """Least sum of segment costs: time in proportion to the value's length."""
    n = len(value)
    if not n:
        return 0.0
    low, each = value.lower(), _alphabet(value)
    plain = low.translate(_PLAIN)
    best = [0.0] * (n + 1)
    brute = [CUT] * (n + 1)  # least cost up to here if the last segment is brute force
    turns = [0] * n  # turns of the keyboard walk that ends here
    last = None
    for i in range(1, n):
        if _near(low[i - 1], low[i]):
            step = (_AT[low[i]][0] - _AT[low[i - 1]][0], _AT[low[i]][1] - _AT[low[i - 1]][1])
            turns[i] = turns[i - 1] + (turns[i - 1] == 0 or step != last)
            last = step
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if value[i].isdigit() and _DATE.match(value, i):
            for end in range(i + 4, min(i + 10, n) + 1):
                if _DATE.fullmatch(value, i, end):
                    dates.setdefault(end, []).append(i)
    since = dict.fromkeys((1, 2, 3, 4), 0)  # where the run of that period starts that ends here
    units = {unit: [_Starts() for _ in range(unit)] for unit in (2, 3, 4)}  # starts of repeats, by their place in a unit
    runs = _Starts()
    walks, walk = _Starts(), 0
    for i in range(1, n + 1):
        brute[i] = min(brute[i - 1], best[i - 1] + CUT) + each
        cost = brute[i]
        for size in range(2, min(_LONGEST, i) + 1):
            a = i - size
            rank = _RANK.get(low[a:i])
            extra = 0.0
            if rank is None and (rank := _RANK.get(plain[a:i])) is not None:
                extra = 1.0 + sum(x != y for x, y in zip(low[a:i], plain[a:i], strict=True))
            if rank is not None:
                upper = sum(c.isupper() for c in value[a:i])
                extra += 0.0 if not upper else 1.0 if upper == size or value[a].isupper() and upper == 1 else float(size)
                cost = min(cost, best[a] + CUT + rank + extra)
        for a in dates.get(i, ()):
            cost = min(cost, best[a] + CUT + (7.0 if i - a <= 4 else 16.0))
        if i > 1 and not turns[i - 1]:
            walks, walk = _Starts(), i - 1
        if i - 3 >= walk:
            walks.add(i - 3, best[i - 3] - 2.2 * (turns[i - 2] - 1), i)
            cost = min(cost, walks.least(i) + CUT + 5.0 + 2.2 * turns[i - 1])
        for unit in since:
            if i > unit and low[i - 1] != low[i - 1 - unit]:
                since[unit] = i - unit
                if unit > 1:
                    units[unit] = [_Starts() for _ in range(unit)]
        if i - 1 == since[1]:
            runs = _Starts()
        if i - 3 >= since[1]:
            runs.add(i - 3, best[i - 3], i)
            cost = min(cost, runs.least(i) + CUT + each)
        for unit, places in units.items():  # a repeated unit costs one of it and the count
            if i - 2 * unit >= since[unit]:
                places[i % unit].add(i - 2 * unit, best[i - 2 * unit], i)
                cost = min(cost, places[i % unit].least(i) - _LOG2[unit] + CUT + unit * each)
        best[i] = cost
    return best[n]


def find(text: str, bits: float = BITS) -> list[tuple[str, int, int, float | None]]:
    """All spans of one text, by start and then kind."""
    out: list[tuple[str, int, int, float | None]] = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            out.append(("assign", m.start(), m.end(), None))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 16:
            out.append(("access", m.start(), m.end(), None))
    for m in re.finditer(r"[0-9a-f]{32,}", text):
        out.append(("hex", m.start(), m.end(), None))
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".)]}")
        if (cost := guess_bits(value)) >= bits:
            out.append(("guess", m.start(1), m.start(1) + len(value), cost))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*range(48, 58), *range(97, 103)]] = True


def suspects(column: pa.Array) -> np.ndarray:
    """Positions of the texts that may hold a span: no text with one is left out."""
    maybe = pc.fill_null(pc.match_substring_regex(column, _SCREEN), False).to_numpy(zero_copy_only=False).copy()
    data, off = buffers(column)
    step = 1 << 22
    for at in range(0, len(data), step):  # runs of 32 hex digits: look at every 16th byte, then at its surroundings
        probe = np.arange(at, min(at + step, len(data)), 16)
        for p in probe[_IS_HEX[data[probe]]].tolist():
            if p + 16 < len(data) and not _IS_HEX[data[p + 16]]:
                continue
            a, b = max(0, p - 15), min(len(data), p + 32)
            part = _IS_HEX[data[a:b]]
            gaps = np.flatnonzero(~part)
            left = gaps[gaps < p - a]
            right = gaps[gaps > p - a]
            if (right[0] if len(right) else len(part)) - (left[-1] + 1 if len(left) else 0) >= 32:
                maybe[max(0, np.searchsorted(off, p, "right") - 1)] = True
    return np.flatnonzero(maybe)


def _scan(bits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                part = batch.slice(a, b - a)
                spans: list[list] = [[] for _ in range(part.num_rows)]
                texts = part.column(1)
                for i in suspects(texts).tolist():
                    spans[i] = [dict(zip(("kind", "start", "end", "bits"), s, strict=True)) for s in find(texts[i].as_py(), bits)]
                yield pa.record_batch([part.column(0), pa.array(spans, pa.list_(_SPAN))], names=["id", "spans"])

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: float = BITS) -> DataFrame:
    """One row per input row: the id and its ``spans`` (kind, start, end in code points, bits for ``guess``).

    Spans are in order of start, then kind.  Null and empty texts have none; a
    null id stays null; repeated rows are each scanned.  An empty table gives an
    empty table.  Only the two named columns are read.
    """
    ship(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(_scan(bits), f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars", bits: float = BITS, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every run of overlapping spans replaced by ``mark``; ``count_col`` follows if there is one.

    Texts without spans, nulls among them, stay as they are.  Rows without an id
    and rows that repeat one are redacted like any other; an empty table gives
    an empty table.
    """
    ship(docs.sparkSession)
    names = docs.columns
    where, count = names.index(text_col), names.index(count_col) if count_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(where)):
                part = batch.slice(a, b - a)
                texts = part.column(where)
                hits = {}
                for i in suspects(texts).tolist():
                    text = texts[i].as_py()
                    if spans := find(text, bits):
                        hits[i] = cover(text, spans, mark)
                if hits:
                    cols = list(part.columns)
                    values = texts.to_pylist()
                    for i, t in hits.items():
                        values[i] = t
                    cols[where] = pa.array(values, texts.type)
                    if count is not None:
                        sizes = cols[count].to_pylist()
                        for i, t in hits.items():
                            sizes[i] = len(t)
                        cols[count] = pa.array(sizes, cols[count].type)
                    part = pa.record_batch(cols, schema=part.schema)
                yield part

    return docs.mapInArrow(tidied(run), docs.schema)


def cover(text: str, spans: list[tuple], mark: str) -> str:
    out, at = [], 0
    for _, start, end, *_ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
