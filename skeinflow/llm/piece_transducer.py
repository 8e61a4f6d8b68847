"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled once: the normaliser (white space becomes U+2581, with
a prefix), the pieces as a trie, and byte fallback for characters that no piece
has.  Composing a text with them gives a lattice whose arcs are the pieces that
fit at each position; the encoding is its shortest path in the tropical semiring.

Unigram models weigh an arc by the piece's negated log-probability.  BPE models
weigh nothing, but an arc may follow another only if merging the two pieces'
characters gives back just these two: such compatibility of neighbours decides
whether a sequence is what merging makes of the whole text, so exactly one path
has finite weight.  No piece crosses from another character to a space or has a
character that is in no piece, so the lattice is cut there and each distinct
chunk is composed once.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm._io import ship

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBER = 500_000
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = 8 if kind == 1 else 4
            yield key >> 3, struct.unpack("<d" if size == 8 else "<f", data[at : at + size])[0]
            at += size


class Transducer:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        for number, value in model:
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, NORMAL))
        trainer = next((dict(_fields(v)) for n, v in model if n == 2), {})
        normal = next((dict(_fields(v)) for n, v in model if n == 3), {})
        self.bpe = trainer.get(3, 1) == 2
        if trainer.get(3, 1) not in (1, 2):
            raise ValueError("only unigram and BPE models")
        if normal.get(2):
            raise ValueError("only models whose normaliser keeps characters as they are")
        self.prefix, self.trim = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.id = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER)}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.longest = max(map(len, self.id), default=1)
        self.heads = {p[:n] for p in self.id for n in range(1, len(p) + 1)}  # the trie: every path from its root
        self.lowest = min((s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL), default=0.0)
        cut = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id)
        has = re.escape("".join(sorted({c for p in self.id for c in p} - {SPACE})))
        self.chunk = re.compile(f"{SPACE}*[{has}]+|{SPACE}+|[^{has}{SPACE}]" if cut and has else r"[\s\S]+")
        self.tails = {p[n:]: -1 for p in self.id for n in range(len(p))} | self.id  # the trie from the pieces' ends
        self.said = [self.told(i) for i in range(len(self.pieces))]
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def normalise(self, text: str) -> str:
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return ((" " if self.prefix else "") + text).replace(" ", SPACE)

    def merged(self, text: str) -> list[str]:
        """What merging the best adjacent pair, the leftmost of equals, makes of a short text."""
        parts = list(text)
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                k = self.id.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, where = self.scores[k], i
            if best is None:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def follows(self, a: int, b: int) -> bool:
        """Whether arc b may come after arc a (-1: at the start) in a BPE lattice."""
        key = a * len(self.pieces) + b
        got = self.fits.get(key)
        if got is None:
            right = self.pieces[b] if b not in self.byte_of and b != self.unknown else None
            left = self.pieces[a] if a >= 0 and a not in self.byte_of and a != self.unknown else None
            if right is None:
                got = True
            elif left is None:
                got = self.merged(right) == [right]
            else:
                got = self.merged(left + right) == [left, right]
            self.fits[key] = got
        return got

    def arcs(self, text: str, at: int) -> list[tuple[int, tuple[int, ...], float]]:
        """(end, ids, weight) of the arcs that leave a position of a unigram lattice."""
        out = []
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            part = text[at:end]
            if part not in self.heads:
                break
            k = self.id.get(part)
            if k is not None:
                out.append((end, (k,), -self.scores[k]))
        if text[at] not in self.id:
            out.append((at + 1, self.spell(text[at]), UNKNOWN_PENALTY - self.lowest))
        return out

    def merge_path(self, text: str) -> list[int]:
        """The one path of a BPE lattice: each position has one state that can be reached, the last piece of the text so far."""
        size, fits, get = len(self.pieces), self.fits, self.tails.get
        last, start = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        spelt: dict[int, tuple[int, ...]] = {}
        for end in range(1, len(text) + 1):
            at, k = end - 1, get(text[end - 1 : end])
            while k is not None:
                if k >= 0:
                    fit = fits.get(last[at] * size + k)
                    if self.follows(last[at], k) if fit is None else fit:
                        last[end], start[end] = k, at
                        break
                at -= 1
                k = get(text[at:end]) if at >= 0 else None
            else:
                ids = self.spell(text[end - 1])
                last[end], start[end], spelt[end] = ids[-1], end - 1, ids
        out: list[int] = []
        at = len(text)
        while at:
            out += reversed(spelt[at]) if at in spelt else (last[at],)
            at = start[at]
        return out[::-1]

    def spell(self, character: str) -> tuple[int, ...]:
        """Byte fallback."""
        return tuple(self.byte.get(b, self.unknown) for b in character.encode()) if self.byte else (self.unknown,)

    def shortest(self, text: str) -> list[int]:
        """The ids on the shortest path of a normalised text's lattice."""
        if self.bpe:
            return self.merge_path(text)
        best: list[tuple[float, int, tuple[int, ...]] | None] = [None] * (len(text) + 1)
        best[0] = (0.0, -1, ())
        for at in range(len(text)):
            for end, ids, weight in self.arcs(text, at):
                if best[end] is None or best[at][0] + weight < best[end][0]:
                    best[end] = (best[at][0] + weight, at, ids)
        out: list[int] = []
        at = len(text)
        while at > 0:
            _, at, ids = best[at]
            out += reversed(ids)
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        if len(self.known) > REMEMBER:
            self.known.clear()
        if len(self.fits) > REMEMBER:  # else up to pieces squared
            self.fits.clear()
        parts = []
        for chunk in self.chunk.findall(self.normalise(text)):
            ids = self.known.get(chunk)
            if ids is None:
                path = self.shortest(chunk)
                ids = self.known[chunk] = struct.pack(f"<{len(path)}i", *path)
            parts.append(ids)
        joined = np.frombuffer(b"".join(parts), "<i4")
        if not self.byte and len(joined) > 1:  # neighbouring unknowns are one
            joined = joined[np.concatenate(([True], (joined[1:] != self.unknown) | (joined[:-1] != self.unknown)))]
        return joined

    def told(self, i: int) -> bytes:
        """What a piece decodes to."""
        if i in self.byte_of:
            return bytes([self.byte_of[i]])
        if i == self.unknown:
            return " ⁇ ".encode()
        return self.pieces[i].replace(SPACE, " ").encode() if self.pieces[i] in self.id else b""

    def decode(self, ids) -> str:
        """The inverse transducer; control pieces give nothing."""
        said = self.said
        text = b"".join([said[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_known: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _known:
        _known[path] = Transducer(path)
    return _known[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``ids`` array<int>.

    Null and empty texts have no ids; repeated rows and null ids are kept.  An
    empty table gives an empty table.  Other columns are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [model.encode(t or "") for t in part.column(1).to_pylist()]
                off = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=off[1:])
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids)))], names=["id", "ids"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: the id and ``text``; null ids give null text."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer(model_path)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    chosen = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_ids``, ``ids_crc32`` (little-endian 32-bit ids), ``text_sha256`` of the decoded text."""
    ship(docs.sparkSession)
    encoded = encode(docs, model_path, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        model = transducer(model_path)
        for batch in batches:
            ids = [np.asarray(x.values) if x.is_valid else np.zeros(0, np.int32) for x in batch.column(1)]
            yield pa.record_batch(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in ids], pa.int64()), pa.array([model.decode(x) for x in ids], pa.string())],
                names=["id", "n_ids", "ids_crc32", "text"],
            )

    kind = encoded.schema[id_col].dataType.simpleString()
    out = encoded.mapInArrow(run, f"id {kind}, n_ids long, ids_crc32 long, text string")
    return out.select(F.col("id").alias(id_col), "n_ids", "ids_crc32", F.sha2("text", 256).alias("text_sha256"))
