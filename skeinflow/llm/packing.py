"""Bounded-space online packing of tokenised documents.

Each partition keeps at most ``OPEN`` windows.  A document's full windows are cut
off and closed at once; the rest goes to the open window it fits best (least room
left over).  When none fits and no window is free, the fullest one is emitted:
a rest that can fill it is cut there, unless less than ``CUT`` tokens of room
remain, which become padding.  The windows still open at a partition's end are
merged by packing them again, ``MERGE`` partitions to a task and round after
round, so no task ever holds more than MERGE * OPEN windows.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm._bytes import buffers
from skeinflow.llm._io import Scratch, give_back, tidied

OPEN, CUT, MERGE = 32, 64, 64
#: Chunks of text whose ids a worker remembers as recent; as many that came before may stay beside them.
REMEMBER = 400_000
#: Bytes of text that are looked up at once.
BLOCK = 1 << 22
_SEP, _LETTER, _DIGIT, _PUNCT, _QUOTE = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x0A]] = _SEP
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _PUNCT
_CLASS[39] = _QUOTE
#: Whether a chunk ends between bytes of two classes; an apostrophe may start a contraction.
_ENDS = np.zeros((32, 32), bool)
_ENDS[:, _SEP] = True
_ENDS[_SEP] = False
_ENDS[_LETTER, [_DIGIT, _PUNCT, _QUOTE]] = True
_ENDS[_DIGIT, [_LETTER, _PUNCT, _QUOTE]] = True
_ENDS[_PUNCT, [_LETTER, _DIGIT]] = True
_MARKS = re.compile(r"[!-&(-/:-@\[-`{-~]+")
#: White space that may join a chunk to the next; texts with it are tokenised whole.
_ODD = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
_known: dict = {}


def chunk_starts(data: np.ndarray) -> np.ndarray:
    """Where chunks of UTF-8 text may be cut, besides 0: before a space or newline after anything else, and between
    letters (ASCII, Latin-1 and Latin Extended A and B), ASCII digits and ASCII punctuation, but not after an apostrophe."""
    kind = _CLASS[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9))
    lead = lead[(data[lead] != 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]  # the signs times and divided by
    kind[lead] = kind[lead + 1] = _LETTER
    at = np.flatnonzero(kind[1:] != kind[:-1])
    return at[_ENDS[kind[at], kind[at + 1]]] + 1


class ChunkTokenizer:
    """Ids of whole texts from a byte-level BPE file of the ``tokenizers`` library.

    Its pre-tokeniser never joins what ``chunk_starts`` parts, so texts are cut
    there, Arrow finds the distinct chunks of each ``BLOCK`` bytes, and each
    chunk is encoded once.  Texts with other white space or with added tokens
    are encoded whole.  A chunk of letters, digits or marks alone, perhaps with
    white space before, splits into pieces without a pattern; tiktoken applies
    the file's own merges to those, four times faster than a call of
    ``tokenizers`` (not if the file's ids are not in the order of its merges).
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.piece = _piece_encoder(spec)
        self.added = [t["content"] for t in spec["added_tokens"] if t["content"]]
        #: Ids of chunks, none for those with odd white space.
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _one(self, chunk: str) -> list[int] | None:
        if chunk.isalpha() or chunk[0] == " " and chunk[1:].isalpha():
            return self.piece(chunk)
        word = chunk.lstrip(" \n")
        core = word
        if not word.isalpha() and not (word.isascii() and (word.isdigit() or _MARKS.fullmatch(word))):
            core = word.rstrip(".,;:!?|-")
            if not core.isalpha():
                return None if word else self.piece(chunk)
        lead = chunk[: len(chunk) - len(word)]
        if lead[-1:] == "\n":
            ids = self.piece("\n") + self.piece(core)
        else:
            ids = self.piece(lead[-1:] + core)
        if len(lead) > 1:
            ids = self.piece(lead[:-1]) + ids
        return ids + self.piece(word[len(core) :]) if len(core) < len(word) else ids

    def _learn(self, chunks: list[str]) -> None:
        hard = []
        for chunk in chunks:
            known = self.older.get(chunk)
            if known is not None:
                self.ids[chunk] = known
                continue
            ids = self._one(chunk) if self.piece else None
            if ids is not None:
                self.ids[chunk] = array("I", ids).tobytes()
            elif _ODD.search(chunk):
                self.ids[chunk] = b""
            else:
                hard.append(chunk)
        for at in range(0, len(hard), 10_000):
            some = hard[at : at + 10_000]
            for chunk, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.ids[chunk] = array("I", got.ids).tobytes()

    def _look_up(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, one after the other, and how many each has."""
        if len(self.ids) > REMEMBER:  # chunks that come again move on, so common ones are never learnt anew
            self.older, self.ids = self.ids, {}
        bounds = np.append(starts, len(data)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        chunks, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        got = list(map(self.ids.get, chunks))
        new = [i for i, x in enumerate(got) if x is None]
        self._learn([chunks[i] for i in new])
        for i in new:
            got[i] = self.ids[chunks[i]]
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        n = sizes[index]
        at = np.repeat((np.cumsum(sizes) - sizes)[index] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return np.frombuffer(b"".join(got), "<u4")[at], n

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """The ids of each text (none for a null), little-endian unsigned 32-bit."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        data, off = buffers(column)
        end, at, size = len(data), 0, BLOCK
        made, before, whole = [np.zeros(0, "<u4")], np.zeros(len(off), np.int64), set()
        while at < end:
            to = min(end, at + size)
            first = np.zeros(to - at, bool)
            first[chunk_starts(data[at:to])] = True
            first[off[slice(*np.searchsorted(off, (at, to)))] - at] = True
            first[0] = True
            starts = np.flatnonzero(first)
            if to < end:  # the last chunk may go on
                if len(starts) == 1:
                    size *= 2
                    continue
                to, starts = at + int(starts[-1]), starts[:-1]
            ids, n = self._look_up(data[at:to], starts)
            a, b = np.searchsorted(off, (at, to))
            total = before[-1] + np.append(0, np.cumsum(n))
            before[a:b] = total[np.searchsorted(starts, off[a:b] - at)]
            before[b:] = total[-1]
            whole.update((np.searchsorted(off, starts[n == 0] + at, "right") - 1).tolist())
            made.append(ids)
            at, size = to, BLOCK
        for token in self.added:
            whole.update(np.flatnonzero(pc.match_substring(column, token).fill_null(False).to_numpy(zero_copy_only=False)).tolist())
        ids = np.concatenate(made)
        out = [ids[a:b] for a, b in zip(before[:-1], before[1:], strict=True)]
        for row in whole:
            out[row] = np.array(self.tokenizer.encode_batch_fast([column[row].as_py()], add_special_tokens=False)[0].ids, "<u4")
        return out


def _piece_encoder(spec: dict):
    """The BPE of one pre-token, or None where ranks can't stand for the merges."""
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    if any(a >= b for a, b in itertools.pairwise(made)) or len(vocab) - len(made) > 300:
        return None
    import tiktoken

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _known:
        _known[path] = ChunkTokenizer(path)
        give_back()  # reading the file takes more than it leaves
    return _known[path]


class Packer:
    """The online packer of one task.  Pieces are (doc, start, length, payload); a window is [filled, [pieces]]."""

    def __init__(self, size: int, cut):
        self.size, self.cut = size, cut
        self.open: list[list] = []

    def place(self, piece) -> Iterator[list]:
        """Put a piece of at most ``size`` tokens into a window; yields the windows this closes."""
        while piece[2]:
            best = None
            for w in self.open:
                if w[0] + piece[2] <= self.size and (best is None or w[0] > best[0]):
                    best = w
            if best is None and len(self.open) < OPEN:
                best = [0, []]
                self.open.append(best)
            if best is not None:
                best[0] += piece[2]
                best[1].append(piece)
                if best[0] == self.size:
                    self.open.remove(best)
                    yield best
                return
            fullest = max(self.open, key=lambda w: w[0])
            self.open.remove(fullest)
            room = self.size - fullest[0]
            if room >= CUT:
                head, piece = self.cut(piece, room)
                fullest[0] += head[2]
                fullest[1].append(head)
            yield fullest


def _padding(filled: int, size: int) -> int:
    """Tokens of padding: none at a power of two, else up to ``size``."""
    return 0 if filled & (filled - 1) == 0 else size - filled


_SCHEMA = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, closed boolean, ids binary"
_FIELDS = ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "closed", "ids"]
_TYPES = [*[pa.int64()] * 8, pa.bool_(), pa.binary()]


def _rows(windows: list[tuple[int, list, bool]], keep_all: bool) -> pa.RecordBatch:
    """Rows of windows (id, window, closed).  A piece's payload is (row, ids, tokens of its document)."""
    cols: list[list] = [[] for _ in _FIELDS]
    for number, (_, pieces), closed in windows:
        offset = 0
        for doc, start, length, (row, ids, total) in pieces:
            for col, x in zip(
                cols, (doc, row, start, length, zlib.crc32(ids), total, number, offset, closed, ids if keep_all or not closed else None), strict=True
            ):
                col.append(x)
            offset += length
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_FIELDS)


def _cut(piece, room):
    doc, start, length, (row, ids, total) = piece
    return (doc, start, room, (row, ids[: 4 * room], total)), (doc, start + room, length - room, (row, ids[4 * room :], total))


def _pack(path: str, end_id: int, size: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = tokenizer(path).encode, Packer(size, _cut)
        number = TaskContext.get().partitionId() << 36
        row, done = number, []
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids = ids.tobytes() + end_id.to_bytes(4, "little")
                total = len(ids) // 4
                piece = (doc, 0, total, (row, ids, total))
                row += 1
                while piece[2] >= size:
                    full, piece = _cut(piece, size)
                    done.append((number, [size, [full]], True))
                    number += 1
                for w in packer.place(piece):
                    done.append((number, w, True))
                    number += 1
            yield _rows(done, keep_ids)
            done = []
        for w in packer.open:
            done.append((number, w, False))
            number += 1
        yield _rows(done, keep_ids)

    return run


def _merge(size: int, keep_ids: bool, round_: int, last: bool):
    """Pack the leftover pieces of several partitions; the rows of a task arrive in order of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, _cut)
        number = (round_ << 58) | (TaskContext.get().partitionId() << 36)
        done = []
        for batch in batches:
            for r in batch.select(["doc_id", "row", "start", "length", "doc_tokens", "ids"]).to_pylist():
                for w in packer.place((r["doc_id"], r["start"], r["length"], (r["row"], r["ids"], r["doc_tokens"]))):
                    done.append((number, w, True))
                    number += 1
            yield _rows(done, keep_ids)
            done = []
        for w in squeeze(packer.open, size) if last else packer.open:
            done.append((number, w, last))
            number += 1
        yield _rows(done, keep_ids)

    return run


def squeeze(windows: list[list], size: int) -> list[list]:
    """The last open windows joined end to end, cut at ``size``: all but one are full."""
    out = [[0, []]]
    for _, pieces in sorted(windows, key=lambda w: -w[0]):
        for piece in pieces:
            while piece[2]:
                if out[-1][0] == size:
                    out.append([0, []])
                room = size - out[-1][0]
                head, rest = _cut(piece, room) if piece[2] > room else (piece, (*piece[:2], 0, piece[3]))
                out[-1][0] += head[2]
                out[-1][1].append(head)
                piece = rest
    return [w for w in out if w[0]]


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, keep_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, row, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if wanted.

    A document is its text's ids without special tokens and then ``end_id``; a
    null or empty text is that id alone.  Every id is in exactly one piece, and
    the offsets of a sequence run from 0 without gaps to at most ``size``.  ``row``
    tells rows apart that repeat a doc_id; a null doc_id stays null.  ``ids`` is
    binary, little-endian unsigned 32-bit (null unless ``keep_ids``).  An empty
    table gives an empty table; columns other than the two named are not read.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    scratch = Scratch(docs.sparkSession, "packing")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = scratch.put(texts.mapInArrow(tidied(_pack(tokenizer_path, end_id, size, keep_ids)), _SCHEMA), "packed")
    out, rest, round_ = made.where("closed"), made.where("not closed"), 0
    while True:
        round_ += 1
        source = F.shiftright("sequence_id", 36).bitwiseAND((1 << 22) - 1)
        parts = rest.agg(F.max(source)).first()[0]
        if parts is None:
            break
        tasks = -(-(parts + 1) // MERGE)
        dealt = rest.withColumn("task", (source / MERGE).cast("int")).repartition(tasks, "task") if tasks > 1 else rest.coalesce(1)
        ordered = dealt.sortWithinPartitions("sequence_id", "offset").select(*_FIELDS)
        made = scratch.put(ordered.mapInArrow(tidied(_merge(size, keep_ids, round_, tasks == 1)), _SCHEMA), f"merged{round_}")
        out, rest = out.union(made.where("closed")), made.where("not closed")
        if tasks == 1:
            break
    kept = [c for c in _FIELDS if c != "closed" and (keep_ids or c != "ids")]
    return out.select(*[F.col(c).alias(id_col) if c == "doc_id" else c for c in kept])
