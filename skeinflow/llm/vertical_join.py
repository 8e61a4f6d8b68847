"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes.  It is cut into
``m`` equal ranges, the fragments; a document's part within one is its segment.

*Candidates.*  If two sets have Jaccard similarity >= t, they differ in at most
``d`` n-grams, where d follows from their sizes.  With ``m > d`` fragments, at
least ``m - d`` segments are equal on both sides, so equal (fragment, segment)
signatures find every such pair; no frequency cut or bucket cap is needed.
``m`` depends on the size of the smaller set (classes that grow by half), and a
set signs for its own class and for each below that a partner of it may be in.
Empty segments are not signed: a set with ``e`` of them shares at least
``m - d - e`` signed ones with each partner, its need.  Where that is below one,
which only small sets come to, its first n-grams by hash are signatures too, as
many as may be missing in a partner and one more: two such sets that reach the
similarity have one of these in common.

*Meeting.*  A task sorts the signatures of some thousands of documents; of those
with the same signature the first stands for all, the others are tied to it on
the spot.  Only the firsts are shuffled, as sorted runs of a few bytes each, and
meet those of other tasks, whose smallest they are tied to.  So a signature of a
third of all documents arrives once a task, and no document is tied to more than
a task's documents or the number of tasks.  Signatures have ``WIDTH`` bits: equal
bits of different segments make a candidate more, never a link or a loss.

*Sketches.*  Bit b of a set's sketch is the parity of its n-grams that fall on b,
so two sketches differ in at most as many bits as the sets in n-grams.  Pairs
whose sketches differ in more than the similarity allows are no candidates; this
bound is exact and drops no link.  A short sketch is held against another in the
join, a long one, of twice the set's size at least, before counting.

*Counting.*  For candidate pairs, the overlap of each of ``FRAGMENTS`` coarser
fragments is counted separately and summed per pair.

*Connectivity.*  Sets that are equal are one class from the start.  Of each
document's ties the one that most signatures share is counted first, then those
whose ends are not in one component yet.  Ties form a tree for every signature,
so all documents of one whose ties lie within components are done.  The others mostly hold texts that share a
passage and little else.  There a set with fewer open signatures than its need is
out, and of the others all but the ``need - 1`` most frequent signatures are
enough (the prefix filter).  Within what is left, two documents by random order
are held against the others of their signature where more than ``LARGE`` have it,
once, which joins most near copies of large groups; then every pair that is still
across components and that sizes and sketches allow is counted, in blocks of
``BUCKET`` documents.  Later links join components, not documents: those that
they touch are nodes of a graph of their own, which is small.
No pair within a component is made, so a group of n near copies costs about n
comparisons, not n*n/2; and no link between different components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.llm._bytes import mix, pieces, shingle_sets, shingles
from skeinflow.llm._graph import components, merged
from skeinflow.llm._io import Scratch, fresh, light, pick, tidied

FRAGMENTS = 8
#: Words of 64 bits of a parity sketch.
SKETCH = 8
#: Bits of a signature; the lowest are its class's number modulo ``PHASES``.
WIDTH, PHASES = 40, 4
#: Signatures that a task sorts at once, documents of a block in the last comparison, documents of a signature that gets hubs before it.
RUN, BUCKET, LARGE = 1 << 20, 1024, 64
#: Runs of signatures meet a slice of the buckets after the other where the features are larger than so many bytes: their shuffle is not on disk at once.
SLICES, WHOLE = 4, 48 << 20
_U = np.uint64


@lru_cache
def classes(percent: int, limit: int = 1 << 32) -> list[tuple[int, int, int, int]]:
    """(smallest, end, fragments, fragments that may differ) of the size classes of the smaller set.

    Below the first class, only equal sets reach the similarity.
    """
    low = 1
    while (low * 100) // percent == low and 100 * (low - 1) < percent * (low + 1):
        low += 1
    out = []
    while low < limit:
        end = max(low + 1, low * 3 // 2)
        both = (end - 1) + (end - 1) * 100 // percent
        differ = both * (100 - percent) // (100 + percent)
        out.append((low, end, differ + 2 + differ // 3, differ))
        low = end
    return out


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums, modulo 2^64, of the values of each row."""
    out = np.zeros(len(off) - 1, _U)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, off[full])
    return out


def _chosen(off: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first ``sizes`` values of some rows, and for each which of ``rows`` it is of."""
    which = np.repeat(np.arange(len(rows)), sizes)
    return np.arange(len(which)) + (off[rows] - (np.cumsum(sizes) - sizes))[which], which


def sign(flat: np.ndarray, off: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets given row after row: segment signatures, the row of each, and each row's needs by phase.

    A set signs for its own class and for those below that a partner may be in.
    The lowest bits of a signature are its class's phase.
    """
    table = np.array(classes(percent))
    n = np.diff(off)
    own = np.searchsorted(table[:, 0], n, "right") - 1
    needs = np.ones((len(n), PHASES), np.int64)
    mixed = mix(flat)
    out, owner = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for step in range(PHASES):
        c = own - step
        rows = np.flatnonzero((c >= 0) & ((step == 0) | (n <= (table[c, 1] - 1) * 100 // percent)) & (n > 0))
        if not len(rows):
            break
        c = c[rows]
        at, which = _chosen(off, rows, n[rows])
        m, differ = table[c, 2], table[c, 3]
        tag = (c + 1).astype(_U) * _U(0x9E3779B97F4A7C15)
        frag = ((flat[at] >> _U(32)) * m.astype(_U)[which]) >> _U(32)
        start = np.flatnonzero(np.concatenate(([True], (frag[1:] != frag[:-1]) | (which[1:] != which[:-1]))))
        of = which[start]
        size = np.diff(np.append(start, len(at))).astype(_U)
        sigs = mix(np.add.reduceat(mixed[at], start) + mix(frag[start] + tag[of]) + size)
        held = np.bincount(of, minlength=len(rows))
        few = held <= differ
        needs[rows, c % PHASES] = np.where(few, 1, held - differ)
        some = np.flatnonzero(few)
        at, which = _chosen(off, rows[some], n[rows[some]] + percent * -n[rows[some]] // 100 + 1)
        for x, o in ((sigs, of), (mix(mixed[at] + tag[some][which] + _U(0xA5A5A5A5)), some[which])):
            out.append(x >> _U(64 - WIDTH) & ~_U(PHASES - 1) | (c % PHASES).astype(_U)[o])
            owner.append(rows[o])
    return np.concatenate(out), np.concatenate(owner), needs


def _parities(marks: np.ndarray, off: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parity sketches of ``size`` bits, a power of two from 64 on, of each set, row after row in words, from well-mixed hashes."""
    count = np.diff(off)
    base = np.cumsum(size) - size
    at = np.repeat(base, count) + ((marks >> _U(20)).astype(np.int64) & np.repeat(size - 1, count))
    return np.packbits(np.bincount(at, minlength=int(size.sum())).astype(np.uint8) & 1).view(np.int64)


def _apart(x: str, y: str, percent: int) -> str:
    """SQL that is false only for pairs of rows whose sizes or short sketches rule the similarity out."""
    bits = " + ".join(f"bit_count({x}.sk[{i}] ^ {y}.sk[{i}])" for i in range(SKETCH))
    sizes = f"100 * {x}.n >= {percent} * {y}.n and 100 * {y}.n >= {percent} * {x}.n"
    return f"{sizes} and coalesce(({bits}) * {100 + percent} <= ({x}.n + {y}.n) * {100 - percent}, true)"


def _short(percent: int):
    """The short sketch; null for sets so large that it would rule next to nothing out."""
    return F.when(F.col("n") * (100 - percent) < 20 * SKETCH * (100 + percent), F.col("sk")).alias("sk")


def _far(x: str, y: str, percent: int) -> str:
    """The same by the long sketches; the longer one is folded to the length of the other."""
    short = f"least(size({x}.wide), size({y}.wide))"
    word = "aggregate(sequence(0, cast(size({0}.wide) / {1} as int) - 1), 0L, (w, j) -> w ^ {0}.wide[i + j * {1}])"
    bits = f"aggregate(sequence(0, {short} - 1), 0, (c, i) -> c + bit_count({word.format(x, short)} ^ {word.format(y, short)}))"
    return f"{bits} * {100 + percent} <= ({x}.n + {y}.n) * {100 - percent}"


#: What one pass over the texts gives: documents (kind 0), runs of signatures for a bucket (1), and ties within a task (2).
MADE = pa.schema(
    [
        ("kind", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("needs", pa.list_(pa.int32())),
        ("sk", pa.list_(pa.int64())), ("wide", pa.list_(pa.int64())), ("signed", pa.bool_()), ("bucket", pa.int32()), ("width", pa.int32()), ("run", pa.binary()), ("sig", pa.int64()), ("hub", pa.int64()),
    ]
)
_MADE = (
    "kind int, row long, id long, n long, p1 long, p2 long, needs array<int>, sk array<long>, wide array<long>, signed boolean, bucket int, width int, run binary, sig long, hub long"
)


def _made(kind: int, size: int, **cols) -> pa.RecordBatch:
    cols["kind"] = np.full(size, kind, np.int32)
    given = {n: x if isinstance(x, pa.Array) else pa.array(x, MADE.field(n).type) for n, x in cols.items()}
    return pa.record_batch([given[f.name] if f.name in given else pa.nulls(size, f.type) for f in MADE], schema=MADE)


def _packed(run: np.ndarray, base: int) -> tuple[int, bytes]:
    """Ascending numbers from ``base`` on as differences of as many bytes as the largest needs."""
    steps = np.diff(run, prepend=_U(base))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return width, np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(data: bytes, width: int, base: int) -> np.ndarray:
    steps = np.zeros((len(data) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return np.cumsum(steps.view(_U).ravel(), dtype=_U) + _U(base)


def _features(percent: int, k: int, bits: int):
    """Documents get a number, ``row``: 16 bits within a block, the rest for the block."""

    def meet_here(base: int, sigs: list[np.ndarray], places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([np.zeros(0, _U), *(s << _U(16) | p.astype(_U) for s, p in zip(sigs, places, strict=True))])
        if not len(keys):
            return
        keys.sort()
        sig = keys >> _U(16)
        first = np.concatenate(([True], sig[1:] != sig[:-1]))
        again, start = np.flatnonzero(~first), np.flatnonzero(first)
        hub = keys[start[np.searchsorted(start, again, "right") - 1]]
        for at in range(0, len(again), 200_000):
            x, h = keys[again[at : at + 200_000]], hub[at : at + 200_000]
            tied = x != h
            x, h = x[tied], h[tied]
            row, other = (((v & _U(0xFFFF)).astype(np.int64) | base) for v in (x, h))
            yield _made(2, len(x), sig=(x >> _U(16)).view(np.int64), row=row, hub=other)
        keys = keys[first]
        bucket = (keys >> _U(WIDTH + 16 - bits)).astype(np.int32)
        cut = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(keys)).tolist()
        runs = [_packed(keys[a:b], int(bucket[a]) << (WIDTH + 16 - bits)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield _made(1, len(runs), row=np.full(len(runs), base), bucket=bucket[cut[:-1]], width=[w for w, _ in runs], run=[d for _, d in runs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, sigs, places, seen, count = TaskContext.get().partitionId() << 40, [], [], set(), 0
        for batch in batches:
            for a, b in pieces(batch.column(1), 1000):
                part, full = batch.slice(a, b - a), (row & 0xFFFF) + b - a > 0x10000
                if full or count >= RUN:
                    yield from meet_here(row >> 16 << 16, sigs, places)
                    sigs, places, seen, count = [], [], set(), 0
                if full:
                    row = ((row >> 16) + 1) << 16
                flat, off = shingle_sets(part.column(1), k)
                marks = mix(flat ^ _U(0x5851F42D4C957F2D))
                prints = [x.view(np.int64) for x in (_sums(flat, off), _sums(marks, off))]
                size, ids = np.diff(off), part.column(0).to_pylist()
                signed = np.zeros(b - a, bool)
                for i, own in enumerate(zip(ids, size.tolist(), *(x.tolist() for x in prints), strict=True)):
                    if own[0] is not None and own[1] and own[1:] not in seen:  # of equal sets in one run, the first signs for all
                        seen.add(own[1:])
                        signed[i] = True
                rows = np.flatnonzero(signed)
                at, _ = _chosen(off, rows, size[rows])
                mine, of, some = sign(flat[at], np.concatenate(([0], np.cumsum(size[rows]))), percent)
                needs = np.ones((b - a, PHASES), np.int32)
                needs[rows] = some
                sigs.append(mine)
                places.append((row & 0xFFFF) + rows[of])
                count += len(mine)
                long = np.maximum(64 * SKETCH, 2 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(w))).astype(np.int32)), pa.array(x)) for w, x in (
                        (np.full(b - a, PHASES), needs.ravel()), (np.full(b - a, SKETCH), _parities(marks, off, np.full(b - a, 64 * SKETCH))), (long // 64, _parities(marks, off, long)),
                    )
                ]
                yield _made(0, b - a, row=row + np.arange(b - a), id=part.column(0), n=size, p1=prints[0], p2=prints[1], needs=lists[0], sk=lists[1], wide=lists[2], signed=signed)
                row += b - a
        yield from meet_here(row >> 16 << 16, sigs, places)

    return run


def _meet(bits: int):
    """Of rows (bucket, row, width, run) in order of buckets: (sig, row, hub) for documents of different runs that share a signature."""

    def met(bucket: int, runs: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if len(runs) < 2:
            return
        keys = np.concatenate([x for _, x in runs])
        rows = np.repeat([b for b, _ in runs], [len(x) for _, x in runs]) | (keys & _U(0xFFFF)).astype(np.int64)
        sig = keys >> _U(16)
        order = np.argsort(sig, kind="stable")
        sig, rows = sig[order], rows[order]
        start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.append(start, len(sig)))
        hub = np.repeat(np.minimum.reduceat(rows, start), size)
        tied = np.flatnonzero((np.repeat(size, size) > 1) & (rows != hub))
        for at in range(0, len(tied), 200_000):
            t = tied[at : at + 200_000]
            yield pa.record_batch([pa.array(sig[t].view(np.int64)), pa.array(rows[t]), pa.array(hub[t])], names=["sig", "row", "hub"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = -1, []
        for batch in batches:
            for bucket, base, width, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != now:
                    yield from met(now, runs)
                    now, runs = bucket, []
                runs.append((base, _unpacked(data, width, bucket << (WIDTH + 16 - bits))))
        yield from met(now, runs)

    return run


def _segments(k: int):
    """(id, p1, frag, seg) of texts; p1 tells texts apart that repeat an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = [_U(i * ((1 << 64) // FRAGMENTS)) for i in range(1, FRAGMENTS)]
        for batch in batches:
            for a, b in pieces(batch.column(1), 500):
                part = batch.slice(a, b - a)
                ids, prints, frags, parts = [], [], [], []
                for i, s in zip(part.column(0).to_pylist(), shingles(part.column(1), k), strict=True):
                    p1 = int(s.sum(dtype=_U).view(np.int64))
                    for f, seg in enumerate(np.split(s, np.searchsorted(s, bounds))):
                        if len(seg):
                            ids.append(i)
                            prints.append(p1)
                            frags.append(f)
                            parts.append(seg.view(np.int64))
                off = np.zeros(len(parts) + 1, np.int32)
                np.cumsum([len(x) for x in parts], out=off[1:])
                flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                yield pa.record_batch(
                    [pa.array(ids, pa.int64()), pa.array(prints, pa.int64()), pa.array(frags, pa.int32()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))],
                    names=["id", "p1", "frag", "seg"],
                )

    return run


def count_overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, overlap) of pairs (a, ia, pa, b, ib, pb): overlaps counted fragment by fragment, then summed per pair.

    Every fragment of a pair is a row of its own, so a set with many partners is
    spread over ``FRAGMENTS`` keys.  ``pairs`` is counted: give a written table.
    """
    left = segments.select(F.col("id").alias("ia"), F.col("p1").alias("pa"), "frag", F.col("seg").alias("sa"))
    right = segments.select(F.col("id").alias("ib"), F.col("p1").alias("pb"), "frag", F.col("seg").alias("sb"))
    held = left.join(light(pairs), ["ia", "pa"]).join(right, ["ib", "pb", "frag"])
    once = held.select("a", "b", "frag", F.size(F.array_intersect("sa", "sb")).alias("c")).groupBy("a", "b", "frag").agg(F.max("c").alias("c"))
    return once.groupBy("a", "b").agg(F.sum("c").alias("overlap"))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """One row per input row: the id, ``n_shingles`` and ``component_id``.

    Two rows link when 100 * |A & B| >= percent * |A | B| for their sets of
    distinct k-word shingles (A-Z lowered; a text of fewer words is one shingle).
    ``component_id`` is the smallest id reachable by links, itself included.
    Null or blank texts have no shingles and link with nothing.  Rows that repeat
    an id are rows of their own, each compared by its own text.  A row without an
    id links with nothing and gets no component.  An empty table gives an empty
    table.  Only ``id_col`` and ``text_col`` are read.  percent must be over 50.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be in (50, 100]")
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bits = min(20, (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    made = scratch.put(texts.mapInArrow(tidied(_features(percent, k, bits)), _MADE), "features")
    slices = SLICES if scratch.size(made) > WHOLE else 1
    ties = made.where("kind = 2").select("sig", "row", "hub")
    parts = []
    for i in range(slices):
        runs = made.where(f"kind = 1 and pmod(bucket, {slices}) = {i}").select("bucket", "row", "width", "run").repartition("bucket").sortWithinPartitions("bucket")
        met = runs.mapInArrow(tidied(_meet(bits)), "sig long, row long, hub long")
        parts.append(scratch.put(met.union(ties) if i == 0 else met, "ties"))
        del runs, met
        scratch.sweep()
    ties = scratch.read(parts)
    feats = scratch.put(made.where("kind = 0").select("row", "id", "n", "p1", "p2", "needs", "sk", "wide", "signed"), "documents")
    scratch.drop(made)
    del made
    keys = ["n", "p1", "p2"]
    sets = scratch.put(feats.where("n > 0 and id is not null").groupBy(*keys).agg(F.min("row").alias("rep"), F.min("id").alias("least"), F.count("*").alias("rows")), "classes")
    pairs = scratch.put(ties.groupBy(F.col("hub").alias("a"), F.col("row").alias("b")).agg(F.count("*").alias("shared")), "pairs")
    nearest = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")

    def verify(asked: DataFrame, tag: str) -> DataFrame:
        """Those of the written (a, b) that are links, held against sizes, sketches and then the counted overlap."""
        na, nb = (feats.select(F.col("row").alias(c), F.struct("n", _short(percent)).alias(f"f{c}")) for c in "ab")
        near = scratch.put(na.join(light(asked), "a").join(nb, "b").where(_apart("fa", "fb", percent)).select("a", "b"), f"{tag}-near")
        some = pick(feats, scratch.put(near.select(F.explode(F.array("a", "b")).alias("row")).distinct(), f"{tag}-rows"), ["row"])
        na, nb = (some.select(F.col("row").alias(c), F.struct("n", "p1", "p2", "wide", "id").alias(f"f{c}")) for c in "ab")
        facts = ["a", F.col("fa.id").alias("ia"), F.col("fa.p1").alias("pa"), "b", F.col("fb.id").alias("ib"), F.col("fb.p1").alias("pb")]
        equal = F.col("fa.n").eqNullSafe(F.col("fb.n")) & (F.col("fa.p1") == F.col("fb.p1")) & (F.col("fa.p2") == F.col("fb.p2"))
        close = na.join(light(near), "a").join(nb, "b").where(_far("fa", "fb", percent))
        close = scratch.put(close.select(*facts, F.col("fa.n").alias("n"), F.col("fb.n").alias("m"), equal.alias("equal")), f"{tag}-close")
        open_ = close.where("not equal")
        wanted = scratch.put(open_.select(F.explode(F.array("ia", "ib")).alias("id")).distinct(), f"{tag}-wanted")
        segments = scratch.put(pick(texts, wanted, ["id"]).mapInArrow(tidied(_segments(k)), "id long, p1 long, frag int, seg array<long>"), f"{tag}-segments")
        counted = count_overlaps(open_.select("a", "ia", "pa", "b", "ib", "pb"), segments)
        held = counted.join(light(open_.select("a", "b", "n", "m")), ["a", "b"]).where(f"100 * overlap >= {percent} * (n + m - overlap)")
        out = scratch.put(held.select("a", "b").union(close.where("equal").select("a", "b")), tag)
        scratch.drop(near, close, wanted, segments)
        return out

    copies = feats.where("signed").join(sets.where("rows > 1"), keys).where("row <> rep").select(F.col("rep").alias("a"), F.col("row").alias("b"))

    def placed(df: DataFrame, row: str, name: str) -> DataFrame:
        return df.join(light(label.select(F.col("node").alias(row), F.col("component").alias("_c"))), row, "left").withColumn(name, F.coalesce("_c", row)).drop("_c")

    def crossing(tag: str) -> DataFrame:
        """Ties whose ends are not in one component."""
        return scratch.put(placed(placed(pairs.select("a", "b"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b"), tag)

    # every table goes from the shared folder when the last one that is made of it is written
    nearest = scratch.put(nearest, "nearest")
    linked = [verify(nearest, "links"), scratch.put(copies, "copies")]
    scratch.drop(nearest)
    label = components(linked[0].union(linked[1]), scratch)
    cross = crossing("other-ties")
    if cross.limit(1).count():
        others = verify(cross, "other-links")
        linked.append(others)
        if others.limit(1).count():
            label = merged(label, others, scratch)
            scratch.drop(cross)
            cross = crossing("cross")
    scratch.drop(pairs)
    if cross.limit(1).count():
        ends = cross.select(F.col("a").alias("hub"), F.col("b").alias("row"))
        open_sigs = scratch.put(pick(ties, ends, ["row", "hub"]).select("sig").distinct(), "open")
        tied = pick(ties, open_sigs, ["sig"])
        members = scratch.put(tied.select("sig", "row").union(tied.select("sig", F.col("hub").alias("row"))).distinct(), "members")
        scratch.drop(*parts, open_sigs)
        phase = F.col("sig").bitwiseAND(PHASES - 1)
        own = members.groupBy("row", phase.alias("phase")).agg(F.count("*").alias("of"))
        fit = feats.select("row", "needs").join(own, "row").withColumn("need", F.element_at("needs", F.col("phase").cast("int") + 1)).where("of >= need")
        fit = scratch.put(fit.select("row", "phase", "of", "need"), "fit")
        kept = scratch.put(members.withColumn("phase", phase).join(light(fit), ["row", "phase"]), "kept")
        scratch.drop(members)
        often = kept.groupBy("sig").agg(F.count("*").alias("often"))
        rarest = F.row_number().over(Window.partitionBy("row", "phase").orderBy("often", "sig"))
        prefix = scratch.put(kept.join(often, "sig").withColumn("place", rarest).where("place <= of - need + 1").select("sig", "row"), "prefix")
        scratch.drop(kept)
        some = scratch.put(fit.select("row").distinct(), "some")
        facts = scratch.put(pick(feats, some, ["row"]).select("row", F.struct("n", _short(percent)).alias("f")), "facts")
        scratch.drop(fit, some)

        def still_open() -> DataFrame:
            """Signatures of the prefix whose documents are in several components by now, how many those are, and two of them by random order."""
            place = F.struct(F.xxhash64("row").alias("h"), "row", "component")
            held = placed(prefix, "row", "component").groupBy("sig").agg(
                F.count("*").alias("b"), (F.min("component") < F.max("component")).alias("several"), F.min(place).alias("x"), F.max(place).alias("y")
            )
            return scratch.put(held.where("several").select("sig", "b", "x", "y"), "open-sigs")

        sigs = still_open()
        large = scratch.put(sigs.where(F.col("b") > LARGE).select("sig", "x", "y"), "large")
        if large.limit(1).count():
            met = placed(prefix.join(light(large), "sig"), "row", "component").where("component <> x.component or component <> y.component")
            met = met.select("row", F.array("x.row", "y.row").alias("hubs")).distinct().select("row", F.explode("hubs").alias("hub")).where("row <> hub")
            asked = scratch.put(met.select(F.least("row", "hub").alias("a"), F.greatest("row", "hub").alias("b")).distinct(), "hubs")
            apart = scratch.put(placed(placed(asked, "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b"), "hubs")
            found = verify(apart, "hub-links")
            scratch.drop(asked, apart)
            linked.append(found)
            if found.limit(1).count():
                label = merged(label, found, scratch)
                scratch.drop(sigs)
                sigs = still_open()
        # what a comparison needs goes to each signature that is still open, once
        left = scratch.put(placed(prefix.join(light(sigs.select("sig", "b")), "sig"), "row", "component"), "open-prefix")
        scratch.drop(prefix, sigs, large)
        left = left.join(light(facts), "row")
        blocks = F.ceil(F.col("b") / BUCKET).cast("int")
        side = F.pmod(F.xxhash64("row"), blocks).cast("int")
        dealt = left.select("sig", "row", "component", "f", side.alias("side"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        dealt = dealt.withColumns({"bi": F.least("side", "other"), "bj": F.greatest("side", "other")})
        x, y = (dealt.select("sig", "bi", "bj", *[F.col(c).alias(f"{c}_{i}") for c in ("row", "component", "f", "side")]) for i in "xy")
        apart = f"row_x < row_y and component_x <> component_y and (bi = bj or side_x <> side_y) and {_apart('f_x', 'f_y', percent)}"
        more = x.join(y, ["sig", "bi", "bj"]).where(apart).select(F.col("row_x").alias("a"), F.col("row_y").alias("b")).distinct()
        asked = scratch.put(more, "more")
        more = verify(asked, "more-links")
        scratch.drop(asked, facts)
        linked.append(more)
        if more.limit(1).count():
            label = merged(label, more, scratch)
    else:
        scratch.drop(*parts)
    scratch.drop(cross, *linked)
    named = placed(sets.withColumnRenamed("rep", "row"), "row", "component")
    least = named.groupBy("component").agg(F.min("least").alias("least_of"))
    grouped = scratch.put(named.join(least, "component").select(*keys, F.col("least_of").alias("component")), "grouped")
    scratch.drop(sets)
    return spread(feats, grouped).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def spread(feats: DataFrame, grouped: DataFrame) -> DataFrame:
    """Give every row the component of its class.

    A class may hold a third of all rows.  Classes with at least a thousandth of
    them are at most a thousand, so those are broadcast; the other rows are
    dealt out by class.
    """
    keys = ["n", "p1", "p2"]
    rows = feats.select("id", *keys)
    total = rows.count()
    sizes = rows.where("n > 0").groupBy(*keys).agg(F.count("*").alias("rows"))
    large = F.broadcast(sizes.where(F.col("rows") * 1000 >= total).select(*keys, F.lit(True).alias("large")))
    marked = rows.join(large, keys, "left")
    hot = F.broadcast(grouped.join(large, keys, "left_semi"))
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")
    return (
        marked.where("large").join(hot, keys, "left").select("id", "n", comp)
        .union(marked.where("large is null").join(grouped, keys, "left").select("id", "n", comp))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that have the smallest id of their component.

    Rows without an id stay, as do those with null or blank texts.  Where ids are
    repeated, every row is compared by its own text: of each component one row
    stays, one of those with the smallest id, and no row goes for another that
    only has its id.  An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    number = F.col(id_col).cast("long")
    again = docs.select(number.alias("id")).groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1 and id is not null")
    if again.limit(1).count() == 0:
        name = fresh(docs, "gone")
        found = jaccard_components(docs, id_col, text_col, k, percent)
        gone = scratch.put(found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias(name)), "gone")
        return pick(docs.withColumn(name, number), gone, [name], "left_anti").drop(name)
    row = fresh(docs, "row")
    rows = scratch.put(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    known = rows.where(number.isNotNull())
    parts = jaccard_components(known.select(F.col(row).alias("_row"), F.col(text_col).alias("_text")), "_row", "_text", k, percent)
    found = scratch.put(parts.select("_row", "component_id").join(known.select(F.col(row).alias("_row"), number.alias("_id")), "_row"), "components")
    kept = found.groupBy("component_id").agg(F.min_by("_row", F.struct("_id", "_row")).alias("_row")).select("_row")
    gone = scratch.put(found.select("_row").join(kept, "_row", "left_anti").select(F.col("_row").alias(row)), "gone")
    return pick(rows, gone, [row], "left_anti").select(*docs.columns)
