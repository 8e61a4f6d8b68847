"""Near-duplicate embeddings by E8 lattice hashing.

Each of ``TABLES`` tables projects a unit vector by random Gaussian maps onto
``BLOCKS`` eight-dimensional spaces, scaled by ``WIDTH``, and decodes each to its
nearest E8 lattice point.  The vector enters the cell of its decoded points and
those reached by stepping one block to one of its ``PROBES`` next nearest
lattice neighbours (of the 240 minimal vectors).  Two vectors meet where any of
their cells are the same; their cosine is then checked in double precision.
Cells with the same members are compared once, in the first of them.

Chance to meet (simulated, 64 dimensions): 0.92 a table at cosine 0.95, so
0.9995 with three, and more above.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm._bytes import mix
from skeinflow.llm._graph import components
from skeinflow.llm._io import Scratch

TABLES, BLOCKS, WIDTH, PROBES = 3, 2, 2.0, 4
#: Members of a cell that are held in memory and compared at once; larger cells are cut into blocks of about this size.
CELL = 1024
_U = np.uint64
_KEYS = 1 + BLOCKS * PROBES


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            whole.append(v)
    half = [v for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(whole + [np.array(v) for v in half])


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 for each row: the better of D8 and D8 shifted by one half."""

    def d8(y):
        near = np.rint(y)
        off = y - near
        worst = np.abs(off).argmax(1)
        row = np.arange(len(y))
        other = near.copy()
        other[row, worst] += np.where(off[row, worst] >= 0, 1, -1)
        return np.where((near.sum(1).astype(np.int64) & 1 == 1)[:, None], other, near)

    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def cell_keys(unit: np.ndarray, seed: int = 7) -> np.ndarray:
    """For each unit vector: TABLES * (1 + BLOCKS * PROBES) cell keys, table by table."""
    minimal = _minimal()
    rng = np.random.default_rng([seed, unit.shape[1]])
    odd = (rng.integers(1, 1 << 62, 8).astype(_U) << _U(1)) | _U(1)
    out = []
    for t in range(TABLES):
        cells = []
        for b in range(BLOCKS):
            y = unit @ rng.normal(size=(unit.shape[1], 8)) / WIDTH
            home = decode_e8(y)
            near = np.argpartition(-((y - home) @ minimal.T), PROBES, axis=1)[:, :PROBES]
            points = np.concatenate([home[:, None], home[:, None] + minimal[near]], 1)
            whole = np.rint(2 * points).astype(np.int64).view(_U)
            cells.append(mix((whole * odd).sum(2, dtype=_U) + _U(t * 31 + b + 1) + _U(unit.shape[1] << 20)))
        home = [c[:, :1] for c in cells]
        for b in range(BLOCKS):
            rest = [home[o] for o in range(BLOCKS) if o != b]
            steps = cells[b] if b == 0 else cells[b][:, 1:]
            for o in rest:
                steps = steps + o
            out.append(mix(steps))
    return np.concatenate(out, 1).view(np.int64)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lengths


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, lengths = _matrix(batch.column(2))
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        for d in np.unique(lengths):
            rows = np.flatnonzero(lengths == d)
            for at in range(0, len(rows), 2048):
                take = rows[at : at + 2048]
                keys = cell_keys(_unit(flat[starts[take][:, None] + np.arange(d)]))
                some = batch.take(pa.array(take))
                off = pa.array(np.arange(len(take) + 1, dtype=np.int32) * keys.shape[1])
                yield pa.record_batch([*some.columns, pa.ListArray.from_arrays(off, pa.array(keys.ravel()))], names=["id", "copies", "vec", "keys"])


def _compare(least: float):
    """Within each run of equal (key, bi, bj): count the links that no earlier shared cell has, and span them by edges."""

    def held(group, links, edges):
        key, bi, bj, ids, copies, side, vec, keys = group
        if bi == bj:
            one = two = np.arange(len(ids))
        else:
            one, two = np.flatnonzero(side == bi), np.flatnonzero(side == bj)
        if not len(one) or not len(two) or len(ids) < 2:
            return
        close = vec[one] @ vec[two].T >= least
        if bi == bj:
            close = np.triu(close, 1)
        i, j = np.nonzero(close)
        i, j = one[i], two[j]
        table = int(np.flatnonzero((keys[ids.argmin()] == key))[0]) // _KEYS
        for at in range(0, len(i), 50_000):
            p, q = i[at : at + 50_000], j[at : at + 50_000]
            for t in range(table + 1):
                a, b = keys[p, t * _KEYS : (t + 1) * _KEYS], keys[q, t * _KEYS : (t + 1) * _KEYS]
                same = a[:, :, None] == b[:, None, :]
                if t == table:
                    same &= (a < key)[:, :, None]
                new = ~same.any((1, 2))
                p, q = p[new], q[new]
            if len(p):
                links.append((ids[p], copies[q]))
                links.append((ids[q], copies[p]))
                spanned = spanning(p, q, len(ids))
                edges.append((ids[p[spanned]], ids[q[spanned]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, edges, pending = [], [], None

        def flush():
            for kind, rows in ((0, links), (1, edges)):
                if rows:
                    a, b = (np.concatenate([r[x] for r in rows]) for x in (0, 1))
                    if kind == 0:
                        a, where = np.unique(a, return_inverse=True)
                        b = np.bincount(where, weights=b).astype(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])
            links.clear()
            edges.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            flat, lengths = _matrix(batch.column(6))
            d = int(lengths.max())
            vec = np.zeros((len(lengths), d))
            vec[np.arange(d) < lengths[:, None]] = flat
            known = batch.column(7).value_lengths().to_numpy()
            keys = np.zeros((len(lengths), TABLES * _KEYS), np.int64)  # those of the cell's table and earlier ones; held looks at no others
            keys[np.arange(keys.shape[1]) < known[:, None]] = batch.column(7).flatten().to_numpy()
            cols = [batch.column(c).to_numpy() for c in range(6)]
            rows = [*cols, _unit(vec), keys]
            if pending is not None:
                if pending[6].shape[1] < d:
                    pending[6] = np.pad(pending[6], ((0, 0), (0, d - pending[6].shape[1])))
                elif pending[6].shape[1] > d:
                    rows[6] = np.pad(rows[6], ((0, 0), (0, pending[6].shape[1] - d)))
                rows = [np.concatenate(x) for x in zip(pending, rows, strict=True)]
            new = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])
            bounds = [0, *(np.flatnonzero(new) + 1).tolist()]
            for a, b in itertools.pairwise(bounds):
                held((rows[0][a], rows[1][a], rows[2][a], *(x[a:b] for x in rows[3:])), links, edges)
            pending = [x[bounds[-1] :].copy() for x in rows]
            yield from flush()
        if pending is not None:
            held((pending[0][0], pending[1][0], pending[2][0], *pending[3:]), links, edges)
            yield from flush()

    return run


def spanning(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """Positions of links that span the same components as all of them."""
    root = list(range(n))
    keep = []
    for k, (a, b) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[b] = a
            keep.append(k)
            if len(keep) == n - 1:
                break
    return np.array(keep, np.int64)


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95
) -> DataFrame:
    """One row per input row: the id, ``n_links``, ``component_id`` and ``kept``.

    Pairs with cosine >= least that meet in a cell are links; ``n_links`` counts
    the other rows linked directly, ``component_id`` is the smallest id reachable
    (itself included), ``kept`` tells whether that is the row's own id.  Equal
    vectors are compared once and counted as often as they occur.  Null, empty or
    zero vectors, and those with null or non-finite parts, link with nothing;
    nor do vectors of different lengths.  Rows that repeat an id are each compared,
    and each is a row of the result; a row without an id gets a null component.  An empty table gives an empty table.  Columns
    other than ``id_col`` and ``vec_col`` are not read.
    """
    scratch = Scratch(vectors.sparkSession, "lattice")
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec"))
    fine = F.coalesce(
        (F.size("vec") > 0)
        & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vec", lambda x: x != 0),
        F.lit(False),
    ) & F.col("id").isNotNull()
    prints = rows.where(fine).withColumns({"p1": F.xxhash64("vec"), "p2": F.xxhash64(F.lit(1), "vec")})
    # a class of equal vectors has a number of its own: an id may be on several rows
    classes = prints.groupBy("p1", "p2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    named = scratch.put(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    coded = scratch.put(named.select("id", "copies", "vec").mapInArrow(_code, f"id long, copies long, vec {kind}, keys array<long>"), "coded")
    entries = coded.select("id", F.posexplode("keys").alias("pos", "key"))
    cells = entries.groupBy("key").agg(
        F.count("*").alias("n"), F.min(F.floor(F.col("pos") / _KEYS)).alias("table"),
        F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("x2"),
    ).where("n > 1")
    # the first cell, in _compare's order, of those with the same members: no link's first shared cell is left out
    firsts = cells.groupBy("n", "x1", "x2").agg(F.min(F.struct("table", "key")).alias("first")).select("n", "first.*")
    placed = entries.select("id", "key").join(scratch.put(firsts, "cells"), "key").withColumn("nb", F.ceil(F.col("n") / CELL).cast("int")).withColumn(
        "side", F.pmod(F.xxhash64("id", "key"), F.col("nb")).cast("int")
    )
    met = placed.select(
        "key", "table", "id", "side", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")
    ).select("key", "table", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"), "id", "side")
    known = F.slice("keys", 1, ((F.col("table") + 1) * _KEYS).cast("int")).alias("keys")
    full = met.join(coded, "id").select("key", "bi", "bj", "id", "copies", "side", "vec", known)
    dealt = full.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    found = scratch.put(dealt.mapInArrow(_compare(least), "kind int, a long, b long"), "found")
    label = components(found.where("kind = 1").select("a", "b"), scratch).withColumnsRenamed({"node": "id", "component": "group"})
    counts = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("linked"))
    grouped = scratch.put(
        named.select("id", "p1", "p2", "rep", "copies").join(label, "id", "left").join(counts, "id", "left").select(
            "p1", "p2", "rep", "copies", F.coalesce("group", "id").alias("group"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        ),
        "grouped",
    )
    least = grouped.groupBy("group").agg(F.min("rep").alias("component"))
    facts = scratch.put(grouped.join(least, "group").select("p1", "p2", "copies", "component", "n_links"), "facts")
    # a class may hold a third of all rows: at most 1,000 classes have a thousandth of them or more, and those are broadcast
    total = rows.count()
    large = facts.where(F.col("copies") * 1000 >= total)
    tagged = rows.select("id", F.when(fine, F.xxhash64("vec")).alias("p1"), F.when(fine, F.xxhash64(F.lit(1), "vec")).alias("p2"))
    keys = ["p1", "p2"]
    marked = tagged.join(F.broadcast(large.select(*keys, F.lit(True).alias("large"))), keys, "left")
    joined = (
        marked.where("large").join(F.broadcast(large), keys, "left").select("id", "component", "n_links")
        .union(marked.where("large is null").join(facts, keys, "left").select("id", "component", "n_links"))
    )
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (component == F.col("id")).alias("kept"),
    )
