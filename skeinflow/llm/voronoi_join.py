"""Exact top-k inner products by a Voronoi join.

Pivots are spread over a bounded sample; every query and every candidate belongs
to the cell of its nearest pivot.  With query q = p + f and candidate s = o + e
around their pivots p and o, q.s = p.o + f.o + q.e, so

    p.o - F |o| - (|p| + F) |e|  <=  q.s  <=  p.o + F |o| + (|p| + F) |e|

where F is the largest |f| of the query cell.  From the candidates' summaries
(the smallest |e| of each cell) follows a score that every query of a cell is
sure to reach k times, and from that the least |e|, for each pair of cells, and
the least |s| that a candidate needs to matter.  Only such candidates are sent to
the cell's group.

Cells of queries are joined to groups, each at most ``QUERIES`` queries a block;
candidates of a group are dealt out over slices by id, so a hot cell, of either
kind, is spread.  A task holds one block of queries and streams one slice, the
nearest cells first, and leaves out queries whose k-th score a cell can't reach.
Products are exact whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.llm._io import Scratch
from skeinflow.llm._vectors import Best, norms, products, runs, sound, wide, whole

#: Pivots at most and at least, rows for each, and rows of the sample they are taken from at most.
PIVOTS, LEAST_PIVOTS, FOR_EACH, SAMPLE = 512, 16, 2048, 20_000
#: Queries of a block and candidates of a slice at about most; products held at once.
QUERIES, ROWS, HELD = 16_384, 262_144, 1 << 21
#: Rows that share a query's id up to which cells promise a score; with more, nothing is pruned.
OWN = 16
#: Bounds are computed in doubles and widened by this share.
SLACK = 1e-9


def spread(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` pivots: the origin, then again and again the sample's row farthest from those taken."""
    out = [np.zeros(sample.shape[1])]
    far = norms(sample)
    while len(out) < count and len(sample) and far.max() > 0:
        out.append(sample[far.argmax()])
        far = np.minimum(far, norms(sample - out[-1]))
    return np.array(out)


def assign(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row, and its distance."""
    d = max(x.shape[1], pivots.shape[1])
    x, p = wide(x, d), wide(pivots, d)
    cell = (np.einsum("ij,ij->i", p, p) - 2 * (x @ p.T)).argmin(1)
    return cell.astype(np.int32), norms(x - p[cell])


def _assigned(pivots: np.ndarray, scale: float):
    """Rows (id, own, vec) with cell, distance to the pivot and norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = whole(part.column(2), scale)
                cell, far = assign(x, pivots)
                yield pa.record_batch([pa.array(cell), pa.array(far), pa.array(norms(x)), *part.columns], names=["cell", "far", "norm", "id", "own", "vec"])

    return run


def plan(pivots: np.ndarray, asked: dict[int, tuple[int, float]], held: dict[int, tuple[int, float, float]], near: dict[int, list[float]], need: int | None, tasks: int) -> list[tuple]:
    """Rows (cell, group, blocks, slices, turn, least_far, least_norm) for candidate cells, and (cell, group) of query cells as rows with turn -1.

    ``asked``: queries and largest distance of each query cell; ``held``: count,
    largest distance and largest norm of each candidate cell; ``near``: the
    smallest distances of each candidate cell; ``need``: how many candidates must
    be promised to a query, None if nothing can be.
    """
    size, dots = norms(pivots), pivots @ pivots.T
    cells = sorted(held)
    reached, least_norm = {}, {}
    for i, (_, far) in asked.items():
        loss = size[i] + far
        promised = sorted((dots[i, j] - far * size[j] - loss * d for j in cells for d in near[j]), reverse=True)
        sure = promised[need - 1] if need and len(promised) >= need else -math.inf
        sure -= SLACK * (abs(sure) + 1) if sure > -math.inf else 0
        reached[i] = {j: (sure - dots[i, j] - far * size[j]) / loss * (1 - SLACK) - SLACK if loss and sure > -math.inf else -math.inf for j in cells}
        least_norm[i] = max(-math.inf, sure / loss * (1 - SLACK) - SLACK) if loss and sure > -math.inf else -math.inf
    # groups: from a cell on to the nearest one left, until a block is full
    groups, left = [], sorted(asked, key=lambda i: -asked[i][0])
    while left:
        group = [left.pop(0)]
        while left and sum(asked[i][0] for i in group) < QUERIES:
            group.append(left.pop(int(np.argmin([size[i] ** 2 - 2 * dots[i, group[0]] for i in left]))))
        groups.append(group)
    out = []
    for g, group in enumerate(groups):
        blocks = math.ceil(sum(asked[i][0] for i in group) / QUERIES)
        reach = {j: min(reached[i][j] for i in group) for j in cells}
        norm = min(least_norm[i] for i in group)
        meet = [j for j in cells if held[j][1] >= reach[j] and held[j][2] >= norm]
        rows = sum(held[j][0] for j in meet)
        slices = max(1, math.ceil(rows / ROWS), min(math.ceil(rows / 512), math.ceil(tasks / len(groups) / blocks)))
        turns = sorted(meet, key=lambda j: -max(dots[i, j] for i in group))
        out += [(j, g, blocks, slices, t, float(reach[j]), float(norm)) for t, j in enumerate(turns)]
        out += [(i, g, blocks, slices, -1, 0.0, 0.0) for i in group]
    return out


def _solve(pivots: np.ndarray, scale: float, k: int):
    """Rows arrive in order of (group, block, slice, turn); turn -1 are the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asks, q, best = None, [], None, None

        def flush():
            if best is not None:
                r, ids, score = best.rows()
                yield pa.record_batch([pa.array(names[r]), pa.array(owns[r]), pa.array(ids), pa.array(score)], names=["query_id", "own", "vec_id", "score"])

        for (*task, turn, cell), part in runs(batches, 5):
            if task != key:
                yield from flush()
                key, asks, q, best = task, [], None, None
            if turn < 0:
                asks.append((part.column(5).to_numpy(), part.column(6).to_numpy(), whole(part.column(8), scale)))
                continue
            if not asks:
                continue
            s = whole(part.column(8), scale)
            ids, far = part.column(5).to_numpy(), part.column(7).to_numpy()
            if q is None:
                d = max(x[2].shape[1] for x in asks)
                names, owns, q = np.concatenate([x[0] for x in asks]), np.concatenate([x[1] for x in asks]), np.concatenate([wide(x[2], d) for x in asks])
                length, by_name = norms(q), np.argsort(names, kind="stable")
            d = max(q.shape[1], s.shape[1], pivots.shape[1])
            q, s = wide(q, d), wide(s, d)
            bound = float(length.max()) * float(norms(s).max()) * (1 + SLACK)
            kind = np.float64 if bound < 1 << 53 else np.int64
            if best is None:
                best = Best(len(q), k, kind)
            elif kind is np.int64 and best.score.dtype != np.int64:
                none = best.score == best.low
                best.score, best.low = np.where(none, 0, best.score).astype(np.int64), -((1 << 63) - 1)
                best.score[none] = best.low
            reach = q @ wide(pivots[cell : cell + 1], d)[0]
            step = max(1, HELD // len(q))
            for at in range(0, len(s), step):
                most = reach + length * far[at : at + step].max()
                most += SLACK * (np.abs(most) + 1)
                some = np.flatnonzero(most >= best.score[:, -1])
                if not len(some):
                    continue
                got = products(q[some], s[at : at + step], bound)
                got = got.astype(best.score.dtype, copy=False)
                mine = ids[at : at + step]
                a, b = (np.searchsorted(names[by_name], mine, side) for side in ("left", "right"))
                for c in np.flatnonzero(b > a).tolist():  # a query's own row
                    at_row = np.searchsorted(some, own := np.sort(by_name[a[c] : b[c]]))
                    fits = (at_row < len(some)) & (some[np.minimum(at_row, len(some) - 1)] == own)
                    got[at_row[fits], c] = best.low
                best.put(some, got, mine)
        yield from flush()

    return run


def top_products(rows: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k rows with the highest inner products of floor(scale * x) with each query.

    Exact: ties go to the smaller id, with fewer candidates than k all are
    returned.  A row with the query's id is no candidate.  Null vectors, those
    with null or non-finite parts (also after scaling) and rows without an id
    take no part; a shorter vector counts as if it ended in zeros, an empty one as
    zeros.  Rows that repeat an id are each a candidate; equal query rows are
    answered once, queries that share an id but not the vector each.  Products
    beyond 64 bits are an error.  Empty tables give an empty table.  Other
    columns are not read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "voronoi")
    data = sound(rows, id_col, vec_col, scale)
    total = rows.count()
    some = data.sample(min(1.0, 2.0 * SAMPLE / max(1, total)), seed=3).select("vec").limit(SAMPLE).toArrow()
    sample = whole(some.column(0).combine_chunks(), scale) if some.num_rows else np.zeros((0, 1))
    pivots = spread(sample, min(PIVOTS, max(LEAST_PIVOTS, total // FOR_EACH)))
    own = F.xxhash64("vec").alias("own")
    kind = data.schema["vec"].dataType.simpleString()

    def coded(df: DataFrame, tag: str) -> DataFrame:
        return scratch.put(df.mapInArrow(_assigned(pivots, scale), f"cell int, far double, norm double, id long, own long, vec {kind}"), tag)

    held = coded(data.select("id", F.lit(0).cast("long").alias("own"), "vec"), "rows")
    ask = sound(queries, id_col, vec_col, scale)
    ask = ask.select("id", own, F.col("vec").cast(kind)).dropDuplicates(["id", "own"])
    asked = coded(ask, "queries")
    mine = held.select("id").join(asked.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    need = k + mine if mine <= OWN else None
    inside = held.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect()
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("far"))
    near: dict[int, list[float]] = {r.cell: [] for r in inside}
    for r in held.select("cell", "far", rank.alias("r")).where(F.col("r") <= (need or 1)).collect():  # at most pivots times k and a few
        near[r.cell].append(r.far)
    outside = asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    slots = spark.sparkContext.defaultParallelism
    made = plan(pivots, {r.cell: (r.n, r.far) for r in outside}, {r.cell: (r.n, r.far, r.norm) for r in inside}, near, need, 2 * slots)
    table = spark.createDataFrame(made, "cell int, grp int, blocks int, slices int, turn int, least_far double, least_norm double")  # at most pivots squared
    met = held.join(F.broadcast(table.where("turn >= 0")), "cell").where("far >= least_far and norm >= least_norm")
    candidates = met.select(
        "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), "slices").cast("int").alias("slice"),
        "turn", "cell", "id", "own", "far", "vec",
    )
    asking = asked.join(F.broadcast(table.where("turn < 0")), "cell").select(
        "grp", F.pmod(F.xxhash64("id", "own"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
        "turn", "cell", "id", "own", "far", "vec",
    )
    parts = {(g, b, s) for _, g, b, s, *_ in made}
    count = max(1, slots, sum(b * s for _, b, s in parts))
    dealt = candidates.union(asking).repartition(count, "grp", "block", "slice").sortWithinPartitions("grp", "block", "slice", "turn", "cell")
    found = scratch.put(dealt.mapInArrow(_solve(pivots, scale, k), "query_id long, own long, vec_id long, score long"), "found")
    place = F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
