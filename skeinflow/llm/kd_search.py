"""Approximate nearest neighbours by a kd-tree over stable projections.

Vectors are projected onto ``DIMS`` random Gaussian directions (a 2-stable
projection): the squared projected distance of two vectors, divided by their
squared true distance, follows a chi-square law with ``DIMS`` degrees of freedom.
One kd-tree lies over the projections of all rows.  Its upper levels are split at
the medians of a sample of at most ``SAMPLE`` rows and give at most ``2 ** LEVELS``
cells; a cell's rows are cut into parts of about ``ROWS``, each of which goes on
with a tree of its own, down to leaves of about ``LEAF`` rows.

A query first asks the cell whose box is nearest to its projection.  The k-th
distance found there goes along to the other cells: a query visits those whose
box passes the chi-square test against it, and leaves in them in order of
projected distance, where rows are verified in double precision by their true
distance.  A visit ends where the test says that a row nearer than the k-th best
would, with probability ``SURE``, have a smaller projected distance than anything
still unseen.

Of equal vectors only the k + 1 smallest ids can be among a query's answers, and
only those are searched.  A task holds one part and streams its queries; a part
asked by more than ``QUERIES`` is given to several tasks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.llm._io import Scratch

DIMS, LEAF, SURE = 12, 64, 0.97
#: Rows of a part and queries of a task at about most; levels of the upper tree at least (so that small tables use several tasks too) and at most.
ROWS, QUERIES, LEAST_LEVELS, LEVELS = 16_384, 32_768, 5, 13
#: Rows at most of the sample whose medians split the upper tree.
SAMPLE = 200_000


@lru_cache
def chi_square_point(sure: float, dims: int) -> float:
    """x with P(chi-square with ``dims`` degrees <= x) = sure, by bisection on the incomplete gamma series."""

    def cdf(x: float) -> float:
        a, x = dims / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-14:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0

    low, high = 0.0, dims * 20.0 + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < sure else (low, mid)
    return high


def projection(width: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, width]).normal(size=(width, DIMS))


class KdTree:
    """Leaves of a kd-tree: rows in leaf order, the leaves' bounds and boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        bounds, todo = [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            part = points[self.order[a:b]]
            wide = np.ptp(part, axis=0)
            if b - a <= leaf or not wide.any():
                bounds.append((a, b))
                continue
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, wide.argmax()], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        self.bounds = np.array(sorted(bounds))
        self.points = points[self.order]
        starts = self.bounds[:, 0]
        self.low, self.high = (f.reduceat(self.points, starts, axis=0) for f in (np.minimum, np.maximum))

    def nearest_leaves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by squared distance of their boxes to ``q``, and those distances."""
        gap = np.maximum(0, np.maximum(self.low - q, q - self.high))
        far = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(far, kind="stable")
        return order, far[order]


class Cells:
    """Upper levels of the kd-tree: medians of a sample's projections, in heap order; a node without rows to split sends all to its left."""

    def __init__(self, points: np.ndarray, levels: int):
        self.levels = levels
        self.dims, self.splits = np.zeros(2**levels - 1, np.int64), np.full(2**levels - 1, np.inf)
        parts = {0: points}
        for node in range(2**levels - 1):
            part = parts.pop(node)
            wide = np.ptp(part, axis=0) if len(part) > 1 else np.zeros(1)
            if wide.any():
                self.dims[node] = dim = int(wide.argmax())
                split = np.median(part[:, dim])
                self.splits[node] = split if split > part[:, dim].min() else np.nextafter(split, np.inf)
            right = part[:, self.dims[node]] >= self.splits[node]
            parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.dims[node]] >= self.splits[node])
        return (node - (2**self.levels - 1)).astype(np.int32)


def search(
    tree: KdTree, vectors: np.ndarray, ids: np.ndarray, own: int, query: np.ndarray, projected: np.ndarray, k: int, stop: float, least: float = math.inf
) -> tuple[np.ndarray, np.ndarray]:
    """Positions and squared distances of the k best rows found for one query, none over ``least``; ``vectors`` and ``ids`` in leaf order."""
    order, far = tree.nearest_leaves(projected)
    best, place = np.zeros(0), np.zeros(0, np.int64)
    at, step = 0, 1
    while at < len(order):
        limit = min(best[-1] if len(best) == k else np.inf, least) * stop
        if far[at] > limit:  # chi-square test
            break
        group = order[at : at + step]
        group = group[far[at : at + step] <= limit]
        rows = np.concatenate([np.arange(a, b) for a, b in tree.bounds[group].tolist()])
        if limit < np.inf:
            gap = tree.points[rows] - projected
            rows = rows[np.einsum("ij,ij->i", gap, gap) <= limit]
        rows = rows[ids[rows] != own]
        diff = vectors[rows] - query
        dist = np.concatenate((best, np.einsum("ij,ij->i", diff, diff)))
        rows = np.concatenate((place, rows))
        near = dist <= least
        if near.sum() > k:
            near &= dist <= np.partition(dist[near], k - 1)[k - 1]
        dist, rows = dist[near], rows[near]
        pick = np.lexsort((ids[rows], dist))[:k]
        best, place = dist[pick], rows[pick]
        at, step = at + step, min(step * 2, 16)
    return place, best


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy(zero_copy_only=False)


def _by_width(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch, np.ndarray]]:
    """For batches whose last column holds vectors: those of one length as a matrix, and their rows."""
    for batch in batches:
        flat, lengths = _vectors(batch.column(batch.num_columns - 1))
        starts = np.cumsum(lengths) - lengths
        for d in np.unique(lengths):
            take = np.flatnonzero(lengths == d)
            for at in range(0, len(take), 4096):
                some = take[at : at + 4096]
                yield flat[starts[some][:, None] + np.arange(d)], batch, some


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for vec, _, some in _by_width(batches):
        yield pa.record_batch([_lists((vec @ projection(vec.shape[1])).ravel(), np.full(len(some), DIMS))], names=["at"])


def _placed(cells: Cells):
    """Rows (id, vec) with their cell and projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vec, batch, some in _by_width(batches):
            at = vec @ projection(vec.shape[1])
            rows = batch.take(pa.array(some))
            yield pa.record_batch([pa.array(cells.of(at)), _lists(at.ravel(), np.full(len(some), DIMS)), *rows.columns], names=["cell", "at", "id", "vec"])

    return run


def _routed(names: np.ndarray, low: np.ndarray, high: np.ndarray, stop: float):
    """Queries (id, bound, vec) with the cells to visit: without a bound the nearest one, else all others that pass the test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vec, batch, some in _by_width(batches):
            rows = batch.take(pa.array(some))
            first = rows.column(1).is_null().to_numpy(zero_copy_only=False)
            bound = rows.column(1).fill_null(math.inf).to_numpy(zero_copy_only=False)
            counts, picked = np.zeros(len(some), np.int64), []
            for i, at in enumerate(vec @ projection(vec.shape[1])):
                gap = np.maximum(0, np.maximum(low - at, at - high))
                far = np.einsum("ij,ij->i", gap, gap)
                home = int(far.argmin())
                visit = np.array([home]) if first[i] else np.flatnonzero(far <= bound[i] ** 2 * (1 + 1e-12) * stop)
                picked.append(names[visit if first[i] else visit[visit != home]])
                counts[i] = len(picked[-1])
            yield pa.record_batch([*rows.columns, _lists(np.concatenate(picked), counts)], names=["id", "bound", "vec", "cells"])

    return run


def _search_blocks(k: int, sure: float):
    """Rows arrive in order of (cell, part, task, length, is a query); the rows of a part make a tree, and its queries follow in a stream."""
    stop = chi_square_point(sure, DIMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree, vec, ids = None, [], None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            asks = batch.column(4).to_numpy(zero_copy_only=False)
            names, bounds = batch.column(5).to_numpy(), batch.column(6).fill_null(math.inf).to_numpy(zero_copy_only=False)
            flat, lengths = _vectors(batch.column(7))
            starts = np.cumsum(lengths) - lengths
            new = (keys[1:] != keys[:-1]).any(1) | (asks[1:] != asks[:-1])
            for a, b in itertools.pairwise([0, *(np.flatnonzero(new) + 1).tolist(), len(names)]):
                this = tuple(keys[a].tolist())
                if this != key:
                    key, held, tree = this, [], None
                some = flat[starts[a] : starts[b - 1] + lengths[b - 1]].reshape(b - a, this[3])
                if not asks[a]:
                    held.append((names[a:b], some))
                    continue
                if tree is None:
                    if not held:
                        continue
                    ids, vec = (np.concatenate(x) for x in zip(*held, strict=True))
                    held, tree = [], KdTree(vec @ projection(this[3]))
                    vec, ids = vec[tree.order], ids[tree.order]
                for at in range(a, b, 512):
                    out: list[list] = [[], [], []]
                    queries = some[at - a : at - a + 512]
                    for own, least, q, p in zip(names[at : at + 512].tolist(), bounds[at : at + 512].tolist(), queries, queries @ projection(this[3]), strict=False):
                        place, dist = search(tree, vec, ids, own, q, p, k, stop, least * least * (1 + 1e-12))
                        out[0].append(np.full(len(place), own))
                        out[1].append(ids[place])
                        out[2].append(np.sqrt(dist))
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", sure: float = SURE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k rows found nearest to each query, by Euclidean distance.

    A row with the query's id is no candidate; ties go to the smaller id.  Null,
    empty or zero vectors, those with null or non-finite parts, and rows without
    an id take no part; vectors of other lengths than the query's are no
    candidates.  Ids are taken as unique; of candidates that repeat an id one
    counts, the nearest.  With fewer candidates than k, all are returned.  Empty
    tables give an empty table.  Other columns are not read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "kd")
    stop = chi_square_point(sure, DIMS)
    small = all(df.schema[vec_col].dataType.simpleString() == "array<float>" for df in (rows, queries))
    kind = "array<float>" if small else "array<double>"

    def sound(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec"))
        return df.where("id is not null and size(vec) > 0").where(
            ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
        )

    def ranked(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    data = sound(rows)
    total = rows.count()
    levels = min(LEVELS, max(LEAST_LEVELS, math.ceil(math.log2(max(1, total / ROWS)))))
    part_of = min(1.0, SAMPLE / 2 / max(1, total))
    sample = data.sample(part_of, seed=5).select("vec").mapInArrow(_sampled, "at array<double>").limit(SAMPLE).collect()
    cells = Cells(np.array([r.at for r in sample]).reshape(-1, DIMS), levels)
    copy = F.dense_rank().over(Window.partitionBy("p1", "p2").orderBy("id"))
    single = data.withColumns({"p1": F.xxhash64("vec"), "p2": F.xxhash64(F.lit(1), "vec")}).withColumn("copy", copy).where(F.col("copy") <= k + 1)
    single = single.dropDuplicates(["p1", "p2", "id"]).select("id", "vec")
    dealt = scratch.put(single.mapInArrow(_placed(cells), f"cell int, at array<double>, id long, vec {kind}"), "dealt")
    coords = [F.element_at("at", i + 1) for i in range(DIMS)]
    boxes = dealt.groupBy("cell").agg(F.count("*").alias("rows"), F.array(*map(F.min, coords)).alias("low"), F.array(*map(F.max, coords)).alias("high")).collect()
    low, high = (np.array([r[x] for r in boxes]).reshape(-1, DIMS) for x in ("low", "high"))
    parts = spark.createDataFrame([(r.cell, -(-r["rows"] // ROWS)) for r in boxes], "cell int, parts int")  # at most 2 ** LEVELS rows
    asked = scratch.put(sound(queries).dropDuplicates(["id"]), "asked")
    names = np.array([r.cell for r in boxes], np.int32)

    def visit(some: DataFrame, tag: str) -> DataFrame:
        """What ``some`` queries (id, bound, vec) find in the cells they are to visit."""
        if not len(names):
            some = some.limit(0)
        routed = some.mapInArrow(_routed(names, low, high, stop), f"id long, bound double, vec {kind}, cells array<int>")
        routed = scratch.put(routed, f"{tag}-routed").select("id", "bound", "vec", F.explode("cells").alias("cell"))
        tasks = F.ceil(F.count("*") / QUERIES).cast("int")
        plan = F.broadcast(scratch.put(routed.groupBy("cell").agg(tasks.alias("tasks")).join(parts, "cell"), f"{tag}-plan"))
        sides = [F.size("vec").alias("width")]
        stored = dealt.join(plan, "cell").select(
            "cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"),
            *sides, F.lit(False).alias("asks"), "id", F.lit(None).cast("double").alias("bound"), "vec",
        )
        asking = routed.join(plan, "cell").select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id", F.lit(1)), "tasks").cast("int").alias("task"),
            *sides, F.lit(True).alias("asks"), "id", "bound", "vec",
        )
        count = max(2**levels, -(-total // ROWS))
        groups = stored.union(asking).repartition(count, "cell", "part", "task").sortWithinPartitions("cell", "part", "task", "width", "asks")
        return scratch.put(groups.mapInArrow(_search_blocks(k, sure), "query_id long, vec_id long, score double"), f"{tag}-found")

    home = scratch.put(ranked(visit(asked.select("id", F.lit(None).cast("double").alias("bound"), "vec"), "home")), "home")
    bound = home.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    rest = asked.join(bound, "id", "left").select("id", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), "vec")
    return ranked(home.select("query_id", "vec_id", "score").union(visit(rest, "rest")))
