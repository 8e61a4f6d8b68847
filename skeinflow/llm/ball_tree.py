"""Hard negatives by branch and bound on ball trees.

Rows are dealt into parts: a frequent label has parts of its own, rare ones share.
A task holds one part as a tree of balls (centre, radius) and streams anchors.
For an anchor q, a ball's inner products lie in q.c - |q| r .. q.c + |q| r.  A
node is left out if that range misses the window of scores that is asked for, or
lies strictly beneath the k-th best score found in it; the rest is visited from
the highest upper bound on.  Products are exact whole numbers.

First each anchor's positives are searched in the parts of its own label, with
an open window; their scores give the windows in which negatives are then
searched in the parts of all other labels, one walk for all windows of an anchor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.llm._io import Scratch
from skeinflow.llm._vectors import norms, products, runs, sound, wide, whole

#: Rows of a part and parts of one kind at about most; anchors of a task; rows of a leaf.
ROWS, PARTS, ANCHORS, LEAF = 65_536, 20_000, 16_384, 128
#: Bounds are computed in doubles and widened by this share.
SLACK = 1e-9


class BallTree:
    """Balls over whole-number rows.  Leaves hold one label each unless it has few rows; ``label`` is then None."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF):
        order = np.argsort(labels, kind="stable")
        kinds, start, count = np.unique(labels[order], return_index=True, return_counts=True)
        rare = order[np.repeat(count < leaf // 4, count)]
        groups = [(int(k), order[a : a + n]) for k, a, n in zip(kinds, start, count, strict=True) if n >= leaf // 4]
        if len(rare):
            groups.append((None, rare))
        self.centre, self.radius, self.kids, self.span, self.label, self.roots, rows = [], [], [], [], [], [], []
        at = 0
        for label, members in groups:
            self.roots.append(len(self.centre))
            todo = [(self._node(x, members, label), members)]
            while todo:
                node, own = todo.pop()
                part = x[own]
                wide_ = np.ptp(part, axis=0) if len(own) > leaf else None
                if wide_ is None or not wide_.any():
                    self.span[node] = (at, at + len(own))
                    rows.append(own)
                    at += len(own)
                    continue
                mid = len(own) // 2
                cut = np.argpartition(part[:, wide_.argmax()], mid)
                sides = own[cut[:mid]], own[cut[mid:]]
                self.kids[node] = tuple(self._node(x, s, label) for s in sides)
                todo += list(zip(self.kids[node], sides, strict=True))
        order = np.concatenate(rows)
        self.x, self.ids, self.labels = x[order], ids[order], labels[order]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.longest = float(norms(self.x).max())

    def _node(self, x: np.ndarray, members: np.ndarray, label: int | None) -> int:
        part = x[members]
        centre = part.mean(0)
        self.centre.append(centre)
        self.radius.append(float(norms(part - centre).max()))
        self.kids.append(())
        self.span.append(())
        self.label.append(label)
        return len(self.centre) - 1

    def leaves(self, q: np.ndarray, low: int, high: int, wanted) -> list[tuple[float, float, int]]:
        """(upper bound, lower bound, leaf) of the leaves whose range meets low..high; ``wanted`` chooses labels."""
        length = float(np.sqrt(q @ q))
        todo, out = np.array([r for r in self.roots if self.label[r] is None or wanted(self.label[r])], np.int64), []
        while len(todo):  # a level at a time
            middle, reach = self.centre[todo] @ q, length * self.radius[todo]
            reach = reach + SLACK * (np.abs(middle) + reach + 1)
            fits = (middle + reach >= low) & (middle - reach <= high)
            below = []
            for node, up, down in zip(todo[fits].tolist(), (middle + reach)[fits].tolist(), (middle - reach)[fits].tolist(), strict=True):
                if self.kids[node]:
                    below += self.kids[node]
                else:
                    out.append((up, down, node))
            todo = np.array(below, np.int64)
        return out


def search(tree: BallTree, q: np.ndarray, own: int, label: int, same: bool, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the k best rows of each window low..high, of the label or of others; a row with the id ``own`` is none."""
    low, high = min(w[0] for w in windows), max(w[1] for w in windows)
    found = sorted(tree.leaves(q, low, high, (lambda x: x == label) if same else (lambda x: x != label)), key=lambda x: (-min(x[0], high), x[2]))
    bound = float(np.sqrt(q @ q)) * tree.longest * (1 + SLACK)
    names, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = [w[0] for w in windows]  # the k-th best of a window so far, else its lower end
    at, step = 0, 1
    while at < len(found):
        group = [x for x in found[at : at + step] if any(x[0] >= worst and x[1] <= w[1] for worst, w in zip(least, windows, strict=True))]
        at, step = at + step, min(2 * step, 32)
        if group:
            rows = np.concatenate([np.arange(*tree.span[x[2]]) for x in group])
            rows = rows[(tree.ids[rows] != own) & ((tree.labels[rows] == label) == same)]
            got = products(q[None, :], tree.x[rows], bound)[0].astype(np.int64)
            fits = (got >= min(least)) & (got <= high)
            names, scores = np.concatenate((names, tree.ids[rows[fits]])), np.concatenate((scores, got[fits]))
            for i, (_, top) in enumerate(windows):
                some = scores[(scores >= least[i]) & (scores <= top)]
                if len(some) >= k:
                    least[i] = int(np.partition(some, len(some) - k)[len(some) - k])
            keep = scores >= min(least)
            names, scores = names[keep], scores[keep]
        if at < len(found) and min(found[at][0], high) < min(least):
            break  # strictly beneath the k-th best of every window; so is all that follows
    out = []
    for worst, (_, top) in zip(least, windows, strict=True):
        fits = np.flatnonzero((scores >= worst) & (scores <= top))
        fits = fits[np.lexsort((names[fits], -scores[fits]))[:k]]
        out.append((names[fits], scores[fits]))
    return out


_LOW, _HIGH = -(1 << 62), 1 << 62


def _searched(scale: float, k: int, same: bool):
    """Rows arrive in order of (part, task, asks): the rows of a part make a tree, and its anchors follow in a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree = None, [], None
        for (*task, asks), part in runs(batches, 3):
            if task != key:
                key, held, tree = task, [], None
            ids, labels, x = part.column(3).to_numpy(), part.column(4).to_numpy(), whole(part.column(6), scale)
            if not asks:
                held.append((ids, labels, x))
                continue
            if tree is None:
                if not held:
                    continue
                d = max(h[2].shape[1] for h in held)
                tree = BallTree(np.concatenate([wide(h[2], d) for h in held]), *(np.concatenate([h[i] for h in held]) for i in (0, 1)))
                held = []
            if x.shape[1] > tree.x.shape[1]:
                tree.x, tree.centre = wide(tree.x, x.shape[1]), wide(tree.centre, x.shape[1])
            x = wide(x, tree.x.shape[1])
            out: list[list] = [[] for _ in range(5)]
            for own, label, mark, q, windows in zip(ids.tolist(), labels.tolist(), part.column(5).to_numpy().tolist(), x, part.column(7).to_pylist(), strict=True):
                asked = [(_LOW, _HIGH)] if same else [(w["low"], w["high"]) for w in windows]
                for i, (names, scores) in enumerate(search(tree, q, own, label, same, asked, k)):
                    for col, v in zip(out, (np.full(len(names), own), np.full(len(names), mark), np.full(len(names), 0 if same else windows[i]["at"]), names, scores), strict=True):
                        col.append(v)
            yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["anchor_id", "mark", "at", "id", "score"])

    return run


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``anchors`` is a condition on ``rows``.  Scores are inner products of
    floor(scale * x).  An anchor's positives are the first ``positives`` other
    rows of its label, by score and then the smaller id; for each, the first
    ``negatives`` rows of other labels with low * positive_score <= 100 *
    negative_score <= high * positive_score (none if that is empty).  Exact, for
    labels of any size.  Rows with a null label or id, a null vector, or one with
    null or non-finite parts (also after scaling) take no part; a shorter vector
    counts as if it ended in zeros.  A row with the anchor's id is neither
    positive nor negative; rows that repeat an id are each a candidate, equal
    anchor rows count once, and anchors that share an id but not vector or label
    each.  Products beyond 64 bits are an error.  Empty tables give an empty
    table.  Other columns are not read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "balls")
    picked = rows.select(F.col(id_col), F.col(vec_col), F.col(label_col), F.coalesce(anchors, F.lit(False)).alias("_asks"))
    data = sound(picked, id_col, vec_col, scale, F.col(label_col).cast("long").alias("label"), F.col("_asks").alias("asks")).where("label is not null")
    kind = data.schema["vec"].dataType.simpleString()
    sizes = scratch.put(data.groupBy("label").agg(F.count("*").alias("n")), "labels")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    slots = spark.sparkContext.defaultParallelism
    size = max(ROWS, math.ceil(total / PARTS))
    size = min(size, max(2048, math.ceil(total / (2 * slots))))  # small tables use all cores too
    often = sizes.where(F.col("n") * 2 >= size).collect()  # at most 2 * total / size labels
    rare = math.ceil((total - sum(r.n for r in often)) / size)  # their parts come first
    first, table = rare, []
    for r in sorted(often, key=lambda r: r.label):
        count = math.ceil(r.n / size)
        table.append((r.label, first, count))
        first += count
    own = F.broadcast(spark.createDataFrame(table, "label long, first int, count int"))
    spare = F.pmod(F.xxhash64("label"), F.lit(max(1, rare))).cast("int")
    dealt = scratch.put(
        data.join(own, "label", "left").select("id", "label", "vec", "asks", F.coalesce(F.col("first") + F.pmod(F.xxhash64("id"), "count").cast("int"), spare).alias("part")), "rows"
    )
    mark = F.xxhash64("label", "vec").alias("mark")
    asked = scratch.put(dealt.where("asks").select("id", "label", mark, "vec").dropDuplicates(["id", "mark"]), "anchors")
    if not asked.limit(1).count():
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    shape = "array<struct<at:long,low:long,high:long>>"

    def found(ask: DataFrame, same: bool, k: int, tag: str) -> DataFrame:
        """What anchors (id, label, mark, windows, vec, part) find in the part."""
        tasks = F.greatest(F.ceil(F.count("*") / ANCHORS), F.lit(1)).cast("int")
        split = scratch.put(ask.groupBy("part").agg(tasks.alias("tasks")), f"{tag}-tasks")  # a row per part
        stored = dealt.join(F.broadcast(split), "part").select(
            "part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("asks"), "id", "label", F.lit(0).cast("long").alias("mark"), "vec", F.lit(None).cast(shape).alias("windows")
        )
        asking = ask.join(F.broadcast(split), "part").select(
            "part", F.pmod(F.xxhash64("id", "mark"), "tasks").cast("int").alias("task"), F.lit(1).alias("asks"), "id", "label", "mark", "vec", "windows"
        )
        count = max(slots, split.agg(F.sum("tasks")).first()[0] or 1)
        groups = stored.union(asking).repartition(count, "part", "task").sortWithinPartitions("part", "task", "asks")
        return scratch.put(groups.mapInArrow(_searched(scale, k, same), "anchor_id long, mark long, at long, id long, score long"), tag)

    none = F.lit(None).cast(shape).alias("windows")
    mine = asked.join(own, "label", "left").withColumn("part", F.explode(F.when(F.col("count").isNotNull(), F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).otherwise(F.array(spare))))
    near = found(mine.select("id", "label", "mark", none, "vec", "part"), True, positives, "near")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "mark").orderBy(F.desc("score"), "id"))
    best = scratch.put(near.withColumn("at", rank.cast("long")).where(F.col("at") <= positives).select("anchor_id", "mark", "at", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    down = "(positive_score * {0} - pmod(positive_score * {0}, 100)) div 100"  # floor of a share in percent
    bounds = best.withColumns({"low": -F.expr(down.format(-low)), "high": F.expr(down.format(high))}).where("low <= high")
    windows = bounds.groupBy("anchor_id", "mark").agg(F.collect_list(F.struct("at", "low", "high")).alias("windows"))  # at most ``positives`` each
    ready = asked.join(windows.withColumnRenamed("anchor_id", "id"), ["id", "mark"])
    every = F.sequence(F.lit(0), F.lit(first - 1)) if first else F.array().cast("array<int>")
    others = ready.join(own, "label", "left").withColumn("part", F.explode(F.filter(every, lambda x: F.col("count").isNull() | (x < F.col("first")) | (x >= F.col("first") + F.col("count")))))
    far = found(others.select("id", "label", "mark", "windows", "vec", "part"), False, negatives, "far")
    place = F.row_number().over(Window.partitionBy("anchor_id", "mark", "at").orderBy(F.desc("score"), "id"))
    chosen = far.withColumn("rank", place).where(F.col("rank") <= negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    return chosen.join(best, ["anchor_id", "mark", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
