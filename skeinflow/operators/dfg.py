"""Directly-follows graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.operators.order import in_order, steps_of
from skeinflow.sources.scratch import keep

#: Activities of a log; its graph has at most the square of this many rows, which are what reaches the driver.
MOST_ACTIVITIES = 1000


def successors(relations: DataFrame, once: bool = False) -> DataFrame:
    """(oid, otype, source, target) for consecutive events of an object, in order of (ts, eid); see ``in_order``."""
    return steps_of(in_order(relations, once=once))


def endpoints(relations: DataFrame, by_type: bool = False) -> DataFrame:
    """(activity, is_start, is_end), of all objects; with ``by_type`` for each otype."""
    key = F.struct("ts", "eid")
    ends = relations.groupBy("otype", "oid").agg(F.min_by("activity", key).alias("first"), F.max_by("activity", key).alias("last"))
    sides = ends.select("otype", F.explode(F.array(F.struct(F.col("first").alias("activity"), F.lit(True).alias("s")), F.struct(F.col("last").alias("activity"), F.lit(False).alias("s")))).alias("x"))
    keys = ["otype"] * by_type + ["activity"]
    return sides.select("otype", "x.activity", "x.s").groupBy(*keys).agg(F.max("s").alias("is_start"), F.max(~F.col("s")).alias("is_end"))


def dfg_by_type(relations: DataFrame) -> DataFrame:
    """(otype, source, target, cnt): raw counts of steps, an event of an object counting once."""
    return successors(relations, once=True).groupBy("otype", "source", "target").agg(F.count("*").alias("cnt"))


def dfg(relations: DataFrame, patterns: DataFrame, by_type: DataFrame | None = None) -> DataFrame:
    """(source, target, cnt, weight): steps of objects whose type is not divergent for both activities.

    ``weight`` is the share of all such steps in percent, rounded up, computed in
    double precision in a fixed order.  ``by_type`` may give the result of
    ``dfg_by_type``, which both graphs come from.
    """
    loose = patterns.where("divergent").select("activity", "otype")
    steps = dfg_by_type(relations) if by_type is None else by_type
    a = steps.join(loose.select(F.col("activity").alias("source"), "otype", F.lit(True).alias("da")), ["source", "otype"], "left")
    b = a.join(loose.select(F.col("activity").alias("target"), "otype", F.lit(True).alias("db")), ["target", "otype"], "left")
    edges = b.where("da is null or db is null").groupBy("source", "target").agg(F.sum("cnt").alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy())  # a row per edge, at most activities squared
    return edges.withColumn("weight", F.ceil(F.col("cnt").cast("double") / total.cast("double") * F.lit(100.0)))


def reduce_noise(edges: DataFrame, share: float) -> DataFrame:
    """Edges heavier than trunc(sum of weights * share); a share of zero or less keeps all."""
    if share <= 0:
        return edges
    cut = F.floor(F.sum("weight").over(Window.partitionBy()).cast("double") * F.lit(float(share)))
    return edges.withColumn("_cut", cut).where("weight > _cut").drop("_cut")


def drop_activities(edges: DataFrame, gone: list[str]) -> DataFrame:
    return edges.where(~F.col("source").isin(gone) & ~F.col("target").isin(gone)) if gone else edges


def induced(edges: DataFrame, activities: list[str]) -> DataFrame:
    return edges.where(F.col("source").isin(activities) & F.col("target").isin(activities))


def missing_edges(edges: DataFrame) -> DataFrame:
    """(source, target): ordered pairs of different activities on an edge that are no edge.

    The pairs are as many as the square of the activities, which are ``MOST_ACTIVITIES`` at most, else an error.
    """
    names = edges.select(F.explode(F.array("source", "target")).alias("x")).distinct()
    if names.limit(MOST_ACTIVITIES + 1).count() > MOST_ACTIVITIES:
        raise ValueError(f"more than {MOST_ACTIVITIES} activities")
    pairs = names.select(F.col("x").alias("source"), F.lit(1).alias("k")).join(names.select(F.col("x").alias("target"), F.lit(1).alias("k")), "k").where("source <> target").drop("k")
    return pairs.join(edges.select("source", "target"), ["source", "target"], "left_anti")


def bidirectional(edges: DataFrame) -> DataFrame:
    """(source, target) with source < target and edges both ways."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return edges.select("source", "target").join(back, ["source", "target"], "left_semi").where("source < target")


def reachability(edges: DataFrame) -> DataFrame:
    """(source, target): reflexive transitive closure over the activities on an edge.

    Every round doubles the length of paths and is written, so a plan holds one
    join however many rounds there are; it ends when a round adds nothing.
    """
    edges = keep(edges.select("source", "target"), "edges")
    names = edges.select(F.explode(F.array("source", "target")).alias("source")).distinct()
    far = keep(names.select("source", F.col("source").alias("target")).union(edges).distinct(), "reach")
    size = far.count()
    while True:
        onward = far.select(F.col("source").alias("target"), F.col("target").alias("_end"))
        far = keep(far.join(onward, "target").select("source", F.col("_end").alias("target")).distinct(), "reach")
        if (now := far.count()) == size:
            return far
        size = now
