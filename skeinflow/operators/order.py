"""Order along a key that may hold a large share of all rows.

A plain window puts all rows of a key into one task.  Here rows are dealt into
ranges of (key, order), so a frequent key is spread over many tasks; every range
is worked on alone, and a table with one row for each key of each range carries
what has to cross the bounds: counts, sums, first and last items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.sources.scratch import Scratch, keep, lean

#: Events of an object from which it is dealt into ranges.
HOT = 200_000


def ranged(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``_range``: a contiguous range of ``by``; larger numbers hold later rows.

    Ranges come from a sample, and another run may cut elsewhere: write the
    result before it is used twice.
    """
    return rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id())


def running_sums(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sums of all rows of the same ``keys`` up to each one in ``order``, in two passes over ranges.

    Keys are not null.  Rows that tie in ``order`` are taken in any order.
    """
    dealt = keep(ranged(rows.withColumns({f"_{k}": v for k, v in sums.items()}), [*keys, *order]), "ranges")
    totals = dealt.groupBy(*keys, "_range").agg(*[F.sum(f"_{k}").alias(f"_all_{k}") for k in sums])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    offsets = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_upto_{k}") for k in sums])
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({k: F.sum(f"_{k}").over(inside) for k in sums})
    joined = local.join(offsets, [*keys, "_range"])
    return joined.select(*[c for c in rows.columns if c not in sums], *[(F.col(k) + F.col(f"_upto_{k}")).alias(k) for k in sums])


def changed(was: Column, now: Column) -> Column:
    return ~was["activity"].eqNullSafe(now["activity"])


def in_order(relations: DataFrame, keys: tuple[str, ...] = ("oid",), new: Callable[[Column, Column], Column] = changed, once: bool = False, hot: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """keys, otype, eid, ts, activity, before, pos and run of each event of each object, in order of (ts, eid).

    ``before`` is the (activity, ts) of the event before, null for the first;
    ``pos`` counts events from 1; ``run`` counts those that are ``new`` against the
    one before, the first included.  With ``once``, of several rows of an object
    and an event the one with the smallest (ts, activity) counts.  Objects with
    more than ``hot`` events are dealt into ranges, which are then stitched;
    ``scratch`` says where those are written.
    """
    hot = HOT if hot is None else hot
    put = scratch.put if scratch is not None else keep
    keys = list(keys)
    rows = relations.select("oid", "otype", "eid", "ts", "activity")
    many = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(*keys)
    with lean(rows.sparkSession):
        spread = many.limit(1).count() > 0
    many = put(many, "hot") if spread else many  # at most one for each ``hot`` events
    few = rows.join(F.broadcast(many), keys, "left_anti") if spread else rows

    def single(x: DataFrame) -> DataFrame:
        if not once:
            return x
        first = x.groupBy(*keys, "eid").agg(F.min(F.struct("ts", "activity", "otype")).alias("r"))
        return first.select(*keys, "eid", "r.ts", "r.activity", *[f"r.{c}" for c in ("otype",) if c not in keys])

    def numbered(x: DataFrame, group: list[str]) -> DataFrame:
        way = Window.partitionBy(*group).orderBy("ts", "eid")
        x = x.withColumns({"before": F.lag(F.struct("activity", "ts")).over(way), "pos": F.row_number().over(way).cast("long")})
        fresh = (F.col("pos") == 1) | new(F.col("before"), F.struct("activity", "ts"))
        return x.withColumn("run", F.sum(F.when(fresh, 1).otherwise(0)).over(way.rowsBetween(Window.unboundedPreceding, 0)))

    names = ["oid", "otype", "eid", "ts", "activity", "before", "pos", "run"]
    plain = numbered(single(few.repartition(*keys)), keys).select(*names)
    if not spread:
        return plain
    part = put(numbered(ranged(single(rows.join(F.broadcast(many), keys, "left_semi")), [*keys, "ts", "eid"]), [*keys, "_range"]), "ranges")
    item = F.struct("activity", "ts")
    facts = part.groupBy(*keys, "_range").agg(
        F.count("*").alias("n"), F.max("run").alias("runs"), F.min_by(item, "pos").alias("first"), F.max_by(item, "pos").alias("last")
    )
    way = Window.partitionBy(*keys).orderBy("_range")  # a row for each range of an object
    upto = way.rowsBetween(Window.unboundedPreceding, -1)
    facts = facts.withColumn("was", F.lag("last").over(way)).withColumn("glued", F.when(F.col("was").isNotNull() & ~new(F.col("was"), F.col("first")), 1).otherwise(0))
    facts = facts.select(
        *keys, "_range", "was", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_pos"), (F.coalesce(F.sum(F.col("runs") - F.col("glued")).over(upto), F.lit(0)) - F.col("glued")).alias("_run")
    )
    stitched = part.join(facts, [*keys, "_range"]).select(
        "oid", "otype", "eid", "ts", "activity", F.when(F.col("pos") == 1, F.col("was")).otherwise(F.col("before")).alias("before"),
        (F.col("pos") + F.col("_pos")).alias("pos"), (F.col("run") + F.col("_run")).alias("run"),
    )
    return plain.union(stitched)


def steps_of(ordered: DataFrame) -> DataFrame:
    """(oid, otype, source, target) for the consecutive events of ``in_order``."""
    steps = ordered.where("pos > 1 and activity is not null")
    return steps.select("oid", "otype", F.col("before.activity").alias("source"), F.col("activity").alias("target"))
