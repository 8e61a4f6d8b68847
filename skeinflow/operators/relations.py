"""Relations: events with the objects they refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.sources.scratch import keep, lean


def relations_from(events: DataFrame, objects: DataFrame, e2o: DataFrame) -> DataFrame:
    """(eid, activity, ts, oid, otype) for each link of a known event to a known object.

    Qualifiers are dropped: two links of one event to one object give two rows.
    An object id that is declared twice has its largest type.
    """
    known = objects.groupBy(F.col("id").alias("oid")).agg(F.max("type").alias("otype"))
    named = events.select(F.col("id").alias("eid"), F.col("type").alias("activity"), F.col("time").alias("ts"))
    links = e2o.select(F.col("event_id").alias("eid"), F.col("object_id").alias("oid"))
    return links.join(named, "eid").join(known, "oid").select("eid", "activity", "ts", "oid", "otype")


#: Rows of an event from which its objects are dealt to many tasks.
HOT = 200_000


def _typed(rows: DataFrame) -> DataFrame:
    """A row for each event and type of its objects: their number and fingerprints, and those of all its objects."""
    parts = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("oid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "oid")).alias("y")]
    typed = rows.distinct().groupBy("eid", "activity", "otype").agg(*parts)
    event = Window.partitionBy("eid").orderBy("activity")  # a row for each type of an event's objects
    all_of = event.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = {"wn": F.sum("n").over(all_of), "wx": F.bit_xor("x").over(all_of), "wy": F.bit_xor("y").over(all_of), "before": F.lag("activity").over(event)}
    return typed.withColumns(whole)


def patterns(relations: DataFrame, hot: int | None = None) -> DataFrame:
    """(activity, otype, related, divergent, convergent, deficient), one row per pair that occurs.

    Sets of objects are compared by size and a 128-bit fingerprint that does not
    depend on order, so no set is ever gathered in one place.  Rows are dealt by
    event, once; only those of events with more than ``hot`` rows are dealt by
    object before their fingerprints are.
    """
    rows = relations.select("eid", "activity", "oid", "otype")
    many = rows.groupBy("eid").agg(F.count("*").alias("_n")).where(F.col("_n") > (HOT if hot is None else hot)).select("eid")
    with lean(rows.sparkSession):
        spread = many.limit(1).count() > 0
    if spread:
        many = keep(many, "hot")  # at most one for each ``hot`` rows
        few, many = rows.join(F.broadcast(many), "eid", "left_anti"), rows.join(F.broadcast(many), "eid", "left_semi")
        typed = _typed(few.repartition("eid")).union(_typed(many))
    else:
        typed = _typed(rows.repartition("eid"))
    # numbers only, so that sums are kept in hash tables
    seen = typed.groupBy("activity", "otype", "n", "x", "y").agg(
        F.count("*").alias("events"), F.count_if(~F.col("before").eqNullSafe(F.col("activity"))).alias("firsts"),
        *[f(w).alias(f"{k}_{w}") for w in ("wn", "wx", "wy") for f, k in ((F.min, "low"), (F.max, "high"))],
    )
    differs = (F.col("low_wn") != F.col("high_wn")) | (F.col("low_wx") != F.col("high_wx")) | (F.col("low_wy") != F.col("high_wy"))
    pairs = seen.groupBy("activity", "otype").agg(
        F.sum("events").alias("events"), F.sum("firsts").alias("firsts"), F.max(F.col("n") > 1).alias("convergent"), F.max(differs).alias("divergent")
    )
    total = F.sum("firsts").over(Window.partitionBy("activity"))  # a row for each type
    return pairs.select("activity", "otype", F.lit(True).alias("related"), "divergent", "convergent", (F.col("events") != total).alias("deficient"))


def pattern_maps(table: DataFrame) -> dict[str, dict[str, list[str]]]:
    """{kind: {activity: sorted object types}}; at most activities times types reach the driver."""
    rows = table.collect()
    kinds = {"divergent": "divergent", "convergent": "convergent", "relational": "related", "deficient": "deficient"}
    return {k: {a: sorted(r.otype for r in rows if r.activity == a and r[c]) for a in sorted({r.activity for r in rows})} for k, c in kinds.items()}


def event_object_sets(relations: DataFrame) -> DataFrame:
    """(eid, activity, objects): the sorted distinct objects of each event."""
    return relations.groupBy("eid").agg(F.max("activity").alias("activity"), F.array_sort(F.collect_set("oid")).alias("objects"))
