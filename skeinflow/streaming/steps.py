"""Steps between events of an object, counted as they arrive.

A table beside the counts holds each object's events of the last ``delay``
seconds before its newest one and the event before those.  A micro-batch is laid
over it and counted as a batch run counts, so after every micro-batch the
increments so far sum to the counts of a batch run over what has arrived; an
event that comes out of order within that span takes back the step it splits.
An event that belongs before the span as the last micro-batch left it cannot be
placed any more: it comes out as a row that says so and is in no count.  Within
a micro-batch events may come in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skeinflow.operators.order import in_order, steps_of
from skeinflow.sources.scratch import Scratch

_ROW = "oid string, otype string, eid string, ts timestamp_ntz, activity string"
#: The first event held of an object that has let earlier ones go.
_EDGE = "oid string, edge struct<ts: timestamp_ntz, eid: string, activity: string>"


def _arrived(relations: DataFrame) -> DataFrame:
    return relations.where("oid is not null").select("oid", "otype", F.coalesce("eid", F.lit("")).alias("eid"), F.col("ts").cast("timestamp_ntz").alias("ts"), "activity")


def _counted(ordered: DataFrame) -> DataFrame:
    return steps_of(ordered).groupBy("otype", "source", "target").agg(F.count("*").alias("cnt"))


def write_counts(relations: DataFrame, path: str, delay: int, **trigger) -> StreamingQuery:
    """Start a query that adds the increments of each micro-batch of relations to the table at ``path``.

    ``delay`` is in seconds.  Within it events may come in any order, and several
    rows of an object and an event count once, by the smallest (ts, activity).  A
    null ts comes before all others; rows with a null oid are left out, a null
    eid is taken as an empty one.  A micro-batch that runs again after a failure
    starts from what the one before left and writes over what it wrote; the
    stream's own checkpoint lies beside the table.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark, scratch = batch.sparkSession, Scratch(batch.sparkSession, "stream")

        def left(kind: str, schema: str) -> DataFrame:
            return spark.read.schema(schema).parquet(f"{path}/{kind}/batch={number - 1}") if number else spark.createDataFrame([], schema)

        held, edges = left("held", _ROW), left("edges", _EDGE)
        rows = scratch.put(_arrived(batch).join(edges, "oid", "left").withColumn("late", F.coalesce(F.struct("ts", "eid", "activity") < F.col("edge"), F.lit(False))), "arrived")
        fresh, late = rows.where("not late").drop("edge", "late"), rows.where("late")
        before = in_order(held, scratch=scratch)
        ordered = scratch.put(in_order(held.unionByName(fresh), once=True, scratch=scratch), "ordered")
        summed = _counted(ordered).union(_counted(before).withColumn("cnt", -F.col("cnt"))).groupBy("otype", "source", "target").agg(F.sum("cnt").alias("cnt"))
        missed = late.groupBy("otype", F.lit(None).cast("string").alias("source"), F.col("activity").alias("target")).agg(F.count("*").alias("cnt"))
        made = summed.withColumn("late", F.lit(False)).union(missed.withColumn("late", F.lit(True))).where("cnt <> 0")

        newest = ordered.groupBy("oid").agg(F.max("ts").alias("newest"))
        old = F.col("newest").isNotNull() & F.coalesce(F.col("ts") < F.col("newest") - F.make_dt_interval(secs=F.lit(delay)), F.lit(True))
        gone = ordered.join(newest, "oid").where(old).groupBy("oid").agg(F.max("pos").alias("gone")).where("gone > 1")  # the last of those before the span stays
        gone = scratch.put(gone, "gone")
        stay = ordered.join(gone, "oid", "left").where("pos >= coalesce(gone, 1)")
        cut = stay.where("pos = gone").select("oid", F.struct("ts", "eid", "activity").alias("edge"))
        stay.select("oid", "otype", "eid", "ts", "activity").write.mode("overwrite").parquet(f"{path}/held/batch={number}")
        edges.join(gone, "oid", "left_anti").union(cut).write.mode("overwrite").parquet(f"{path}/edges/batch={number}")
        made.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        scratch.clear()
        for kind in ("held", "edges"):  # what the micro-batch before last left is not asked for again
            scratch.remove(f"{path}/{kind}/batch={number - 2}")

    stream = relations.writeStream.foreachBatch(add)
    return stream.option("checkpointLocation", f"{path}/checkpoint").trigger(**trigger or {"availableNow": True}).start()


def _counts(spark, path: str) -> DataFrame:
    schema = "otype string, source string, target string, late boolean, cnt long, batch long"
    return spark.read.schema(schema).parquet(f"{path}/counts")


def read_counts(spark, path: str) -> DataFrame:
    """(otype, source, target, cnt) over all micro-batches so far: what ``dfg_by_type`` counts, for ``dfg`` to take."""
    found = _counts(spark, path).where("not late").groupBy("otype", "source", "target").agg(F.sum("cnt").alias("cnt"))
    return found.where("cnt <> 0")


def read_late(spark, path: str) -> DataFrame:
    """(otype, activity, cnt): events that came too late to be placed."""
    return _counts(spark, path).where("late").groupBy("otype", F.col("target").alias("activity")).agg(F.sum("cnt").alias("cnt"))
