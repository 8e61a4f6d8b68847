"""Event-to-object relations from the star-schema tables.

A relation has the columns eid, activity, ts, oid, otype.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as activities of their user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").cast("string").alias("eid"), F.col("event_type").alias("activity"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("u"), "user_id").alias("oid"), F.lit("user").alias("otype"),
    )


def clicks_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clicks``, and each event's key as a second object."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    objects = F.explode(F.array(
        F.struct(F.concat(F.lit("u"), "user_id").alias("oid"), F.lit("user").alias("otype")),
        F.struct(F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("oid"), F.lit("key").alias("otype")),
    ))
    return e.select(F.col("event_id").cast("string").alias("eid"), F.col("event_type").alias("activity"), "ts", objects.alias("o")).select("eid", "activity", "ts", "o.oid", "o.otype").where("oid is not null")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dealt by order: what follows of an order's lines needs no other shuffle of them."""
    values = ("l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", *values).repartition("l_orderkey")
    return lines.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in values])


def _line_activity() -> Column:
    return F.when(F.col("l_returnflag") == "R", "return item").when(F.col("l_linestatus") == "F", "close item").otherwise("ship item")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are placed for a customer; their lines are returned, closed or shipped with an item and a supplier.

    Lines shipped before their order was placed are left out: such an event would stand before its object's first.
    """
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    line = _lines(spark, sf_dir)

    def thing(prefix, column, otype):
        return F.struct(F.concat(F.lit(prefix), column).alias("oid"), F.lit(otype).alias("otype"))

    placed = o.select(
        F.concat(F.lit("o"), "o_orderkey").alias("eid"), F.lit("place order").alias("activity"), F.col("o_orderdate").alias("ts"),
        F.explode(F.array(thing("o", "o_orderkey", "order"), thing("c", "o_custkey", "customer"))).alias("o"),
    )
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    moved = line.join(o, line.l_orderkey == o.o_orderkey).where("l_shipdate >= o_orderdate").select(
        F.concat(F.lit("l"), key).alias("eid"), _line_activity().alias("activity"), F.col("l_shipdate").alias("ts"),
        F.explode(F.array(thing("o", "l_orderkey", "order"), thing("i", key, "item"), thing("s", "l_suppkey", "supplier"))).alias("o"),
    )
    return placed.union(moved).select("eid", "activity", "ts", "o.oid", "o.otype")


def order_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for each order, as nodes: it is placed, then its suppliers' lines go their ways side by side.

    A supplier whose lines of the order all meet the same activity is a leaf,
    another one a flower.  Children are placed by their smallest line number.
    """
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("o"), "o_orderkey").alias("tree_id")).distinct()
    lines = _lines(spark, sf_dir).groupBy("l_orderkey", "l_suppkey").agg(
        F.min("l_linenumber").cast("int").alias("pos"), F.array_sort(F.collect_set(_line_activity())).alias("names")
    ).select(F.concat(F.lit("o"), "l_orderkey").alias("tree_id"), "pos", "names", F.concat(F.lit("0.1."), "pos").alias("id"))

    def nodes(df: DataFrame, node, parent, pos, label) -> DataFrame:
        return df.select("tree_id", *[c.alias(n) for c, n in zip((node, parent, pos, label), ("node_id", "parent_id", "child_pos", "label"))])

    def fixed(df: DataFrame, node: str, parent: str | None, pos: int, label: str) -> DataFrame:
        return nodes(df, F.lit(node), F.lit(parent).cast("string"), F.lit(pos), F.lit(label))

    top = fixed(o, "0", None, 0, "sequence").union(fixed(o, "0.0", "0", 0, "place order")).union(fixed(lines.select("tree_id").distinct(), "0.1", "0", 1, "parallel"))
    suppliers = nodes(lines, F.col("id"), F.lit("0.1"), F.col("pos"), F.when(F.size("names") > 1, "flower").otherwise(F.col("names")[0]))
    inner = lines.where(F.size("names") > 1).select("tree_id", "id", F.posexplode("names").alias("i", "name"))
    return top.union(suppliers).union(nodes(inner, F.concat_ws(".", "id", "i"), F.col("id"), F.col("i"), F.col("name")))
