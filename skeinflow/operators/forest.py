"""Many process trees as one table of nodes.

A node has the columns tree_id, node_id, parent_id (null for a root), child_pos
and label; an id comes once in a tree.  Nodes that no root leads to, on a cycle
or below a missing parent, belong to no tree and are left out of every result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.plans.tree import OPERATORS, TAU
from skeinflow.sources.scratch import Scratch, keep

COLUMNS = ["tree_id", "node_id", "parent_id", "child_pos", "label"]
_DOWN = """
    WITH RECURSIVE down AS (
        SELECT tree_id, node_id, parent_id, child_pos, label, array(node_id) AS above, array(child_pos) AS place FROM {nodes} WHERE parent_id IS NULL
        UNION ALL
        SELECT n.tree_id, n.node_id, n.parent_id, n.child_pos, n.label, concat(d.above, array(n.node_id)), concat(d.place, array(n.child_pos))
        FROM down d JOIN {nodes} n ON n.tree_id = d.tree_id AND n.parent_id = d.node_id)
    SELECT * FROM down"""


def placed(nodes: DataFrame) -> DataFrame:
    """The nodes with ``above``, the ids from the root down to the node itself, and ``place``, whose order is pre-order.

    The recursion takes a join for each level of the deepest tree.  Spark stops
    recursion after a number of rows and levels; both bounds are lifted while the
    result is written, and set again.
    """
    spark, limits = nodes.sparkSession, ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit")
    nodes = keep(nodes.select(*COLUMNS), "nodes")
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k in limits:
            spark.conf.set(k, "-1")
        return keep(spark.sql(_DOWN, nodes=nodes), "placed")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def descendants(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """(tree_id, top_id, node_id, depth): every node under a top, itself included, with its levels below it.

    ``tops`` has tree_id and node_id; repeated ones count once, unknown ones give nothing.
    """
    chains = placed(nodes).select("tree_id", "node_id", F.size("above").alias("_n"), F.posexplode("above").alias("_i", "top_id"))
    tops = tops.select("tree_id", F.col("node_id").alias("top_id")).distinct()
    return chains.join(tops, ["tree_id", "top_id"]).select("tree_id", "top_id", "node_id", (F.col("_n") - 1 - F.col("_i")).alias("depth"))


def open_flowers(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, activities): the first flower of each tree in pre-order and the labels of its children, sorted.

    Trees without a flower have no row; a flower without children has no activities.
    """
    found = placed(nodes)
    first = found.where("label = 'flower'").groupBy("tree_id").agg(F.min_by("node_id", "place").alias("node_id"))
    held = found.select("tree_id", F.col("parent_id").alias("node_id"), "label").join(first, ["tree_id", "node_id"], "left_semi")
    names = held.groupBy("tree_id", "node_id").agg(F.array_sort(F.collect_set("label")).alias("activities"))
    return first.join(names, ["tree_id", "node_id"], "left").select("tree_id", "node_id", F.coalesce("activities", F.array().cast("array<string>")).alias("activities"))


def _outermost(nodes: DataFrame, tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes under no top, and (tree_id, top_id, node_id, parent_id, child_pos, label) of those under one; of tops within tops the highest counts.

    A node takes the top of its parent, level by level; each level is written, so
    what a round shuffles is gone before the next.
    """
    scratch = Scratch(nodes.sparkSession, "forest")
    tops = tops.select("tree_id", "node_id", F.lit(True).alias("_top")).distinct()
    own = F.when(F.col("_top"), F.col("node_id"))
    marked = scratch.put(nodes.select(*COLUMNS).join(tops, ["tree_id", "node_id"], "left"), "nodes")
    below = marked.where("parent_id is not null")
    levels = [scratch.put(marked.where("parent_id is null").select(*COLUMNS, own.alias("top_id")), "level")]
    while not levels[-1].isEmpty():
        up = levels[-1].select("tree_id", F.col("node_id").alias("parent_id"), F.col("top_id").alias("_above"))
        levels.append(scratch.put(below.join(up, ["tree_id", "parent_id"]).select(*COLUMNS, F.coalesce("_above", own).alias("top_id")), "level"))
    scratch.drop(marked)
    found = scratch.read(levels)
    return found.where("top_id is null").select(*COLUMNS), found.where("top_id is not null")


def collapse(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """The trees with each subtree at ``tops`` turned into a flower of its activities, sorted.

    The flower keeps the id of the top, its children are named ``id.0``, ``id.1``
    and so on.  Of tops within tops only the highest counts.
    """
    outside, under = _outermost(nodes, tops)
    heads = under.where("node_id = top_id").select("tree_id", "node_id", "parent_id", "child_pos", F.lit("flower").alias("label"))
    inner = under.select(F.col("tree_id"), F.col("parent_id").alias("node_id"))
    leaves = under.join(inner, ["tree_id", "node_id"], "left_anti").where(~F.col("label").isin(*OPERATORS) & (F.lower("label") != TAU))
    names = leaves.groupBy("tree_id", "top_id").agg(F.array_sort(F.collect_set("label")).alias("names"))
    below = names.select("tree_id", F.col("top_id").alias("parent_id"), F.posexplode("names").alias("child_pos", "label"))
    below = below.select("tree_id", F.concat_ws(".", "parent_id", "child_pos").alias("node_id"), "parent_id", "child_pos", "label")
    return outside.union(heads).union(below)


def replace_flowers(nodes: DataFrame, names: list[str], new: DataFrame) -> DataFrame:
    """The trees with every flower over exactly ``names``, or over none, turned into the tree ``new``.

    ``new`` holds one tree with node ids that start with its root's ``0``; its
    root takes the flower's id and place, a node ``0.x`` the id ``flower.x``.
    It is one tree made by hand or by a repair: at most 10,000 nodes, else an error.
    """
    whole = new.select("node_id", "parent_id", "child_pos", "label").limit(10_001).collect()
    if len(whole) > 10_000:
        raise ValueError("more than 10,000 nodes in the new tree")
    found = keep(nodes.select(*COLUMNS), "nodes")
    flowers = found.where("label = 'flower'").select("tree_id", "node_id")
    held = found.select("tree_id", F.col("parent_id").alias("node_id"), F.col("label").alias("name")).join(flowers, ["tree_id", "node_id"], "left_semi")
    held = held.groupBy("tree_id", "node_id").agg(F.array_sort(F.collect_set("name")).alias("held"))
    wanted = F.array(*[F.lit(x) for x in sorted(set(names))]).cast("array<string>")
    hit = flowers.join(held, ["tree_id", "node_id"], "left").where(F.col("held").isNull() | (F.col("held") == wanted))
    outside, under = _outermost(found, hit)
    heads = under.where("node_id = top_id").select("tree_id", "node_id", "parent_id", "child_pos")
    grown = heads.withColumn("x", F.explode(F.array(*[
        F.struct(F.lit(r.node_id).alias("id"), F.lit(r.parent_id).cast("string").alias("up"), F.lit(r.child_pos).cast("int").alias("pos"), F.lit(r.label).alias("label")) for r in whole
    ])))

    def moved(c: str):
        return F.concat("node_id", F.expr(f"substring({c}, 2)"))

    root = F.col("x.up").isNull()
    return outside.union(grown.select(
        "tree_id", moved("x.id").alias("node_id"), F.when(root, F.col("parent_id")).otherwise(moved("x.up")).alias("parent_id"),
        F.when(root, F.col("child_pos")).otherwise(F.col("x.pos")).alias("child_pos"), F.col("x.label").alias("label"),
    ))
