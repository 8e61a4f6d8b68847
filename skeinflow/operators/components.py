"""Components of large graphs: rounds of joins, each linear in the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.sources.scratch import Scratch, light


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable, in either direction.

    Every round takes the least label among neighbours and then follows labels
    twice, so paths shorten by halves; each round's table is written to the
    shared folder.  A hub with very many links is only ever the key of a join
    that adaptive execution can split, or of an aggregate with partial sums.
    Nulls and self-links add nothing; no links give an empty table.
    """
    both = links.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = scratch.put(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = scratch.put(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        few = light(label)
        near = edges.join(few, edges.b == few.node).groupBy("a").agg(F.min("component").alias("near"))  # every node is the start of an edge
        hooked = scratch.put(
            near.join(few, near.a == few.node).select(
                "node", F.least("component", "near").alias("component"), F.col("component").alias("before")
            ),
            "hooked",
        )
        up = light(hooked.select(F.col("node").alias("component"), F.col("component").alias("up")))
        jumped = scratch.put(
            hooked.join(up, "component", "left").select(
                "node", F.coalesce("up", "component").alias("component"), "before"
            ),
            "labels",
        )
        changed = jumped.where("component <> before").limit(1).count()
        scratch.drop(label, hooked)
        label = jumped
        if not changed:
            scratch.drop(edges)
            return label.select("node", "component")


def merged(label: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``label`` (node, component), which is written, after more links (a, b).

    Only components that a link joins to another are nodes of the rounds.
    """
    ends = links.select("a", "b")
    for c in "ab":
        ends = ends.join(light(label.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))), c, "left").withColumn(c, F.coalesce(f"c{c}", c)).drop(f"c{c}")
    joined = components(ends, scratch)
    moved = label.join(light(joined.select(F.col("node").alias("component"), F.col("component").alias("to"))), "component", "left")
    new = joined.join(label.select("node"), "node", "left_anti").select("node", "component")
    return scratch.put(moved.select("node", F.coalesce("to", "component").alias("component")).union(new), "labels").select("node", "component")


def _spread(edges: DataFrame, label: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) with the least label of all nodes that lead to a node along ``edges`` (a, b), its own included."""
    while True:
        near = edges.join(label, edges.a == label.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        spread = scratch.put(label.join(near, "node", "left").select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("new")), "spread")
        changed = spread.where("new").limit(1).count()
        scratch.drop(label)
        label = spread.select("node", "label")
        label._scratch_path = spread._scratch_path
        if not changed:
            return label


def strong_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node of its strong component.

    Nodes without a way in or out are components of their own and are trimmed as
    long as there are any.  Then every node takes the smallest node that leads to
    it as its colour; those of a colour that lead back to the node it is named
    after are a component and leave the graph; edges between colours go, for no
    component has two.  Self-links and nulls add no edge; no links give an empty
    table.
    """
    known = links.where("a is not null and b is not null").select("a", "b")
    nodes = scratch.put(known.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    edges = scratch.put(known.where("a <> b").distinct(), "edges")
    found: list[DataFrame] = []
    while True:
        while True:  # an edge stays if its start has a way in and its end a way out
            inner = scratch.put(
                edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "trimmed"
            )
            same = inner.count() == edges.count()
            scratch.drop(edges)
            edges = inner
            if same:
                break
        if not edges.limit(1).count():
            break
        own = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        colour = _spread(edges, scratch.put(own.select("node", F.col("node").alias("label")), "colours"), scratch)
        ends = [colour.select(F.col("node").alias(x), F.col("label").alias(f"c{x}")) for x in "ab"]
        inside = scratch.put(edges.join(ends[0], "a").join(ends[1], "b").where("ca = cb").select("a", "b", F.col("ca").alias("colour")), "inside")
        # from each root backwards: 0 stands for what leads to it
        flags = scratch.put(colour.select("node", F.when(F.col("node") == F.col("label"), 0).otherwise(1).alias("label")), "flags")
        back = _spread(inside.select(F.col("b").alias("a"), F.col("a").alias("b")), flags, scratch)
        made = scratch.put(colour.withColumnRenamed("label", "component").join(back.where("label = 0").select("node"), "node"), "found")
        found.append(made)
        gone = made.select("node")
        edges = scratch.put(inside.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"), "edges")
    every = found[0] if found else nodes.select("node", F.col("node").alias("component")).limit(0)
    for f in found[1:]:
        every = every.union(f)
    return nodes.join(every, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
