"""Components of random graphs against plain Python; graph files."""

import json
import random

import pytest

from skeinflow.operators.components import components, strong_components
from skeinflow.operators.dfg import missing_edges
from skeinflow.plans.graph import components as plain_components
from skeinflow.plans.graph import strong_components as plain_strong
from skeinflow.sources.ocel import graph_edges, read_graph
from skeinflow.sources.scratch import Scratch


def labels(groups):
    return {n: min(g) for g in groups for n in g}


def both(spark, edges):
    df = spark.createDataFrame(edges, "a string, b string")
    return [{r.node: r.component for r in f(df, Scratch(spark, "test")).collect()} for f in (components, strong_components)]


def test_random_graphs(spark):
    r, edges, names = random.Random(1), [], []
    for g in range(6):  # several graphs at once, apart by their names
        size = r.choice([3, 6, 12])
        own = [f"{g}-{i:02}" for i in range(size)]
        edges += [(r.choice(own), r.choice(own)) for _ in range(r.choice([size // 2, size, 2 * size]))]
    edges += [("p1", "p2"), ("p2", "p3"), ("p3", "p4"), ("q", "q"), ("r1", "r2"), ("r2", "r1"), ("r2", "s"), (None, "x")]
    known = [e for e in edges if None not in e]
    names = {n for e in known for n in e}
    weak, strong = both(spark, edges)
    assert strong == labels(plain_strong(dict.fromkeys(known, 1), names))
    linked = {n for a, b in known if a != b for n in (a, b)}
    assert weak == {n: c for n, c in labels(plain_components(dict.fromkeys(known, 1), names)).items() if n in linked}


def test_no_edges(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert strong_components(df, Scratch(spark, "test")).count() == 0 and components(df, Scratch(spark, "test")).count() == 0


def test_graph_files_with_and_without_costs(spark, tmp_path):
    """Several graph files in one table; edges without a cost weigh null."""
    for name, cost in (("one", {"cost": 4}), ("two", {})):
        edge = {"id": "a b->c", "source": "a b", "target": "c", "label": "Edge a b-c"} | cost
        (tmp_path / f"{name}.json").write_text(json.dumps({"edges": [edge], "nodes": [{"id": "a b", "label": "a b"}, {"id": "c", "label": "c"}]}, indent=2))
    rows = read_graph(spark, str(tmp_path)).collect()
    assert sorted((r.source, r.target, r.weight or 0) for r in rows) == [("a b", "c", 0), ("a b", "c", 4)]
    assert graph_edges((tmp_path / "two.json").read_text()) == {("a b", "c"): None} and graph_edges((tmp_path / "one.json").read_text()) == {("a b", "c"): 4}


def test_too_many_activities_for_all_pairs(spark):
    ring = spark.range(1001).selectExpr("cast(id as string) source", "cast((id + 1) % 1001 as string) target")
    with pytest.raises(ValueError, match="more than 1000 activities"):
        missing_edges(ring)
