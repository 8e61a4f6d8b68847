"""Tables of nodes against the same work on single trees."""

import random

import pytest

from skeinflow.operators import forest as N
from skeinflow.plans import tree as T
from skeinflow.plans.tree import Node

SCHEMA = "tree_id string, node_id string, parent_id string, child_pos int, label string"


def grown(rng: random.Random, depth: int) -> Node:
    if depth == 0 or rng.random() < 0.3:
        return Node(rng.choice("abcde") if rng.random() < 0.9 else "tau")
    return Node(rng.choice(("sequence", "exclusive", "parallel", "flower")), [grown(rng, depth - 1) for _ in range(rng.randrange(1, 4))])


def nodes(name: str, tree: Node) -> list[tuple]:
    return [(name, p, p.rpartition(".")[0] or None, int(p.rpartition(".")[2]), n.label) for p, n in tree.walk()]


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(7)
    return {f"t{i}": grown(rng, 5) for i in range(40)} | {"bare": Node("flower"), "leaf": Node("a")}


@pytest.fixture(scope="module")
def forest(spark, trees):
    return spark.createDataFrame([r for k, t in trees.items() for r in nodes(k, t)], SCHEMA)


def held(df) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in df.select(*N.COLUMNS).collect():
        out.setdefault(r.tree_id, []).append(tuple(r))
    return {k: sorted(v) for k, v in out.items()}


def test_open_flowers(forest, trees):
    got = {r.tree_id: (r.node_id, set(r.activities)) for r in N.open_flowers(forest).collect()}
    assert got == {k: f for k, t in trees.items() if (f := T.open_flower(t)) is not None}
    assert got["bare"] == ("0", set())


def test_descendants_and_collapse(spark, forest, trees):
    rng = random.Random(3)
    tops = {k: rng.choice([p for p, _ in t.walk()]) for k, t in trees.items()}
    asked = spark.createDataFrame([*tops.items(), *tops.items(), ("t0", "9.9"), ("none", "0")], "tree_id string, node_id string")
    got: dict[str, list] = {}
    for r in N.descendants(forest, asked).collect():
        assert r.depth == r.node_id.count(".") - r.top_id.count(".")
        got.setdefault(r.tree_id, []).append(r.node_id)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(T.descendants(t, tops[k])) for k, t in trees.items()}
    assert held(N.collapse(forest, asked)) == {k: sorted(nodes(k, T.collapse(t, tops[k])[0])) for k, t in trees.items()}


def test_tops_within_tops(spark):
    tree = Node("sequence", [Node("exclusive", [Node("a"), Node("parallel", [Node("b"), Node("c")])]), Node("d")])
    df = spark.createDataFrame(nodes("x", tree), SCHEMA)
    tops = spark.createDataFrame([("x", "0.0"), ("x", "0.0.1")], "tree_id string, node_id string")
    assert held(N.collapse(df, tops)) == {"x": sorted(nodes("x", T.collapse(tree, "0.0")[0]))}


def test_replace_flowers(spark, forest, trees):
    new = Node("sequence", [Node("x"), Node("redo", [Node("y"), Node("tau")])])
    for names in ({"a"}, {"a", "b"}, {"c", "d", "e"}):
        got = held(N.replace_flowers(forest, sorted(names), T.table(spark, new)))
        assert got == {k: sorted(nodes(k, T.replace_flowers(t, names, new))) for k, t in trees.items()}


def test_deep_lost_and_empty(spark):
    deep = [("d", "0" + ".0" * i, "0" + ".0" * (i - 1) if i else None, 0, "sequence" if i < 150 else "a") for i in range(151)]
    lost = [("l", "1", "2", 0, "sequence"), ("l", "2", "1", 0, "sequence"), ("l", "3", "gone", 0, "flower")]
    df = spark.createDataFrame(deep + lost, SCHEMA)
    limit = spark.conf.get("spark.sql.cteRecursionLevelLimit")
    assert N.placed(df).count() == 151
    assert spark.conf.get("spark.sql.cteRecursionLevelLimit") == limit
    assert N.open_flowers(df).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert N.collapse(empty, empty).count() == N.descendants(empty, empty).count() == N.open_flowers(empty).count() == 0
