"""Graphs, cuts, repairs and trees, against exhaustive search on small graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from skeinflow.plans import repair as R
from skeinflow.plans.cuts import discover, exclusive_ok, find_cut, parallel_ok, redo_ok, sequence_ok
from skeinflow.plans.graph import bipartitions, components, min_cut, strong_components
from skeinflow.plans.session import Session, greedy_table, metrics, metrics_text
from skeinflow.plans.tree import Node, collapse, forest_json, language, open_flower, read_forest, relations_of, replace_flowers, replay_greedily, rules
from skeinflow.sources.ocel import cost_json, graph_edges, graph_json, log_name, read_costs


def graphs(n):
    rng = random.Random(n)
    for _ in range(n):
        names = "abcdef"[: rng.randrange(2, 7)]
        edges = {e: rng.randrange(1, 9) for e in itertools.product(names, repeat=2) if rng.random() < rng.choice([0.2, 0.4, 0.7])}
        yield set(names), edges, set(rng.sample(names, rng.randrange(1, len(names)))), set(rng.sample(names, rng.randrange(1, len(names))))


def test_worked_example():
    assert str(discover({("A", "D"): 1, ("C", "B"): 1, ("C", "D"): 1}, "ABCD", {"A", "C"}, {"B", "D"})) == "flower(A, B, C, D)"
    assert str(discover({("a", "b"): 1, ("b", "c"): 1}, "abc", "a", "c")) == "sequence(a, sequence(b, c))"
    assert str(discover({}, "a", "a", "a")) == "a" and discover({}, "", "", "") is None


def test_found_cuts_hold():
    for names, edges, starts, ends in graphs(300):
        cut = find_cut(edges, names, starts, ends)
        if cut:
            kind, one, two = cut
            assert one and two and not one & two and one | two == names
            assert {"exclusive": exclusive_ok(edges, one, two), "sequence": sequence_ok(edges, one, two), "parallel": parallel_ok(edges, one, two, starts, ends), "redo": redo_ok(edges, one, two, starts, ends)}[kind]
        tree = discover(edges, names, starts, ends)
        assert tree.activities() == names and read_forest(forest_json([tree])) == [tree]


def test_strong_components_and_components():
    for names, edges, *_ in graphs(100):
        groups = strong_components(edges, names)
        where = {n: i for i, g in enumerate(groups) for n in g}
        assert set().union(*groups) == names and all(where[a] <= where[b] for a, b in edges)
        assert set().union(*components(edges, names)) == names


def test_minimum_cut_and_best_exclusive_equal_exhaustive():
    for names, edges, *_ in graphs(150):
        a, *_, b = sorted(names)
        value, side = min_cut(edges, [a], [b])
        best = min(sum(w for (x, y), w in edges.items() if x in p and y not in p) for p, q in bipartitions(names) if a in p and b in q)
        assert value == best == sum(w for (x, y), w in edges.items() if x in side and y not in side)
        cheapest = min(sum(w for (x, y), w in edges.items() if (x in p) != (y in p)) for p, _ in bipartitions(names))
        assert R.best_exclusive(edges, names).total_cost == cheapest


def test_best_parallel_equals_exhaustive():
    for names, edges, *_ in graphs(80):
        got = R.best_parallel(edges, names, set(), set(), {}, force_endpoints=False, unit_cost=True)
        best = min(sum(e not in edges for a in p for b in q for e in ((a, b), (b, a))) for p, q in bipartitions(names))
        assert got.total_cost == best


def test_suggestions_hold_after_repair():
    for names, edges, starts, ends in graphs(120):
        for s in R.suggest(edges, names, starts, ends, dict.fromkeys(itertools.permutations(names, 2), 5.0)):
            assert set(s.set1) | set(s.set2) == names and not set(s.set1) & set(s.set2)
            assert all(e[:2] in edges for e in s.removed) and not any(e[:2] in edges for e in s.added)


def test_trees():
    t = Node("sequence", [Node("a"), Node("flower", [Node("b"), Node("c")])])
    assert open_flower(t) == ("0.1", {"b", "c"})
    done = replace_flowers(t, {"b", "c"}, Node("parallel", [Node("b"), Node("c")]))
    assert language(done) == {("a", "b", "c"), ("a", "c", "b")}
    assert relations_of(done)[:3] == ({"a"}, {"b", "c"}, {("a", "b"), ("a", "c"), ("b", "c"), ("c", "b")})
    assert str(collapse(done, "0.1")[0]) == str(t)
    assert language(Node("redo", [Node("a"), Node("tau")])) == {("a",), ("a", "a"), ("a", "a", "a")}
    with pytest.raises(ValueError, match="more than"):
        language(Node("parallel", [Node("sequence", [Node(x), Node(x)]) for x in "ab"]), most=2)


def test_interchange():
    edges = {("a", "b"): 3, ("b", "b"): 1}
    assert graph_edges(graph_json(edges)) == edges and read_costs(cost_json({("a", "b"): 1.5})) == {("a", "b"): 1.5}
    assert log_name("x.json") == "x.json"
    for bad in ("../x.json", "a/b.json", "x.txt"):
        with pytest.raises(ValueError, match="log name"):
            log_name(bad)


def test_rules_and_greedy_replay(spark):
    a, b, c = map(Node, "abc")
    assert rules(Node("sequence", [a, Node("exclusive", [b, c])])) == [("sequence", {"a"}, {"b", "c"}), ("exclusive", {"b"}, {"c"})]
    assert rules(Node("parallel", [Node("sequence", [a, b]), c])) == []
    line, either, both, loop = Node("sequence", [a, b]), Node("exclusive", [a, b]), Node("parallel", [a, b]), Node("loop", [Node("exclusive", [a, b])])
    cases = [
        (line, "ab", (True, 2, 0)), (line, "ba", (False, 0, 1)), (line, "a", (True, 1, 0)), (line, "abc", (True, 2, 0)), (line, "ac", (False, 1, 1)), (either, "b", (True, 1, 0)),
        (either, "c", (False, 0, 1)), (both, "ba", (True, 1, 1)), (both, "ab", (True, 2, 0)), (loop, "abba", (True, 4, 0)), (loop, "abc", (True, 2, 1)), (Node("redo", [a]), "a", (False, 0, 1)), (line, "", (True, 0, 0)),
        (Node("loop"), "a", (True, 0, 0)),
    ]
    for tree, trace, want in cases:
        assert replay_greedily(tree, list(trace)) == want, (str(tree), trace)
    runs = spark.createDataFrame([(list(t),) for t in ("ab", "ab", "abc", "ac", "b", "")], "activities array<string>")
    assert tuple(greedy_table(runs, line).first()) == (6, 4)  # nothing is missed of abc, and the empty trace goes on
    assert tuple(greedy_table(runs.where("false"), line).first()) == (0, 0)
    rel = spark.createDataFrame([("1", "a", 1, "x", "t"), ("2", "b", 2, "x", "t"), ("3", "b", 1, "y", "t")], "eid string, activity string, ts int, oid string, otype string")
    row = metrics(rel, line).first()
    assert tuple(row) == (2, 3, 2, 1.0, 0.5) and metrics_text(row).splitlines()[-1] == "fitness: 0.5000"


def test_patterns_count_in_conformance(spark):
    rel = spark.createDataFrame([("1", "a", 1, "x", "t"), ("2", "b", 2, "x", "t")], "eid string, activity string, ts int, oid string, otype string")
    s = Session.open(rel.withColumn("ts", F.timestamp_seconds("ts")))
    assert s.conformance() == (1.0, 1.0, 1.0) and s.violation_rate() == 0.0
    fitness, precision, _ = s.conformance(Node("a"))  # of start, end, step and two patterns the tree has start and pattern of a
    assert (fitness, precision) == (2 / 5, 2 / 3)
