"""OCEL JSON in and out, timestamps, sessions and repairs."""

import itertools
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skeinflow.functions.timestamps import parse_time
from skeinflow.operators.relations import event_object_sets, pattern_maps, patterns, relations_from
from skeinflow.operators.traces import coverage, rule_violations, raw_traces, traces, violations
from skeinflow.plans import repair as R
from skeinflow.plans.cuts import discover, find_cut, redo_ok, sequence_ok
from skeinflow.plans.graph import bipartitions
from skeinflow.plans.session import Session
from skeinflow.plans.tree import Node, conformance_form
from skeinflow.sources import ocel
from skeinflow.sources.tables import clicks, orders

TIMES = {
    "2023-04-03T12:08:18+02:00": (10, 8), "2023-04-03T12:08:18.5Z": (12, 8), "Mon, 3 Apr 2023 12:08:18 +0200": (10, 8), "2023-04-03 12:08:18": (12, 8),
    "2023-04-03T12:08:18": (12, 8), "2023-04-03 12:08:18 UTC": (12, 8), "Mon Apr 03 2023 12:08:18 GMT+0200 (CEST)": (10, 8), "soon": None,
}
LOG = {
    "eventTypes": [{"name": "pay", "attributes": [{"name": "sum", "type": "float"}]}, {"name": "ship", "attributes": []}],
    "objectTypes": [{"name": "order", "attributes": []}, {"name": "item", "attributes": []}],
    "events": [
        {"id": "e1", "type": "pay", "time": "2023-01-01T00:00:00Z", "attributes": [{"name": "sum", "value": "1.5"}, {"name": "n", "value": "7"}, {"name": "ok", "value": "true"}, {"name": "at", "value": "2023-01-01T00:00:00Z"}, {"name": "who", "value": "x"}, {"name": "none", "value": None}],
         "relationships": [{"objectId": "o1", "qualifier": "of"}, {"objectId": "i1", "qualifier": "with"}]},
        {"id": "e2", "type": "ship", "time": "2023-01-02T00:00:00Z", "attributes": [], "relationships": [{"objectId": "i1", "qualifier": "a"}, {"objectId": "i1", "qualifier": "b"}, {"objectId": "lost", "qualifier": "c"}]},
    ],
    "objects": [
        {"id": "o1", "type": "order", "attributes": [{"name": "since", "value": "2", "time": "2023-01-01 00:00:00"}], "relationships": [{"objectId": "i1", "qualifier": "has"}]},
        {"id": "i1", "type": "item", "attributes": [], "relationships": []},
    ],
}


def test_times(spark):
    got = {r.t: r.at for r in spark.createDataFrame([(t,) for t in TIMES], "t string").select("t", parse_time(F.col("t")).cast("timestamp_ntz").alias("at")).collect()}
    assert {t: (x.hour, x.minute) if x else None for t, x in got.items()} == TIMES


def test_log(spark, tmp_path):
    (tmp_path / "log.json").write_text(json.dumps(LOG))
    log = ocel.read_log(spark, str(tmp_path / "log.json"))
    assert {k: v.count() for k, v in log.items()} == {"events": 2, "objects": 2, "e2o": 5, "o2o": 1, "event_attributes": 6, "object_attributes": 1, "types": 4}
    kinds = {r.name: r.kind for r in log["event_attributes"].collect()}
    assert kinds == {"sum": "float", "n": "integer", "ok": "boolean", "at": "time", "who": "string", "none": "null"}
    assert log["object_attributes"].first().time == datetime(2023, 1, 1) and log["types"].where("of = 'event'").count() == 2
    rel = relations_from(log["events"], log["objects"], log["e2o"])
    assert sorted((r.eid, r.activity, r.oid, r.otype) for r in rel.collect()) == [("e1", "pay", "i1", "item"), ("e1", "pay", "o1", "order"), ("e2", "ship", "i1", "item"), ("e2", "ship", "i1", "item")]
    maps = pattern_maps(patterns(rel))
    assert maps["relational"] == {"pay": ["item", "order"], "ship": ["item"]} and maps["divergent"] == maps["convergent"] == {"pay": [], "ship": []}
    assert {r.eid: r.objects for r in event_object_sets(rel).collect()} == {"e1": ["i1", "o1"], "e2": ["i1"]}
    assert {r.oid: r.activities for r in raw_traces(log["events"], log["e2o"]).collect()} == {"o1": ["pay"], "i1": ["pay", "ship", "ship"], "lost": ["ship"]}
    ocel.write_log(log["events"], log["objects"], log["e2o"], str(tmp_path / "out"))
    back = ocel.read_written_log(spark, str(tmp_path / "out"))
    for name in ("events", "objects"):
        same = log[name].select(*back[name].columns)
        assert back[name].exceptAll(same).count() == 0 and same.exceptAll(back[name]).count() == 0
    assert back["e2o"].count() == 4
    form = conformance_form(Node("redo", [Node("pay"), Node("tau")]), maps)
    assert form["operator"] == "Loop" and form["children"][0]["related"] == ["item", "order"] and form["children"][1]["activity"] is None


def test_graph_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(ocel.graph_json({("a", "b"): 3, ("b", "b"): 1}))
    assert sorted(map(tuple, ocel.read_graph(spark, str(tmp_path / "g.json")).collect())) == [("a", "b", 3), ("b", "b", 1)]


def test_redo_repair():
    edges = {("a", "x"): 5, ("x", "b"): 5, ("b", "y"): 5, ("y", "a"): 5, ("x", "y"): 2, ("y", "x"): 2}
    got = R.best_redo(edges, set("abxy"), {"a"}, {"b"}, {})
    assert (got.set1, got.set2, got.total_cost, got.added) == (["a", "b", "x"], ["y"], 4, [])
    # y is on both ways and neither breaks without it: in the body, so the way back gets a bypass and loses its edge to y
    edges = {("a", "x"): 5, ("x", "b"): 5, ("b", "c"): 5, ("c", "a"): 5, ("x", "y"): 1, ("y", "x"): 1, ("c", "y"): 2, ("a", "y"): 1, ("y", "b"): 1}
    got = R.best_redo(edges, set("abcxy"), {"a"}, {"b"}, dict.fromkeys(itertools.permutations("abcxy", 2), 3.0))
    assert (got.set1, got.set2, got.added, got.removed) == (["a", "b", "x", "y"], ["c"], [("c", "b", 3)], [("c", "y", 2)])
    assert redo_ok(got.apply(edges), set(got.set1), set(got.set2), {"a"}, {"b"})
    assert R.best_redo({("a", "b"): 1}, set("ab"), {"a"}, {"b"}, {}) is None


def test_sequence_by_removals_equals_exhaustive_where_it_holds():
    rng = random.Random(4)
    for _ in range(80):
        names = set("abcde"[: rng.randrange(2, 6)])
        edges = {e: rng.randrange(1, 9) for e in itertools.permutations(sorted(names), 2) if rng.random() < 0.6}
        best = []
        for one, two in bipartitions(names):
            back = {e for e in edges if e[0] in two and e[1] in one}
            if sequence_ok({e: w for e, w in edges.items() if e not in back}, one, two):
                best.append(sum(edges[e] for e in back))
        got = R.best_sequence_cut(edges, names)
        assert got is None or best and got.total_cost >= min(best) and sequence_ok(got.apply(edges), set(got.set1), set(got.set2))


@pytest.mark.parametrize("log", [orders, clicks])
def test_trees_take_the_first_kind_of_cut_that_holds(spark, sf, log):
    for scale in (sf, f"{sf}/../sf0.01"):
        s = Session.open(log(spark, scale))
        slow = find_cut(s.edges, s.activities, s.starts, s.ends, exhaustive=True)
        assert s.tree.label == (slow[0] if slow else "flower") and s.tree.activities() == s.activities
        assert str(s.tree) == str(discover(s.edges, s.activities, s.starts, s.ends))


def test_session_repairs_and_undoes(spark, sf):
    s = Session.open(clicks(spark, sf), noise=0.04)
    before, edges = str(s.tree), dict(s.edges)
    options = s.suggestions()
    assert options and not s.perfectly_cut
    choice = min(options, key=lambda x: x.total_cost)
    s.select(choice)
    assert s.totals() == (len(choice.removed), len(choice.added)) and str(s.tree) != before
    s.modify("0")
    assert s.edges == edges and s.totals() == (0, 0) and s.tree.activities() == s.activities and s.tree.label == "flower"


def test_violations_and_coverage(spark):
    at = datetime(2024, 1, 1)
    rows = [(str(i), a, at, o, "t") for i, (o, a) in enumerate([("1", "b"), ("1", "a"), ("2", "a"), ("2", "b"), ("3", "b")])]
    rel = spark.createDataFrame(rows, "eid string, activity string, ts timestamp, oid string, otype string")
    assert tuple(violations(rel, ["a"], ["b"], "sequence").first()) == (3, 1) and tuple(violations(rel, ["a"], ["b"], "exclusive").first()) == (3, 2)
    late = spark.createDataFrame([(str(i), a, at, "1", "t") for i, a in enumerate("aba")], rel.schema)
    assert tuple(violations(late, ["a"], ["b"], "sequence").first()) == (1, 1) and tuple(rule_violations(rel, []).first()) == (3, 0)
    assert tuple(rule_violations(rel.where("false"), [("sequence", {"a"}, {"b"})]).first()) == (0, 0)
    runs = spark.createDataFrame([(["a", "b"],), (["c"],)], "run array<string>")
    assert tuple(coverage(traces(rel), runs).first()) == (2, 1, 50.0) and tuple(coverage(traces(rel), runs.where("false")).first()) == (0, 0, 0.0)
