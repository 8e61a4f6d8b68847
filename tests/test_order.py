"""Ranges, stitched order, running sums, fingerprints and automata against plain Python."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from skeinflow.operators import order
from skeinflow.operators import traces as T
from skeinflow.operators.dfg import dfg_by_type, successors
from skeinflow.operators.order import in_order, ranged, running_sums
from skeinflow.plans.automaton import Automata, walk
from skeinflow.plans.session import accepted_table, score_table
from skeinflow.plans.tree import Node, language

SCHEMA = "eid string, activity string, ts timestamp_ntz, oid string, otype string"


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small ranges are not put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def log(spark, seed, n=600, names="abc"):
    """A third of all events belong to one object, all on one day, many at the same time."""
    r, rows = random.Random(seed), []
    for i in range(n):
        oid = "hot" if r.random() < 0.4 else f"o{r.randrange(30)}"
        rows.append((f"e{i:05}", r.choice(names), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randrange(40)), oid, "t"))
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


def histories(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[3], []).append(r)
    return out


@pytest.mark.parametrize("hot", [10_000, 50])
def test_in_order_equals_plain(spark, hot):
    df, rows = log(spark, 1)
    df = df.union(df.limit(40))  # repeated rows count once
    got = {(r.oid, r.eid): (r.before.activity if r.before else None, r.pos, r.run) for r in in_order(df, once=True, hot=hot).collect()}
    want = {}
    for oid, events in histories(rows).items():
        run = 0
        for i, e in enumerate(events):
            before = events[i - 1][1] if i else None
            run += before != e[1]
            want[oid, e[0]] = (before, i + 1, run)
    assert got == want


def test_hot_object_is_spread_and_rows_stay(spark, monkeypatch):
    df, rows = log(spark, 2, 3000)
    plain = sorted(map(tuple, dfg_by_type(df).collect()))
    monkeypatch.setattr(order, "HOT", 100)
    assert sorted(map(tuple, dfg_by_type(df).collect())) == plain
    assert sum(r[3] for r in plain) == len(rows) - len(histories(rows))
    parts = ranged(df.where("oid = 'hot'"), ["oid", "ts", "eid"]).groupBy("_range").count().collect()
    assert len(parts) >= 6 and max(r["count"] for r in parts) < 0.4 * sum(r["count"] for r in parts)
    assert successors(df).where("source is null or target is null").count() == 0


def test_running_sums(spark):
    r = random.Random(3)
    rows = [("a" if r.random() < 0.7 else "b", i, r.randrange(9)) for i in range(500)]
    got = {(x.k, x.at): x.total for x in running_sums(spark.createDataFrame(rows, "k string, at int, v long").repartition(4), ["k"], ["at"], {"total": F.col("v")}).collect()}
    want, total = {}, {}
    for k, at, v in rows:
        total[k] = total.get(k, 0) + v
        want[k, at] = total[k]
    assert got == want


@pytest.mark.parametrize("hot", [10_000, 30])
def test_prints_tell_traces_apart(spark, monkeypatch, hot):
    monkeypatch.setattr(order, "HOT", hot)
    df, rows = log(spark, 4, 200)
    runs = {o: tuple(k for k, _ in itertools.groupby(e[1] for e in events)) for o, events in histories(rows).items()}
    got = {r.oid: r for r in T.trace_prints(df).collect()}
    every = T.run_prints(spark.createDataFrame([(o, list(t)) for o, t in runs.items()], "oid string, run array<string>")).collect()
    assert {r.oid: (r.n, r.x, r.y) for r in every} == {o: (r.n, r.x, r.y) for o, r in got.items()}
    assert {o: r.single for o, r in got.items()} == {o: len(t) == len(set(t)) for o, t in runs.items()}


def test_coverage_by_prints_equals_by_rows(spark):
    df, _ = log(spark, 5, 150)
    cut = T.sessions(df, 60)
    for loops in (["a"], ["a", "c"], []):
        variants = T.loop_variants(T.traces(cut), loops)
        some = [r.activities for r in variants.limit(30).collect()] + [["z"], ["a"] * 9, []]
        runs = spark.createDataFrame([(r,) for r in some], "run array<string>")
        assert T.log_coverage(cut, runs, loops).first() == T.coverage(variants, runs).first()
        assert sorted(map(tuple, T.variant_prints(cut, loops, 10**6).collect())) == sorted(tuple(r) for r in T.run_prints(variants, "activities").select("n", "x", "y").collect())


def test_sessions_split_at_gaps(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(f"e{i}", "a", at + dt.timedelta(seconds=s), "o", "t") for i, s in enumerate([0, 10, 20, 31, 31, 100])]
    got = T.sessions(spark.createDataFrame(rows, SCHEMA), 10).groupBy("oid").count().collect()
    assert sorted(r["count"] for r in got) == [1, 2, 3]


def random_tree(r, names, depth=3):
    if depth == 0 or r.random() < 0.2:
        return Node(r.choice([*names, "tau"]))
    kind = r.choice(["sequence", "exclusive", "parallel", "redo", "sequence", "exclusive", "flower"])
    return Node(kind, [random_tree(r, names, depth - 1) for _ in range(r.choice([1, 2, 2, 2, 3]))])


def test_automaton_equals_listing():
    r, seen = random.Random(6), 0
    for _ in range(300):
        tree = random_tree(r, "abcd")
        try:
            words = language(tree, 3000)
        except ValueError:
            continue
        machine = Automata()
        own = machine.of(tree)
        assert machine.count(own) == len(words)
        table = machine.table(own)
        assert all(walk(table, w) for w in words)
        assert not any(walk(table, w) for w in itertools.product("abcd", repeat=3) if w not in words)
        only = {tuple(a for a in w if a in "ab") for w in words}
        assert machine.count(machine.project(own, "ab")) == len(only)
        assert machine.count(machine.without_empty(own)) == len(words - {()})
        seen += 1
    assert seen > 150


def test_ten_parallel_activities_are_counted():
    tree = Node("a0")
    for i in range(1, 10):
        tree = Node("parallel", [tree, Node(f"a{i}")])
    machine = Automata()
    own = machine.of(tree)
    assert machine.count(own) == 3_628_800 and len(machine.table(own)) == 1024
    assert walk(machine.table(own), [f"a{i}" for i in (3, 1, 4, 0, 5, 9, 2, 6, 8, 7)]) and not walk(machine.table(own), ["a1"])
    with pytest.raises(ValueError):
        Automata(most=100).of(tree)
    deep = Node("sequence", [Node("x"), Node("y")])
    for i in range(3000):
        deep = Node("sequence", [Node(f"s{i}"), deep])
    assert Automata().of(Node("sequence", [Node("x"), Node("y")])) and machine.count(machine.of(deep)) == 1


def test_scores_by_automaton_equal_listing(spark):
    df, _ = log(spark, 7, 120, "abcd")
    few = df.where("oid <> 'hot'").withColumn("oid", F.concat("oid", F.minute("ts") % 9)).withColumn("otype", F.when(F.col("oid") < "o2", "u").otherwise("t"))
    trees = [
        Node("parallel", [Node("a"), Node("sequence", [Node("b"), Node("exclusive", [Node("c"), Node("tau")])])]), Node("redo", [Node("a"), Node("b")]),
        Node("exclusive", [Node("sequence", [Node("d"), Node("a")]), Node("parallel", [Node("b"), Node("c")])]), Node("flower", [Node("a"), Node("b")]), Node("z"),
    ]
    got = {r.candidate: (r.executions, r.fitting_executions, r.fitting_traces, r.traces) for r in accepted_table(few, trees).collect()}
    runs = spark.createDataFrame([(i, list(w)) for i, t in enumerate(trees) for w in language(t)], "candidate int, run array<string>")
    want = {r.candidate: (r.executions, r.fitting_executions, r.fitting_traces, r.traces) for r in score_table(few, runs, ["candidate"]).collect()}
    assert {k: v for k, v in got.items() if v[0]} == want and got[3][0] == 0 and any(v[2] for v in want.values())
