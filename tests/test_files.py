"""Files that appear whole or not at all, and the round trip of what conformance checking takes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from skeinflow.operators.relations import pattern_maps, patterns, relations_from
from skeinflow.plans.session import Session
from skeinflow.plans.tree import Node
from skeinflow.sources.files import publish, read_conformance_tree, read_patterns, read_text, register_log, write_conformance, write_graph
from skeinflow.sources.ocel import graph_edges
from skeinflow.sources.ocel_split import read_large_log


def files(folder):
    return sorted(x for x in os.listdir(folder) if not x.endswith(".crc"))


def test_uploads_appear_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path)

    def broken():
        yield b'{"events"'
        assert files(folder) and all(x.endswith(".uploading") for x in files(folder))  # nobody sees the name yet
        raise OSError("connection lost")

    with pytest.raises(OSError, match="lost"):
        register_log(spark, folder, "x.json", broken())
    with pytest.raises(ValueError, match="more than 9 bytes"):
        register_log(spark, folder, "x.json", [b"12345", b"67890"], most=9)
    with pytest.raises(ValueError, match="log name"):
        register_log(spark, folder, "../x.json", [b"{}"])
    assert files(folder) == []
    assert read_text(spark, register_log(spark, folder, "x.json", [b'{"a":', b" 1}"])) == '{"a": 1}'
    with pytest.raises(OSError, match="lost"):  # a broken second upload leaves the first
        register_log(spark, folder, "x.json", failing())
    assert json.loads(read_text(spark, f"{folder}/x.json")) == {"a": 1}
    publish(spark, f"{folder}/x.json", [b"[2]"])
    assert read_text(spark, f"{folder}/x.json") == "[2]" and files(folder) == ["x.json"]


def failing():
    yield b"half"
    raise OSError("lost")


def test_graph_and_conformance_files(spark, tmp_path):
    rows = [("1", "a", 1, "x", "t"), ("1", "a", 1, "y", "t"), ("2", "b", 2, "x", "t"), ("3", "c", 3, "z", "s")]
    rel = spark.createDataFrame(rows, "eid string, activity string, ts int, oid string, otype string").withColumn("ts", F.timestamp_seconds("ts"))
    tree = Node("sequence", [Node("a"), Node("exclusive", [Node("redo", [Node("b"), Node("tau")]), Node("parallel", [Node("c"), Node("tau")])])])
    found = write_conformance(rel, patterns(rel), tree, str(tmp_path), "log")
    maps = pattern_maps(patterns(rel))
    assert read_patterns(spark, found["patterns"]) == maps and maps["convergent"]["a"] == ["t"]
    back, leaves = read_conformance_tree(spark, found["tree"])
    assert back == tree and leaves["convergent"] == maps["convergent"] and leaves["relational"] == maps["relational"]
    log = read_large_log(spark, found["log"])
    assert sorted(map(tuple, relations_from(log["events"], log["objects"], log["e2o"]).drop("ts").collect())) == sorted((a, b, d, e) for a, b, _, d, e in rows)
    edges = {("a", "b"): 3, ("b", "b"): 1}
    assert graph_edges(read_text(spark, write_graph(spark, str(tmp_path), "g", edges))) == edges


def test_self_loops_know_the_branch_of_their_activity(spark):
    traces = {"x": "acc", "y": "ab", "z": "a"}
    rows = [(f"{o}{i}", a, i, o, "t") for o, t in traces.items() for i, a in enumerate(t)]
    s = Session.open(spark.createDataFrame(rows, "eid string, activity string, ts int, oid string, otype string").withColumn("ts", F.timestamp_seconds("ts")))
    s.tree = Node("sequence", [Node("a"), Node("exclusive", [Node("b"), Node("c")])])
    assert ("c", "c") in s.edges
    assert str(s.with_self_loops()) == "sequence(a, exclusive(b, redo(c, tau)))"  # the second branch is held against itself
    assert str(s.with_self_loops(corrected=True)) == "sequence(a, exclusive(b, redo(tau, c)))"  # z has a, and neither b nor c
