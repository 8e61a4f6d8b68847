"""What queries leave on disk while they go on."""

import time
from pathlib import Path

import pytest

from skeinflow.operators import forest as N
from skeinflow.operators.relations import patterns
from skeinflow.sources.scratch import keep, lean
from skeinflow.sources.tables import orders


def shuffled(spark) -> set[Path]:
    return set(Path(spark.sparkContext.getConf().get("spark.local.dir")).rglob("shuffle_*.data"))


def left(spark, before: set[Path]) -> set[Path]:
    """Shuffle files that came since ``before``; they go a moment after their plan has run."""
    for _ in range(50):
        if not (found := shuffled(spark) - before):
            break
        time.sleep(0.1)
    return found


@pytest.fixture
def key(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    yield name
    assert spark.conf.get(name) == was


def test_written_table_leaves_no_shuffle_files(spark, key):
    before = shuffled(spark)
    table = keep(spark.range(1000).groupBy("id").count(), "table")
    assert not left(spark, before) and table.count() == 1000
    with pytest.raises(ZeroDivisionError), lean(spark):
        1 / 0


def test_collapse_leaves_no_shuffle_files(spark, key):
    nodes = spark.sql("""
        SELECT 't' || id AS tree_id, n.node_id, n.parent_id, n.child_pos, n.label FROM range(300)
        JOIN VALUES ('0', NULL, 0, 'sequence'), ('0.0', '0', 0, 'a'), ('0.1', '0', 1, 'parallel'), ('0.1.0', '0.1', 0, 'b'), ('0.1.1', '0.1', 1, 'c') AS n(node_id, parent_id, child_pos, label)""")
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = N.collapse(nodes, nodes.where("node_id = '0.1'"))
        assert not left(spark, before)
        assert out.count() == 1500 and out.where("label = 'flower'").count() == 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_patterns_deal_events_once(spark, sf):
    rel = keep(orders(spark, sf), "relations")
    plan = patterns(rel)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(eid") == 1
    want = sorted(map(tuple, patterns(rel).collect()))
    assert want and sorted(map(tuple, patterns(rel, hot=2).collect())) == want  # lines have three rows each, placed orders two
