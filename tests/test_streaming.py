"""A log that arrives in parts: the increments sum to the batch graph."""

import datetime as dt
import random
from pathlib import Path

import pytest

from skeinflow.operators import order
from skeinflow.operators.dfg import dfg_by_type
from skeinflow.streaming.steps import read_counts, read_late, write_counts

SCHEMA = "eid string, activity string, ts timestamp_ntz, oid string, otype string"
T0 = dt.datetime(2024, 1, 1)


def arrive(spark, path, parts, delay):
    """Each part in a file and a run of its own."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
        write_counts(stream, f"{path}/out", delay).awaitTermination()
        yield i


def rows(df):
    return sorted((tuple(r) for r in df.select("otype", "source", "target", "cnt").collect()), key=str)


def test_parts_sum_to_the_batch_graph(spark, tmp_path):
    rng = random.Random(5)
    log = [(f"e{i}", rng.choice(["a", "b", "c", None]), T0 + dt.timedelta(seconds=rng.randrange(400)), f"o{rng.randrange(6)}", "t") for i in range(300)]
    log += [(e, a, t + dt.timedelta(seconds=rng.randrange(-3, 3)), o, k) for e, a, t, o, k in rng.sample(log, 30)]  # repeated events
    log += [("n1", "a", None, "o1", "t"), ("x", "a", T0, None, "t")]
    log.sort(key=lambda r: ((r[2] or T0) - T0).total_seconds() + rng.random() * 300)  # out of order, by less than the delay
    parts = [log[:120], log[120:200], log[200:]]
    for i in arrive(spark, str(tmp_path), parts, 100_000):
        so_far = spark.createDataFrame([r for p in parts[: i + 1] for r in p if r[3] is not None], SCHEMA)
        assert rows(read_counts(spark, f"{tmp_path}/out")) == rows(dfg_by_type(so_far))
    assert read_late(spark, f"{tmp_path}/out").count() == 0


def test_short_delay_in_order_and_late(spark, tmp_path):
    log = [(f"e{i}", "abc"[i % 3], T0 + dt.timedelta(seconds=10 * i), f"o{i % 2}", "t") for i in range(60)]
    late = ("late", "a", T0 + dt.timedelta(seconds=15), "o1", "t")
    near = ("near", "c", T0 + dt.timedelta(seconds=565), "o1", "t")
    parts = [log[:30], log[30:], [late, near]]
    for _ in arrive(spark, str(tmp_path), parts, 60):
        pass
    want = dfg_by_type(spark.createDataFrame([*log, near], SCHEMA))
    assert rows(read_counts(spark, f"{tmp_path}/out")) == rows(want)
    assert [tuple(r) for r in read_late(spark, f"{tmp_path}/out").collect()] == [("t", "a", 1)]


def test_micro_batch_longer_than_the_delay_in_any_order(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "20")  # an object's events would reach Python in many chunks
    try:
        rng = random.Random(7)
        log = [(f"e{i:03}", rng.choice("abc"), T0 + dt.timedelta(seconds=10 * i), f"o{rng.randrange(2)}", "t") for i in range(400)]
        parts = [log[:300], log[295:] + [("gone", "a", T0 + dt.timedelta(seconds=5), "o1", "t")]]
        for p in parts:
            rng.shuffle(p)
        for _ in arrive(spark, str(tmp_path), parts, 120):
            pass
    finally:
        spark.conf.set(key, before)
    assert rows(read_counts(spark, f"{tmp_path}/out")) == rows(dfg_by_type(spark.createDataFrame(log, SCHEMA)))
    assert [tuple(r) for r in read_late(spark, f"{tmp_path}/out").collect()] == [("t", "a", 1)]
    assert sorted(p.name for p in (tmp_path / "out" / "held").iterdir()) == ["batch=0", "batch=1"]


def test_hot_object_over_micro_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(order, "HOT", 50)
    log = [(f"e{i:03}", "abc"[i * i % 7 % 3], T0 + dt.timedelta(seconds=10 * (i // 2)), "o0" if i % 5 else f"o{i % 3}", "t") for i in range(600)]
    for i in arrive(spark, str(tmp_path), [log[:250], log[240:400], log[400:]], 300):
        pass
    assert rows(read_counts(spark, f"{tmp_path}/out")) == rows(dfg_by_type(spark.createDataFrame(log, SCHEMA)))
    assert read_late(spark, f"{tmp_path}/out").count() == 0
