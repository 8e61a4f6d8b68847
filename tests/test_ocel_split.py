"""One document in many blocks equals the document in one row."""

import json
import random

import duckdb
import pytest

from skeinflow.queries import oracle_sql, queries
from skeinflow.sources.ocel import read_log
from skeinflow.sources.ocel_split import _blocks, brackets, elements, read_large_log, write_documents


def document(seed, n=300):
    r = random.Random(seed)
    odd = ['plain', 'brace } in {text}', 'quote \\" }', "back\\\\", 'é}"[', "", "x" * 4000, '"events":[{', "\\u007d"]
    events = [
        {
            "id": f"e{i}{r.choice(odd[:4])}", "type": r.choice(odd), "time": f"2024-01-01T00:00:{i % 60:02}Z",
            "attributes": [{"name": r.choice(odd), "value": r.choice(odd)} for _ in range(r.randrange(3))],
            "relationships": [{"objectId": f"o{r.randrange(9)}", "qualifier": r.choice(odd)} for _ in range(r.randrange(4))],
        }
        for i in range(n)
    ]
    objects = [{"id": f"o{i}", "type": "t", "attributes": [{"name": "a", "value": "1", "time": "2024-01-01T00:00:00Z"}], "relationships": [{"objectId": "o1", "qualifier": "q}"}]} for i in range(9)]
    types = [{"name": "t }", "attributes": [{"name": "a", "type": "string"}]}]
    return {"meta": {"events": [{"id": "no"}]}, "objectTypes": types, "events": events, "other": [1, [{"id": "no"}]], "objects": objects, "eventTypes": types, "end": "}"}


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("indent", [None, 1])
def test_blocks_equal_one_row(spark, tmp_path, small_blocks, indent):
    for i in range(2):
        (tmp_path / f"log{i}.json").write_text(json.dumps(document(i), indent=indent, ensure_ascii=bool(i)) + "\n" * i)
    lines = spark.read.option("lineSep", "}").text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20  # of two files
    got, want = read_large_log(spark, str(tmp_path)), read_log(spark, str(tmp_path))
    assert set(got) == set(want)
    for name in want:
        rows = [sorted(map(str, x[name].collect())) for x in (got, want)]
        assert rows[0] == rows[1] and rows[1], name


def test_empty_and_odd_documents(spark, tmp_path):
    for name, text in (("a", ""), ("b", "{}"), ("c", '{"events":[],"objects":[ ]}'), ("d", '{"events":[{"id":"x"}]}')):
        (tmp_path / f"{name}.json").write_text(text)
    assert [tuple(r) for r in elements(spark, str(tmp_path)).collect()] == [("events", '{"id":"x"}')]


def test_brackets():
    import numpy as np

    text = b'{"a\\"}": [1, "\\\\"]}'
    at, change, inside = brackets(np.frombuffer(text, np.uint8), 0)
    assert [text[i : i + 1] for i in at] == [b"{", b"[", b"]", b"}"] and change.tolist() == [1, 1, -1, -1] and not inside


def test_stretches_of_blocks():
    import numpy as np
    import pyarrow as pa

    rows = [("f", 0, "a"), ("f", 0, None), ("f", 9, "é"), ("g", 9, ""), ("g", 9, "x" * (1 << 20)), ("g", 9, "y")]
    batches = [pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["file", "block", "value"])] * 2
    got: dict = {}
    for key, text in _blocks(iter(batches)):
        assert text.dtype == np.uint8 and text[-1] == ord("}")
        got.setdefault(key, []).append(text.tobytes())
    assert {k: b"".join(v) for k, v in got.items()} == {("f", 0): b"a}}" * 2, ("f", 9): "é}".encode() * 2, ("g", 9): (b"}" + b"x" * (1 << 20) + b"}y}") * 2}
    assert len(got["g", 9]) > 2  # long stretches are cut


def test_events_are_parsed_once(spark, tmp_path):
    (tmp_path / "log.json").write_text(json.dumps(document(3)))
    found = read_large_log(spark, str(tmp_path))
    for name in ("events", "objects", "e2o", "o2o", "event_attributes", "object_attributes"):
        assert "from_json" not in found[name]._jdf.queryExecution().optimizedPlan().toString()


def test_documents_written(spark, tmp_path):
    at = "timestamp_ntz '2024-01-01 00:00:00.123456'"
    events = spark.sql(f"SELECT 'e' || id AS id, 't' || id % 2 AS type, {at} AS time FROM range(50)")
    objects = spark.sql("SELECT 'o' || id AS id, 'k' AS type FROM range(5)")
    links = spark.sql("SELECT 'e' || id AS event_id, 'o' || id % 7 AS object_id, 'q' AS qualifier FROM range(50)")
    more = spark.sql("SELECT 'e3' AS event_id, 'size' AS name, '12' AS value")
    write_documents(events, objects, links, str(tmp_path / "log"), 20, more)
    files = list((tmp_path / "log").glob("*/*.txt"))
    docs = [json.loads(f.read_text()) for f in files]
    assert len(docs) == 3 and all([t["name"] for t in d["eventTypes"]] == ["t0", "t1"] and d["objectTypes"] for d in docs)
    assert docs[0]["eventTypes"][1]["attributes"] == [{"name": "size", "type": "string"}]
    found = read_large_log(spark, str(tmp_path / "log"))
    assert found["events"].count() == 50 and found["objects"].count() == 5 and found["e2o"].count() == sum(i % 7 < 5 for i in range(50))
    assert [tuple(r)[:3] for r in found["event_attributes"].collect()] == [("e3", "size", "12")]
    assert found["events"].where("time = timestamp '2024-01-01 00:00:00.123456'").count() == 50


@pytest.mark.parametrize("name", ["relations_ocel_keys"])
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(oracle_sql()[name]).df()
    got = queries()[name](spark, sf).toPandas()[list(want.columns)]
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, want.values.tolist()))
