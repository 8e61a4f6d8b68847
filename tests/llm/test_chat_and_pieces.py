"""SentencePiece transducer, tool-call linking, SQL of the llm queries."""

import json
import random

import duckdb
import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import functions as F

from skeinflow.llm._io import Scratch
from skeinflow.llm.piece_transducer import Transducer, decode, encode
from skeinflow.llm.queries import op9_tool_links, oracle_sql, queries, tokenizer_file
from skeinflow.llm.tool_links import canonical_json, faults, levels, link

ODD = ["", "  a  b   c ", "日本語 テスト🎉", "x" * 3000, "a▁b", "def f(x):\n    return  x\t\t1", "<s> </s> <unk> <0x0A>", "ﬁ Ⅳ é", "\x00\x01"]


def test_pieces_equal_the_library(spark, sf):
    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    both = docs.union(spark.createDataFrame([*[(9000 + i, t) for i, t in enumerate(ODD)], (None, None)], docs.schema)).withColumnRenamed("doc_id", "id")
    texts = {r.id: r.text or "" for r in both.collect()}
    encoded = encode(both, path, id_col="id")
    got = {r.id: r.ids for r in encoded.collect()}
    assert got == {i: library.encode(t) for i, t in texts.items()}
    assert {r.id: r.text for r in decode(encoded, path, id_col="id").collect()} == {i: library.decode(library.encode(t)) for i, t in texts.items()}
    assert encode(both.where("false"), path, id_col="id").count() == 0


def test_unigram_takes_the_shortest_path(tmp_path):
    def field(n, kind, data):
        return bytes([n << 3 | kind]) + data

    def piece(text, score, kind=1):
        import struct

        body = field(1, 2, bytes([len(text.encode())]) + text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        return field(1, 2, bytes([len(body)]) + body)

    pieces = [("<unk>", 0, 2), ("▁a", -1, 1), ("b", -1.5, 1), ("▁ab", -3, 1), ("bc", -1, 1), ("▁", -2, 1), ("a", -2, 1), ("c", -2, 1)]
    path = tmp_path / "m.model"
    path.write_bytes(b"".join(piece(*p) for p in pieces) + field(2, 2, b"\x02" + field(3, 0, b"\x01")))
    t, library = Transducer(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert not t.bpe
    for text in ("ab", "abc", "a b", "abcb", "abzc", "zz"):
        assert t.encode(text).tolist() == library.encode(text)


def test_links(spark):
    calls = spark.createDataFrame(
        [
            (1, 0, "a", "add", {"x": "1", "y": '"q"'}, None, 9), (1, 2, "b", "add", {"x": "2"}, ["a"], 9), (1, 3, "c", "add", {"y": '"q"', "x": '"w"'}, ["b", "zz"], 9),
            (1, 4, "d", "add", {"x": "1"}, ["e"], 9), (1, 5, "e", "none", None, ["d"], 9), (1, 9, "a", "add", {"x": "7"}, None, 9), (2, 0, "a", "add", None, None, 9), (None, 0, None, "add", {"x": "1"}, None, 9),
        ],
        "conv_id long, turn long, call_id string, tool string, arguments map<string,string>, after array<string>, status int",
    )
    results = spark.createDataFrame([(1, "a", 'say "hi"\n'), (1, "a", "z"), (1, "b", None), (1, "c", "r"), (3, "q", "lost"), (None, None, "n")], "conv_id long, call_id string, content string")
    schemas = spark.createDataFrame([("add", ["x"], {"x": "integer", "y": "string"})], "tool string, required array<string>, types map<string,string>")
    rows = link(calls, results, schemas).collect()
    got = {(r.conv_id, r.call_id, r.part): r for r in rows}
    assert len(rows) == len(got) == 12
    assert {k[1]: (r.level, r.status) for k, r in got.items() if k[0] == 1 and k[2] == 0} == {
        "a": (0, "ok"), "b": (1, "ok"), "c": (2, "type of x"), "d": (None, "cycle"), "e": (None, "unknown tool")
    }
    assert got[2, "a", 0].status == "missing x" and got[3, "q", 1].status == "no call" and got[1, "a", 1].turn == 0
    assert got[1, "a", 0].json == '{"arguments":{"x":1,"y":"q"},"id":"a","name":"add","type":"call"}'
    assert json.loads(got[1, "a", 1].json)["content"] == 'say "hi"\n' and json.loads(got[1, "b", 1].json)["content"] is None
    assert link(calls.where("false"), results.where("false"), schemas).count() == 0


def test_arguments_are_parsed(spark):
    assert canonical_json('{"b": 1,  "a": [1.0, {"z": 2.5, "y": null}]}') == ('{"a":[1,{"y":null,"z":2.5}],"b":1}', "object")
    assert canonical_json("{oops") == ('"{oops"', "malformed") and canonical_json("NaN")[1] == "malformed" and canonical_json("[" * 100_000)[1] == "malformed"
    assert [canonical_json(x)[1] for x in ('"é"', "1", "1.0", "1e3", "1.5", "true", "null", "[]")] == ["string", "integer", "integer", "integer", "number", "boolean", "null", "array"]
    assert canonical_json("1e17") == canonical_json("100000000000000000") == ("100000000000000000", "integer") and canonical_json("1e-7") == canonical_json("0.0000001")
    assert canonical_json('"\\ud800"') == ('"\\"\\\\ud800\\""', "malformed") and canonical_json('{"a":{"b":1,"b":2}}')[1] == "malformed" and canonical_json('"\\ud83d\\ude00"') == ('"😀"', "string")
    rows = [(1, 9, "z", "t", {"o": '"\\ud800"', "n": "3"}, None), (1, 0, "a", "t", {"o": '{ "k": 1.0 }', "n": "3"}, None), (1, 1, "b", "t", {"o": "{oops", "n": "3"}, None), (1, 2, "c", "t", {"o": "[]", "n": "3"}, None), (1, 3, "d", "t", {"n": "x"}, None)]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, tool string, arguments map<string,string>, after array<string>")
    schemas = spark.createDataFrame([("t", ["o"], {"o": "object", "n": "number"}), ("t", ["z"], {})], "tool string, required array<string>, types map<string,string>")
    results = spark.createDataFrame([(1, "a", "x")], "conv_id long, call_id string, content string")
    got = {r.call_id: r for r in link(calls, results, schemas).where("part = 0").collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "ok", "b": "malformed o", "c": "type of o", "d": "malformed n", "z": "malformed o"}
    assert json.loads(got["a"].json)["arguments"] == {"n": 3, "o": {"k": 1}} and all(json.loads(r.json) for r in got.values())


def test_links_over_conversations(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    got = op9_tool_links(spark, sf).collect()
    asked = {(r.conv_id, r.turn) for r in turns if r.role != "assistant"}
    assert {(r.conv_id, r.turn) for r in got if r.part == 0} == asked
    answers = {(r.conv_id, f"call-{r.turn - 1}"): r.text for r in turns if r.role == "assistant"}
    assert {(r.conv_id, r.call_id): json.loads(r.json)["content"] for r in got if r.part == 1} == answers
    assert all((r.status == "ok") == ((r.conv_id, r.call_id) in answers) for r in got if r.part == 0)


def test_repeated_turns_stay(spark, sf, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 1, "assistant", "x"), (1, 1, "assistant", "y"), (1, 1, "assistant", None), (2, 0, "system", "c"), (None, 0, "user", "d"), (None, 0, "user", "d")]
    schema = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").schema
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op9_tool_links(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)

    def texts(status, part):
        found = [json.loads(r.json) for r in got if r.status == status and r.part == part]
        return sorted((x["content"] if part else x["arguments"]["text"] for x in found), key=str)

    assert texts("ok", 0) == ["a"] and texts("ok", 1) == ["x"]
    assert texts("repeated id", 0) == ["b", "b"] and texts("repeated id", 1) == [None, "y"]
    assert texts("no result", 0) == ["c", "d", "d"]
    assert {(r.turn, r.level) for r in got if r.status == "repeated id"} == {(0, None), (None, None)}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(oracle_sql()[name]).df()
    got = queries()[name](spark, sf).toPandas()[want.columns.tolist()]

    def key(df):
        return sorted((tuple(None if pd.isna(x) else x for x in r) for r in df.itertuples(index=False)), key=str)

    assert key(got) == key(want)


@pytest.mark.parametrize("local", [0, 8, 100_000])
def test_levels_by_tasks_and_by_joins(spark, local):
    rng = random.Random(11)
    calls, want = [], {}
    for conv in range(12):
        names = [f"c{i}" for i in range(8)]
        after = {c: rng.sample(names, rng.choice((0, 0, 1, 2))) + ["unknown"] * (rng.random() < 0.2) for c in names}
        needs = {c: [x for x in after[c] if x in after] for c in names}
        level: dict = {}
        for _ in names:  # fixed point
            level |= {c: max((level[n] + 1 for n in needs[c]), default=0) for c in names if all(n in level for n in needs[c])}
        want |= {(conv, c): level.get(c) for c in names}
        calls += [(conv, c, after[c]) for c in names]
    df = spark.createDataFrame(calls, "conv_id long, call_id string, after array<string>")
    got = levels(df, Scratch(spark, "levels"), local)
    assert {(r.conv_id, r.call_id): r.level for r in got.collect()} == want


def test_a_long_chain_takes_no_rounds(spark):
    n = 5000
    calls = spark.range(n).selectExpr("'x' conv_id", "cast(id as string) call_id", "array(cast(id - 1 as string)) after")
    assert {int(r.call_id): r.level for r in levels(calls, Scratch(spark, "chain")).collect()} == {i: i for i in range(n)}


SCHEMA = {
    "type": "object", "required": ["to"], "additionalProperties": False,
    "properties": {
        "to": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "minLength": 1}, "age": {"type": "number", "minimum": 0}}, "additionalProperties": {"type": "integer"}},
        "how": {"enum": ["fast", 1, None]}, "tags": {"type": "array", "items": {"type": ["string", "null"]}, "maxItems": 2}, "any": {"anyOf": [{"type": "string"}, {"const": 7}], "not": {"const": "no"}},
    },
}


@pytest.mark.parametrize(("value", "want"), [
    ({"to": {"name": "a"}}, []), ({"to": {"name": "a", "age": 1.5, "z": 3}, "how": None, "tags": ["a", None], "any": 7}, []),
    ({}, ["missing to"]), ({"to": {}}, ["missing to.name"]), ({"to": {"name": ""}}, ["range of to.name"]), ({"to": {"name": "a", "age": -1}}, ["range of to.age"]),
    ({"to": {"name": "a", "z": "w"}}, ["type of to.z"]), ({"to": {"name": "a"}, "more": 1}, ["extra more"]), ({"to": {"name": "a"}, "how": True}, ["enum of how"]),
    ({"to": {"name": "a"}, "tags": ["a", 1, "c"]}, ["range of tags", "type of tags[1]"]), ({"to": {"name": "a"}, "any": 8}, ["choice of any"]),
    ({"to": {"name": "a"}, "any": "no"}, ["choice of any"]), ([], ["type of arguments"]),
])
def test_faults(value, want):
    assert list(faults(value, SCHEMA)) == want


def test_nested_schemas_in_links(spark):
    calls = spark.createDataFrame(
        [(1, i, str(i), "send", a, None) for i, a in enumerate([{"to": '{"name":"x"}'}, {"to": '{"name":3}'}, {"to": '{"name":'}, None])] + [(1, 9, "9", None, {"to": "1"}, None)],
        "conv_id long, turn long, call_id string, tool string, arguments map<string,string>, after array<string>",
    )
    results = spark.createDataFrame([], "conv_id long, call_id string, content string")
    schemas = spark.createDataFrame([("send", None, None, json.dumps(SCHEMA)), ("other", ["a"], None, None)], "tool string, required array<string>, types map<string,string>, schema string")
    got = {r.call_id: r.status for r in link(calls, results, schemas).collect()}
    assert got == {"0": "no result", "1": "type of to.name", "2": "malformed to", "3": "missing to", "9": "unknown tool"}
    with pytest.raises(ValueError, match="no object"):
        link(calls, results, schemas.withColumn("schema", F.lit("[1]"))).collect()
