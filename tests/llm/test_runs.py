"""Periodic runs against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skeinflow.llm import periodic_runs
from skeinflow.llm.periodic_runs import find_runs, grid_runs, plain_runs
from skeinflow.llm.queries import echo, queries


def plain(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in out.items())


def collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def texts(seed):
    r, out = random.Random(seed), [None, "", " \n\t ", "a a a a a", "a a a a a a", "a\x1fb " * 6, "é é  " * 7, "Aa aa " * 4]
    for _ in range(80):
        n, k = r.choice([5, 6, 7, 8, 12, 40, 150]), r.choice([1, 2, 3, 60])
        w = [r.choice([f"w{i}" * r.choice([1, 1, 9]) for i in range(k)]) for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            a, q = r.randrange(n), r.randint(1, max(1, n // 5))
            for i in range(a + q, min(n, a + r.randint(1, n))):
                w[i] = w[i - q]
        out.append(r.choice([" ", "\n", "\t \x0b"]).join(w))
    return out


@pytest.mark.parametrize("pairs", [1 << 20, 50])
def test_runs_equal_plain(spark, monkeypatch, pairs):
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    for seed in range(6):
        some = texts(seed)
        for batch, view in ((some, None), (some, echo)):
            made = pa.record_batch([pa.array(range(len(batch))), pa.array(batch, pa.string())], names=["id", "text"])
            rows = [r for b in periodic_runs._scan(view)(iter([made])) for r in b.to_pylist()]
            for i, (text, r) in enumerate(zip(batch, rows, strict=True)):
                w = words(text)
                if view and w and (order := view(i, len(w))) is not None:
                    w = [w[x] for x in order]
                want = plain(w)
                assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == want
                assert r["collapsed"].encode() == collapsed(w, want)


def test_operator_edges(spark):
    df = spark.createDataFrame([(1, "x " * 9, "k"), (1, "x " * 9, "k"), (None, "a b c", None), (2, None, "k")], "doc_id long, text string, runs string")
    got = sorted(((r.doc_id is None, r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(df).collect())
    assert got == [((False, 1), [(0, 9, 1)], "x"), ((False, 1), [(0, 9, 1)], "x"), ((False, 2), [], ""), ((True, None), [], "a b c")]
    assert find_runs(df.limit(0)).count() == 0


def test_long_text_and_deceived_hashes(monkeypatch):
    unit = [f"w{i}" for i in range(1000)]
    long = " ".join(["begin", *unit * 1200, "end"])  # over 5 MB, across blocks
    other = "b " * 3 + "a b " * 100_000 + "c"
    batch = pa.record_batch([pa.array([1, 2]), pa.array([long, other])], names=["id", "text"])
    one, two = [r for b in periodic_runs._scan(None)(iter([batch])) for r in b.to_pylist()]
    assert [tuple(r.values()) for r in one["runs"]] == [(1, 1_200_000, 1000)] and one["collapsed"] == " ".join(["begin", *unit, "end"])
    assert [tuple(r.values()) for r in two["runs"]] == [(2, 200_001, 2)] and two["collapsed"] == "b b b a c"
    monkeypatch.setattr(periodic_runs, "_verified", lambda *a: False)
    short = pa.record_batch([pa.array([1]), pa.array(["z " + "a b " * 9])], names=["id", "text"])
    assert [tuple(r.values()) for b in periodic_runs._scan(None)(iter([short])) for r in b.to_pylist()[0]["runs"]] == [(1, 18, 2)]
    names = np.random.default_rng(1).integers(0, 2, 300)
    mixed = periodic_runs.mix(names.astype(np.uint64) + np.uint64(5))
    assert grid_runs(mixed, np.array([0, 300])).tolist() == plain_runs(names).tolist()


def test_query_equals_plain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {}
    for d in docs:
        w = words(d.text)
        h = zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = plain(w)
        a, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        text = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        want[d.doc_id] = (len(runs), a, n, q, 1000 * n // q if n else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs)).hexdigest())
    got = queries()["op13_periodic_runs"](spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and any(v[0] for v in want.values())
