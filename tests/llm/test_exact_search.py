"""The Voronoi join and the ball trees against plain NumPy."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.llm import ball_tree, voronoi_join
from skeinflow.llm.ball_tree import BallTree, hard_negatives, search
from skeinflow.llm.queries import oracle_sql, queries
from skeinflow.llm.voronoi_join import plan, spread, top_products
from skeinflow.llm._vectors import Best, products

SCHEMA = "vec_id long, embedding array<double>, label int, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "clash") for i, v, lab in rows], SCHEMA).repartition(3)


def usable(rows, scale):
    return [(i, [int(np.floor(scale * x)) for x in v], lab) for i, v, lab in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))  # a shorter vector ends in zeros


def plain_top(rows, asks, k, scale=64):
    data, out = usable(rows, scale), []
    for q, v, _ in usable(asks, scale):
        best = sorted((-dot(v, w), i) for i, w, _ in data if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def plain_negatives(rows, every, positives=5, negatives=10):
    data, out = [x for x in usable(rows, 256) if x[2] is not None], []
    for q, v, lab in data:
        if q % every:
            continue
        pos = sorted((-dot(v, w), i) for i, w, other in data if i != q and other == lab)[:positives]
        for p, pid in pos:
            p = -p
            neg = sorted((-dot(v, w), i) for i, w, other in data if i != q and other != lab and 30 * p <= 100 * dot(v, w) <= 90 * p)[:negatives]
            out += [(q, pid, r + 1, i, p, -s) for r, (s, i) in enumerate(neg)]
    return sorted(out)


def clustered(seed, n, d=6):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, d))
    v = middles[rng.integers(0, 5, n)] + 0.05 * rng.normal(size=(n, d))
    v[: n // 3] = v[0]  # a third of all rows are copies
    v[n // 3 : n // 3 + 5] *= 20  # outliers
    return [(int(i), [float(x) for x in row], int(rng.integers(0, 3) if k % 2 else 0)) for k, (i, row) in enumerate(zip(rng.permutation(n), v))]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_plain(spark, monkeypatch, seed):
    monkeypatch.setattr(voronoi_join, "QUERIES", 16)  # several groups and blocks
    monkeypatch.setattr(voronoi_join, "ROWS", 100)
    rows = clustered(seed, 400)
    df = table(spark, rows)
    got = sorted(map(tuple, top_products(df, df.where("vec_id % 7 = 0"), k=5).collect()))
    assert got == plain_top(rows, [r for r in rows if r[0] % 7 == 0], 5)


def test_join_prunes_and_stays_whole():
    rng = np.random.default_rng(5)
    x = np.concatenate([np.floor(64 * (c + 0.01 * rng.normal(size=(200, 4)))) for c in (np.eye(4) * 3)])
    pivots = spread(x, 8)
    cell, far = voronoi_join.assign(x, pivots)
    held = {int(c): (int((cell == c).sum()), float(far[cell == c].max()), 1e9) for c in np.unique(cell)}
    near = {c: sorted(far[cell == c].tolist())[:6] for c in held}
    made = plan(pivots, {c: (n, f) for c, (n, f, _) in held.items()}, held, near, 6, 4)
    # one group of queries here: a cell is left out only if no query needs it
    assert {m[0] for m in made if m[4] >= 0} <= set(held)
    for q in range(0, 800, 40):
        group = next(m[1] for m in made if m[4] < 0 and m[0] == cell[q])
        least = {m[0]: m[5] for m in made if m[4] >= 0 and m[1] == group}
        best = np.argsort(-(x @ x[q]), kind="stable")[:5]
        assert all(cell[b] in least and far[b] >= least[cell[b]] for b in best)


def test_join_edges(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 0.0], 1),
        (7, [0.5], 1), (8, [], 1), (9, [-1.0, -1.0], 1), (10, [1.0, 0.0], 1), (10, [0.25, 0.5], 1), (None, [1.0, 1.0], 1), (20, [1.0, 0.0], 1),
    ]
    df = table(spark, rows)
    got = sorted(map(tuple, top_products(df, df.where("vec_id % 10 = 0"), k=4).collect()))
    assert got == plain_top(rows, [r for r in rows if r[0] is not None and r[0] % 10 == 0], 4)
    asks = df.where("vec_id = 0")
    assert top_products(df, asks.union(asks), k=2).count() == 2  # equal queries are answered once
    assert top_products(df.limit(0), asks, k=3).count() == 0
    assert top_products(df, df.limit(0), k=3).count() == 0
    many = table(spark, [(3, [1.0, float(i)], 1) for i in range(40)] + [(9, [0.0, 2.0], 1)])  # more rows share a query's id than cells promise for
    assert [tuple(r) for r in top_products(many, many.where("vec_id = 9"), k=1).collect()] == [(9, 1, 3, 2 * 39 * 64 * 64)]
    assert {r.vec_id for r in top_products(many, many.where("vec_id = 3"), k=2).collect()} == {9}


def test_products_are_exact():
    big = np.array([[2.0**30, 3.0]])
    assert products(big, big, 2.0**60 + 9)[0, 0] == 2**60 + 9
    with pytest.raises(ValueError):
        products(big * 4, big * 4, 2.0**64)


def test_best_keeps_ties_by_id():
    best = Best(1, 2, np.float64)
    best.put(np.array([0]), np.array([[5.0] * 50]), np.arange(100, 50, -1))
    best.put(np.array([0]), np.array([[5.0, 4.0, -np.inf]]), np.array([7, 1, 2]))
    assert best.id.tolist() == [[7, 51]]


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_equal_plain(spark, monkeypatch, seed):
    monkeypatch.setattr(ball_tree, "ROWS", 60)  # several parts of a label
    monkeypatch.setattr(ball_tree, "ANCHORS", 7)
    rows = clustered(seed, 300)
    got = sorted(map(tuple, hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0).collect()))
    assert got == plain_negatives(rows, 10) and got


def test_negatives_edges(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.5], 1), (3, [0.5, 0.0], 2), (4, [0.5, 0.0], 2), (5, [0.9, 0.0], 3), (6, [0.2, 0.0], 2), (7, None, 2),
        (8, [None, 1.0], 2), (9, [0.5, 0.0], None), (11, [float("nan"), 1.0], 2), (12, [0.5], 4), (None, [0.5, 0.0], 2), (10, [-1.0, 0.0], 2), (20, [0.0, 0.0], 5), (30, [0.7, 0.7], 9),
        (3, [0.6, 0.0], 2),  # repeats an id
    ]
    got = sorted(map(tuple, hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0).collect()))
    assert got == plain_negatives(rows, 10) and got
    assert hard_negatives(table(spark, rows).limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives(table(spark, rows), F.lit(False)).count() == 0
    assert hard_negatives(table(spark, [(0, [1.0], 1)]), F.lit(True)).count() == 0


def test_tree_leaves_out_what_cannot_matter():
    rng = np.random.default_rng(3)
    x = np.concatenate([np.floor(256 * (c + 0.01 * rng.normal(size=(500, 4)))) for c in np.eye(4)])
    tree = BallTree(x, np.arange(2000), np.repeat([0, 1], 1000))
    q = x[3]
    assert 0 < len(tree.leaves(q, 50_000, 80_000, lambda label: True)) < sum(1 for s in tree.span if s) / 2
    scores = (x @ q).astype(int)
    for low, high in ((0, 100), (60_000, 61_000), (-(1 << 62), 1 << 62)):
        names, got = search(tree, q, 3, 1, False, [(low, high)], 7)[0]
        want = sorted((-scores[i], i) for i in range(1000) if i != 3 and low <= scores[i] <= high)[:7]
        assert [(-s, i) for s, i in zip(got.tolist(), names.tolist())] == want


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_voronoi_join"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(oracle_sql()[name]).df()
    got = queries()[name](spark, sf).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist())) and len(want)
