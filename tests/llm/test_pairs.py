"""Near-duplicate operators and search against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from skeinflow.llm import vertical_join
from skeinflow.llm._graph import components, merged
from skeinflow.llm.kd_search import chi_square_point, nearest
from skeinflow.llm.lattice_dedup import decode_e8, near_duplicates
from skeinflow.llm.vertical_join import jaccard_components, keep_one, sign


def components_of(ids, links):
    root = {i: i for i in ids}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = up(a), up(b)
        root[max(a, b)] = min(a, b)
    return {i: up(i) for i in ids}


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard_components(spark, k, percent):
    rng = random.Random(k * 100 + percent)
    texts = {}
    for group in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 6, 12, 30, 90, 400]))]
        for _ in range(rng.randrange(1, 7)):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(1000)}"
            texts[len(texts)] = rng.choice(["\t", " ", "\n "]).join(own)
    texts |= {1000: None, 1001: "", 1002: " \n", 1003: "A b", 1004: "a B", 1005: "a b c"}
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    links = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    want = components_of(sets, links)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, id string, component_id int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, k=k, percent=percent).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_of_shared_passages_in_slices(spark, monkeypatch):
    """Signatures meet slice by slice, and what is compared at last goes to its signatures once, whatever hubs find."""
    rng = random.Random(4)
    passages = [[f"p{i}-{j}" for j in range(60)] for i in range(4)]
    texts = {}
    for i in range(160):
        own = [f"q{i % 40}-{j}" for j in range(45)]
        words = own[:20] + passages[i % 4] + own[20:]
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    sets = {i: shingle_set(t, 5) for i, t in texts.items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_of(sets, links)
    made, put = [], vertical_join.Scratch.put
    monkeypatch.setattr(vertical_join.Scratch, "put", lambda self, df, tag: made.append(tag) or put(self, df, tag))
    monkeypatch.setattr(vertical_join, "WHOLE", 0, raising=False)
    monkeypatch.setattr(vertical_join, "LARGE", 2, raising=False)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in jaccard_components(df, k=5, percent=80).collect()} == want
    assert made.count("ties") == 4
    assert made.count("open-prefix") == 1 and made.count("hub-links") == 1


def test_merged_components(spark):
    """More links join components as what they are: of 200 nodes in two chains, one link makes two nodes."""
    made = []
    scratch = vertical_join.Scratch(spark, "test")
    label = components(spark.createDataFrame([(i, i + 2) for i in range(200)], "a long, b long"), scratch)
    put = scratch.put
    scratch.put = lambda df, tag: made.append((tag, out := put(df, tag), out.count())) or out
    got = merged(label, spark.createDataFrame([(57, 20), (300, 57), (401, 400), (3, 5)], "a long, b long"), scratch)
    want = components_of([*range(202), 300, 400, 401], [*((i, i + 2) for i in range(200)), (57, 20), (300, 57), (401, 400)])
    assert {r.node: r.component for r in got.collect()} == want
    assert max(n for tag, _, n in made if tag == "edges") == 6


def test_small_sets_with_empty_fragments_share_a_signature():
    rng = np.random.default_rng(6)

    def signed(s, percent):
        return set(sign(np.sort(s), np.array([0, len(s)]), percent)[0].tolist())

    quarter = 1 << 62
    a = rng.integers(0, quarter, 8, dtype=np.uint64)
    b = np.concatenate([a, rng.integers(0, quarter, 1, dtype=np.uint64), rng.integers(quarter, 2 * quarter, 1, dtype=np.uint64)])
    assert signed(a, 80) & signed(b, 80)
    for percent in (70, 80, 90):
        for _ in range(3000):
            n = int(rng.integers(2, 24))
            union = np.unique(np.concatenate([rng.integers(0, 1 << 60, n, dtype=np.uint64), rng.integers(0, 1 << 63, n // 3 + 1, dtype=np.uint64)]))
            rng.shuffle(union)
            spare = len(union) * (100 - percent) // 100
            x = int(rng.integers(0, spare + 1))
            a, b = union[x:], np.concatenate([union[:x], union[spare:]])
            assert 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
            assert len(a) == len(b) == len(union) or signed(a, percent) & signed(b, percent), (percent, len(a), len(b))


def test_jaccard_hot_group_and_edges(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:59], f"y{i}"])) for i in range(300)] + [(1000 + i, " ".join(base)) for i in range(300)] + [(None, " ".join(base)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(df, k=3, percent=90).collect()}
    assert len(got) == 601 and {v for i, v in got.items() if i is not None} == {0} and got[None] is None
    assert sorted(r.doc_id for r in keep_one(df.where("doc_id is not null")).collect()) == [0]
    assert keep_one(df).count() == 3
    assert jaccard_components(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="percent"):
        jaccard_components(df, percent=40)


def test_keep_one_with_repeated_ids(spark):
    copied, clean, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, copied, "r0"), (5, copied, "r1"), (5, clean, "r2"), (5, clean, "r3"), (7, clean + " z", "r4"), (3, third, "r5"), (3, third, "r6"), (8, None, "r7"), (8, None, "r8"), (None, copied, "r9"), (None, None, "r10")]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3))
    assert got.columns == ["doc_id", "text", "row"]
    found = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert found == sorted([(1, copied), (5, clean), (3, third), (8, None), (8, None), (None, copied), (None, None)], key=str)


def test_decoder_finds_nearest_lattice_point():
    from skeinflow.llm.lattice_dedup import _minimal

    x = np.random.default_rng(1).normal(size=(500, 8)) * 2
    p = decode_e8(x)
    assert np.all(np.isin((2 * p) % 2, [0, 1])) and np.all(p.sum(1) % 2 == 0)
    own = ((x - p) ** 2).sum(1)
    for v in _minimal():
        assert np.all(own <= ((x - p - v) ** 2).sum(1) + 1e-9)


def test_lattice_near_duplicates(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 64))
    vectors = {}
    for c in centres:
        for _ in range(rng.integers(1, 8)):
            vectors[len(vectors)] = c + rng.normal(size=64) * rng.choice([0.0, 0.05, 0.15, 0.2, 0.25])
    ids = np.array(list(vectors))
    unit = np.array([v / np.linalg.norm(v) for v in vectors.values()])
    cos = unit @ unit.T
    links = [(int(ids[a]), int(ids[b])) for a, b in itertools.combinations(range(len(ids)), 2) if cos[a, b] >= 0.95]
    want = components_of(ids.tolist(), links)
    n = {i: sum(i in x for x in links) for i in want}
    rows = [(i, v.tolist(), 1, 2) for i, v in vectors.items()]
    odd = [(900, None, 1, 1), (901, [], 1, 1), (902, [0.0] * 64, 1, 1), (903, [float("nan")] + [1.0] * 63, 1, 1), (904, [None] + [1.0] * 63, 1, 1), (905, [1.0, 2.0], 1, 1), (906, [2.0, 4.0], 1, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, kept int, id int").repartition(4)
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(odd)
    found = sum(got[i].n_links for i in n)
    assert found >= 0.995 * sum(n.values()) and all(got[i].n_links <= n[i] for i in n)
    assert sum(got[i].component_id == want[i] for i in n) >= 0.99 * len(n)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(900, 905))
    assert (got[905].n_links, got[906].component_id, got[906].kept) == (1, 905, False)
    assert near_duplicates(df.where("false")).count() == 0
    twice = [(1, [1.0, 2.0]), (1, [5.0, -1.0]), (4, [5.01, -1.0]), (5, [1.0, 2.01]), (None, [1.0, 2.0])]  # an id on rows with different vectors
    rows = near_duplicates(spark.createDataFrame(twice, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in rows) == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (4, 1, 1), (5, 1, 1)]


def test_lattice_hot_copies(spark):
    df = spark.range(2000).selectExpr("id as vec_id", "cast(if(id % 3 = 0, array(1, 2, 3), array(id, -id * id, 7)) as array<float>) as embedding")
    got = {r.vec_id: r for r in near_duplicates(df).where("vec_id % 3 = 0").collect()}
    assert {r.n_links for r in got.values()} == {666} and {r.component_id for r in got.values()} == {0}


def test_kd_search(spark):
    assert abs(chi_square_point(0.95, 10) - 18.307) < 1e-3
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 16))
    vectors[7] = vectors[300]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    odd = [(5000, None, 0), (5100, [0.0] * 16, 0), (5200, [float("inf")] * 16, 0), (5300, [], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int").repartition(3)
    got = nearest(df, df.where("vec_id % 100 = 0"), k=10).toPandas()
    assert sorted(got.query_id.unique()) == list(range(0, 3000, 100))
    hit = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        hit += len(set(want) & set(g.vec_id))
        assert g["rank"].tolist() == list(range(1, 11))
        assert np.allclose(g.score, d[g.vec_id], rtol=1e-12) and g.score.is_monotonic_increasing
    assert hit >= 0.9 * 300
    few = nearest(df.where("vec_id < 4 or vec_id >= 5000"), df.where("vec_id in (0, 5000)"), k=10).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2), (0, 3)]
    assert nearest(df.where("false"), df.where("false")).count() == 0
