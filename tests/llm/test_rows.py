"""Row operators: secrets, quality, language, packing, archives."""

import base64
import gzip
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skeinflow.llm import arc_convert as arc
from skeinflow.llm import language_id, secrets
from skeinflow.llm import quality as quality_module
from skeinflow.llm.language_id import codewords, fit, identify
from skeinflow.llm.packing import pack
from skeinflow.llm.quality import FEATURES, Discriminant, forward, quality, statistics
from skeinflow.llm.queries import op3_secret_scan, queries, tokenizer_file
from skeinflow.llm.secrets import find, find_secrets, guess_bits, redact, suspects


def brute_base(text):
    rx = {
        "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        "access": re.compile(r"AKIA[A-Z0-9]+"),
        "hex": re.compile(r"[0-9a-f]+"),
    }
    out = []
    for rank, (kind, r) in enumerate(rx.items()):
        for m in r.finditer(text or ""):
            if {"assign": lambda: len(m[2]) >= 8, "access": lambda: len(m[0]) >= 16, "hex": lambda: len(m[0]) >= 32}[kind]():
                out.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_secrets_match_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op3_secret_scan(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        want = brute_base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("guess")] == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))


def test_secret_edges(spark):
    long = "é" * 70_000 + " Api_Key='" + "Zz9" * 30_000 + "' end " + "0f" * 40_000
    rows = [(1, None), (2, ""), (3, long), (4, "é pwd: hunter2 ſecret=abcdefgh12"), (5, "AKIA" + "A" * 11), (None, "x https://me:9f#Kd82!kQz@host/ y"), (6, "PASSWORD=short"), (6, "token: xK9mQ2vLp7wTz4Rb")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, spans int, id string")
    got = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in find_secrets(df).collect()), key=str)
    want = sorted(((i, [(k, a, b) for k, a, b, _ in find(t or "")]) for i, t in rows), key=str)
    assert got == want and len(got) == len(rows)
    by = dict(want)
    assert by[1] == by[2] == by[5] == [] and by[4] == [] and [k for k, *_ in by[3]] == ["assign", "hex"]  # one long repeat is easily guessed
    assert by[None] == [("guess", 13, 24)]
    clean = {r.doc_id: r.text for r in redact(df, count_col="spans").where("doc_id < 6").collect()}
    assert clean[1] is None and clean[5] == rows[4][1] and "Zz9" not in clean[3] and clean[3].count("[SECRET]") == 2
    assert find_secrets(df.where("false")).count() == 0


def test_guess_cost():
    assert guess_bits("password") < guess_bits("Password1") < guess_bits("xK9#mQ2v")
    assert guess_bits("qwertyuiop") < 25 and guess_bits("aaaaaaaaaaaaaaaa") < 15 and guess_bits("2024-01-05") < 20 and guess_bits("") == 0
    assert guess_bits("p4ssw0rd") < 15 and guess_bits("abcabcabcabc") < guess_bits("abcxqzmwjkpt")


def brute_bits(value):
    """Least cost over all cuts, each segment judged alone."""
    low, each = value.lower(), secrets._alphabet(value)
    plain = low.translate(secrets._PLAIN)
    best = [0.0]
    for i in range(1, len(value) + 1):
        costs = []
        for a in range(i):
            t, k, own = low[a:i], i - a, [(i - a) * each]
            if t in secrets._RANK or plain[a:i] in secrets._RANK:
                changed = sum(x != y for x, y in zip(t, plain[a:i]))
                caps = sum(c.isupper() for c in value[a:i])
                upper = 0 if not caps else 1 if caps == k or value[a].isupper() and caps == 1 else k
                own.append(secrets._RANK[plain[a:i] if t not in secrets._RANK else t] + (1 + changed if t not in secrets._RANK else 0) + upper)
            if secrets._DATE.fullmatch(value[a:i]):
                own.append(7 if k <= 4 else 16)
            own += [u * each + np.log2(k // u) for u, least in ((1, 3), (2, 2), (3, 2), (4, 2)) if k % u == 0 and k // u >= least and t == t[:u] * (k // u)]
            steps = [(secrets._AT[y][0] - secrets._AT[x][0], secrets._AT[y][1] - secrets._AT[x][1]) for x, y in zip(t, t[1:]) if secrets._near(x, y)]
            if k >= 3 and len(steps) == k - 1:
                own.append(5 + np.log2(k) + 2.2 * (1 + sum(x != y for x, y in zip(steps, steps[1:]))))
            costs.append(best[a] + secrets.CUT + min(own))
        best.append(min(costs))
    return best[-1]


def test_guess_cost_is_the_least():
    rng = np.random.default_rng(4)
    parts = ["pass", "ab", "aaaa", "abcabcabcabc", "s", "ssss", "qwerty", "tyuiop", "2024-01-05", "20102012", "1999", "P@ss", "xK9", "0", "dada", "d"]
    values = ["".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(150)] + ["".join(rng.choice(list("asd1"), 60)) for _ in range(60)]
    values += ["password" + "ds" * 150, "passssssssss", "ab" * 200, "abc" * 70 + "x" * 90, "aqwertyuiop" + "abcd" * 70]
    values += ["kQ9z" + "abc" * 100, "abcd" * 100, "xy" * 250, "ab" * 40 + "abc" * 40 + "a" * 50]
    for value in values:
        assert abs(guess_bits(value) - brute_bits(value)) < 1e-6, value
    assert guess_bits("abcd" * 200) < 40 and guess_bits("xy" * 500) < 40  # one repeat, whatever its length


def test_screen_keeps_every_suspect():
    rng = np.random.default_rng(0)
    for _ in range(200):
        texts = ["".join(rng.choice(list("0a z"), rng.integers(0, 60), p=[0.5, 0.46, 0.02, 0.02])) for _ in range(9)]
        want = {i for i, t in enumerate(texts) if find(t)}
        assert want <= set(suspects(pa.array(texts)).tolist())


def test_screen_keeps_each_alternative(spark):
    value = "dXNlcjpodW50ZXIyOmFi"
    assign = [f"{name}={value}" for name in ("password", "passwd", "secret", "token", "apikey", "api_key")]
    names = ["pass", "password", "passphrase", "passcode", "pwd", "secret", "token", "credential", "credentials"]
    names += [f"{a}{b}key" for a in ("api", "access", "private", "auth") for b in ("", "_", "-")]
    context = [f"{name}: {value}" for name in names] + [f"authorization: {a} {value}" for a in ("basic", "bearer")] + [f"bearer {value}", f"x://me:{value}@h"]
    texts = [*assign, *context, "AKIA" + "B2" * 8, "0f" * 16]
    for i, text in enumerate([*texts, *map(str.title, context), *map(str.upper, context)]):
        assert find(text), text
        assert suspects(pa.array([text])).tolist() == [0], (i, text)
    header = f"GET / Authorization: Basic {value} end"
    df = spark.createDataFrame([(1, header, len(header))], "doc_id long, text string, n_chars int")
    row = redact(df).first()
    assert (row.text, row.n_chars) == ("GET / Authorization: Basic [SECRET] end", 39)
    assert [s.kind for s in find_secrets(df).first().spans] == ["guess"]


def test_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality(docs, labels, fold="crc32(cast(doc_id as string)) % 4 = 2").collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and len(got) == docs.count()
    assert np.mean([got[i].predicted == marks[i] for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_statistics_do_not_depend_on_neighbours():
    texts = pa.array(["a b\nc d\na b", "", "x y z", None, "one line", "\n\nlast\n", "p q\np q\np q", "é | !"])
    whole = statistics(texts)
    alone = np.concatenate([statistics(texts[i : i + 1]) for i in range(len(texts))])
    assert np.allclose(whole, alone, rtol=1e-12)
    column = FEATURES.index("line_repeats")
    assert whole[6, column] > whole[0, column] > whole[2, column]


def test_forward_substitution():
    factor = np.linalg.cholesky(np.cov(np.random.default_rng(1).normal(size=(5, 40))))
    b = np.random.default_rng(2).normal(size=(5, 7))
    assert np.allclose(factor @ forward(factor, b), b)


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (3, "word " * 50_000), (None, "a b c"), (4, "x"), (4, "| | |")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (4, 1), (4, 0), (None, 1), (3, 0)], "doc_id long, quality int")
    got = quality(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and {r.score for r in got if r.doc_id in (1, 2)} .__len__() == 1
    assert {round(r.score, 6) for r in quality(docs, labels.where("false")).collect()} == {0.5}
    assert quality(docs.where("false"), labels).count() == 0


def test_discriminant_matches_definition():
    rng = np.random.default_rng(2)
    x = [rng.normal(size=(200, 3)), rng.normal(size=(300, 3)) * 2 + 1]
    m = Discriminant.fit(np.array([200.0, 300.0]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]), 0.0, 0.0)
    q = rng.normal(size=(20, 3))
    logs = []
    for a in x:
        c = np.cov(a.T, bias=True) + 1e-6 * np.eye(3)
        d = q - a.mean(0)
        logs.append(np.log((len(a) + 1) / 502) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(m.score(q), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    got = {r.doc_id: r for r in queries()["op2_language_id"](spark, f"{sf}/../sf0.01").collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0 and lang[i]]
    assert all(got[i].held_out for i in held) and np.mean([got[i].lang_pred == lang[i] for i in held]) >= 0.98
    model = fit(docs)
    odd = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "12 %% 3", "q"), (None, "the and of", "q"), (5, "the of and " * 60_000, "q")], "doc_id long, text string, lang_pred string")
    out = {r.doc_id: (r.lang_pred, r.score, r.ambiguous) for r in identify(odd, model).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0, True) and out[5][0] == "en" and not out[5][2] and out[None][0] == "en"
    assert identify(odd.where("false"), model).count() == 0
    assert {r.lang_pred for r in identify(odd, fit(docs.where("false"))).collect()} == {"und"}


@pytest.mark.parametrize("n", [2, 3, 4, 7, 12])
def test_codewords_lie_apart(n):
    code = codewords(n)
    least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert least >= 2 and all(abs(c.sum()) < n for c in code.T)


def test_packing(spark, sf):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(9001, None, "s"), (9002, "", "s"), (9003, "  x\x1c y  \n\n z\t" * 3000, "s"), (9004, "don't  stop!! <|endoftext|> 12345", "s")], docs.schema)
    both = docs.union(odd).repartition(7)
    pieces = pack(both, path).toPandas()
    assert not pieces.duplicated(["sequence_id", "offset"]).any()
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    filled = pieces.groupby("sequence_id").length.sum()
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in filled)
    assert padded / pieces.length.sum() < 0.01
    texts = {r.doc_id: r.text for r in both.collect()}
    for doc, g in pieces.sort_values("start").groupby("doc_id"):
        want = np.array([*tok.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        got = np.frombuffer(b"".join(g.ids), "<u4")
        assert np.array_equal(want, got) and g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and set(g.doc_tokens) == {len(want)}
        assert [zlib.crc32(b) for b in g.ids] == g.ids_crc32.tolist()
    assert set(pieces.doc_id) == set(texts)
    assert pack(both.where("false"), path).count() == 0


PAGES = [
    (1, "http://a/x y", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "", ""), (5, "http://b", "x\r\n\r\nWARC/1.1\r\n\r\n"), (6, "http://c", "z" * 300_000),
    (6, "http://c", "z" * 300_000), (None, "http://n", "<p>é</p>"), (7, "http://c2", "z" * 300_000),
]


@pytest.mark.parametrize("version", [1, 2])
def test_pages_round_trip(spark, version):
    df = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, refers_to int").repartition(3)
    got = sorted(arc.pages_round_trip(df, version=version).collect(), key=str)
    rows = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        same = [j for j, _, h in PAGES if (h or "") == (html or "") and j is not None]
        first = i is None or i == max(same)
        rows.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else max(same), True))
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)
    assert arc.pages_round_trip(df.where("false")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_pages_with_version_block_urls_stay(spark, version):
    pages = [(1, "filedesc://x.arc", "a"), (2, "filedesc:y z", "2 0 x"), (3, "http://c", "a"), (4, "filedesc://x.arc", None)]
    got = arc.pages_round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), version=version).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.intact) for r in got) == [
        (1, 1, "revisit", 3, True), (2, 5, "response", None, True), (3, 1, "response", None, True), (4, 0, "response", None, True)
    ]


def test_arc_versions():
    about1 = b"1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n"
    about2 = b"2 0 Org\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    http = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody"
    one = b"filedesc://f.arc 0.0.0.0 19960923142103 text/plain %d\n%s\nhttp://x/a b 1.2.3.4 199609231421 text/html %d\n%s\ndns:x 1.2.3.4 19960923142103 text/dns 3\nabc\n" % (len(about1), about1, len(http), http)
    two = b"filedesc://f.arc 0.0.0.0 19960923142103 text/plain 200 - - 0 f.arc %d\n%s\nhttp://x/ 1.2.3.4 19960923142103 text/html 200 c - 99 f.arc %d\n%s\nrubbish\nhttp://y/ 1.2.3.4 19960923142103 text/html 200 c - 99 f.arc 99\nshort" % (len(about2), about2, len(http), http)
    for data in (one, gzip.compress(one)):
        rows = [arc.as_warc(*r) for r in arc.parse_arc(data)]
        assert [(r[1], r[2], r[4], r[7]) for r in rows] == [
            ("warcinfo", "filedesc://f.arc", "1996-09-23T14:21:03Z", len(about1)), ("response", "http://x/a b", "1996-09-23T14:21:00Z", 4), ("resource", "dns:x", "1996-09-23T14:21:03Z", 3)
        ]
    rows = [arc.as_warc(*r) for r in arc.parse_arc(two)]
    assert [(r[1], r[7], r[-1]) for r in rows] == [("warcinfo", len(about2), False), ("response", 4, False), ("resource", 5, True)]
    assert list(arc.parse_arc(b"")) == []


def _odd_texts(count: int) -> list[str | None]:
    rng = random.Random(1)
    parts = ["ab ", "word ", "Été ", "x", "|", "!", "\n", "\n\n", "a line again\n", "  ", "12", " "]
    return ["".join(rng.choices(parts, k=rng.randrange(300))) for _ in range(count)] + [None, "", "a", " ", "\n", "a" * 50, " a", " " * 50, "a\n" * 40]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_long_texts_in_blocks_equal_whole_texts(monkeypatch, block):
    column = pa.array(_odd_texts(40))

    def bag():
        return Counter(x for bucket, owner in language_id.grams(column) for x in zip(bucket.tolist(), owner.tolist(), strict=True))

    whole, counts = statistics(column), bag()
    for module in (quality_module, language_id):
        monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(quality_module, "_powers", {})
    assert np.array_equal(statistics(column), whole) and bag() == counts


def test_memory_of_one_very_long_text():
    column = pa.array(["Some words of a text, which is long. And a line\n" * 300_000, "b"])  # 14 MB
    model = language_id.Model.fit(["a", "b"], np.ones((2, language_id.BUCKETS)))
    statistics(column), model.predict(column)
    tracemalloc.start()
    statistics(column), model.predict(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20


def test_tokenizer_keeps_common_chunks(monkeypatch):
    """What comes again is not learnt again when the memory is full."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from skeinflow.llm import packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(packing, "REMEMBER", 2)
    made, learnt = packing.ChunkTokenizer(path), []
    one = made._one
    monkeypatch.setattr(made, "_one", lambda chunk: learnt.append(chunk) or one(chunk))
    texts = [f"the word, the x{c}\nthe 12 é" for c in "abcdef"]
    got = [made.encode([t])[0].tolist() for t in texts]
    assert got == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert learnt.count(" the") == 1 and len(made.ids) + len(made.older) < 20


def test_tokenizer_learns_words_without_their_marks():
    """A word is learnt once, whatever follows it."""
    import public_tokenizers

    from skeinflow.llm import packing

    made = packing.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    words = [f"w{a}{b}é" for a in "abcdefghij" for b in "abcdefghij"]
    texts = ["".join(f" {w}{mark}" for w in words) for mark in [",", ".", "***", ",###", "'s", "|x", "7%"]]
    want = [x.ids for x in made.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in made.encode(texts)] == want
    assert len(made.ids) < len(words) + 20


@pytest.mark.parametrize("block", [1, 7, 1 << 22])
def test_tokenizer_cuts_where_the_library_does(monkeypatch, block):
    """Odd texts have the library's ids, also where a block ends within them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from skeinflow.llm import packing

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(6)
    monkeypatch.setattr(packing, "BLOCK", block, raising=False)
    made, plain = packing.ChunkTokenizer(path), Tokenizer.from_file(path)
    parts = [*"ab'. \n,(-|5éßĀ×÷ª…日\t\r\x1c\x85\x00😀", "\xa0", "́", "<|endoftext|>", " the", "'ll", "don't", "  ", "\n\n"]
    texts = ["".join(rng.choices(rng.sample(parts, 8), k=rng.choice([0, 1, 3, 9, 40]))) for _ in range(600)]
    got = made.encode(texts)
    assert [x.tolist() for x in got] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
