"""Whole queries and the pipeline against plain Python that shares no code with the operators but the tables of the tests."""

import itertools
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from skeinflow.llm.language_id import BUCKETS, LEAD, SLOPE, SMOOTH, codewords
from skeinflow.llm.queries import op2_language_id, op5_quality, op9_tool_links, tokenizer_file
from skeinflow.llm.secrets import find

WHITE = bytes([32, *range(9, 14)])


def features(text):
    data = (text or "").encode()
    white, later = sum(data.count(c) for c in WHITE), sum(0x80 <= c < 0xC0 for c in data)
    upper = sum(65 <= c < 91 for c in data)
    letters = upper + sum(97 <= c < 123 or c >= 0xC0 for c in data)
    digits, stops = sum(48 <= c < 58 for c in data), sum(chr(c) in ".,;:'\"()?-" for c in data if c < 128)
    symbols = sum(chr(c) in "#$%&*+/<=>@[\\]^_`{}~" for c in data if c < 128)
    visible = len(data) - white - later
    words = re.findall(rb"[^ \t-\r]+", data)
    pairs, lines = list(zip(words, words[1:])), [x for x in data.split(b"\n") if x]

    def odds(part, whole, share, weight=20.0):
        return math.log((part + weight * share) / (whole - part + weight * (1 - share)))

    return [
        math.log1p(len(words)), math.log((visible + 100) / (len(words) + 20)), odds(letters, visible - digits, 0.95), odds(upper, letters, 0.03), odds(stops, visible, 0.03),
        odds(symbols, visible, 0.005), odds(data.count(b"|"), visible, 0.002), odds(data.count(b"!"), visible, 0.002), math.log((len(lines) + 1) / (len(words) + 10)),
        odds(len(pairs) - len(set(pairs)), len(pairs), 0.03), odds(len(lines) - len(set(lines)), len(lines), 0.03, 5.0), odds(sum(a == b for a, b in pairs), len(pairs), 0.01),
    ]


def quality_scores(texts, marked):
    """Scores of all texts; ``marked``: (text, label) of every row that is learnt from."""
    groups = [np.array([features(t) for t, y in marked if y == k]) for k in (0, 1)]
    n = sum(map(len, groups))
    spreads = [np.cov(g.T, bias=True) for g in groups]
    pool = sum(len(g) * c for g, c in zip(groups, spreads)) / n
    x, logs = np.array([features(t) for t in texts]), []
    for g, own in zip(groups, spreads):
        cov = 0.7 * (own if len(g) > len(pool) else pool) + 0.3 * pool  # few rows fix no covariance
        cov = 0.95 * cov + 0.05 * np.diag(np.diag(cov)) + 1e-6 * np.eye(len(cov))
        d = x - g.mean(0)
        logs.append(math.log((len(g) + 1) / (n + 2)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def buckets(text):
    """Counts of the hashed n-grams of one to three bytes within words, a word's closing space included in pairs."""
    low = bytes(c if 97 <= c < 123 or c >= 128 else 32 for c in (text or "").lower().encode())
    joined = b" ".join(low.split()) + (b" " if low.rstrip(b" ") != low and low.strip(b" ") else b"")
    out, mix = Counter(), (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
    for n in (1, 2, 3):
        for i in range(len(joined) - n + 1):
            g = joined[i : i + n]
            if n == 1 and g == b" " or n == 3 and g[1] == 32:
                continue
            code = g[0] * mix[0] % 2**32
            for k in range(1, n):
                code = (code * 31 + g[k] * mix[k]) % 2**32
            code ^= code >> 15
            out[(code + n) * 0x2C1B3C6D % 2**32 >> 18] += 1
    return out


def languages_of(texts, marked):
    """(language, score, ambiguous) of every text, learnt from (text, language) rows."""
    counts = defaultdict(Counter)
    for text, lang in marked:
        counts[lang].update(buckets(text))
    names = sorted(counts)
    code = codewords(len(names))
    share = np.array([[(counts[x][b] + SMOOTH) for b in range(BUCKETS)] for x in names])
    share /= share.sum(1, keepdims=True)
    weights, trust = [], []
    for bit in range(code.shape[1]):
        one, zero = ([i for i in range(len(names)) if (code[i, bit] > 0) == side] for side in (True, False))
        w = np.log(share[one].mean(0) / share[zero].mean(0))
        means = [float(share[i] @ w) for i in range(len(names))]
        weights.append(w)
        trust.append(max(0.05, min(min(means[i] for i in one), -max(means[i] for i in zero))))
    trust = [t / sum(trust) for t in trust]
    out = []
    for text in texts:
        if not re.search(r"[^\W\d_]", text or ""):
            out.append(("und", 0.0, True))
            continue
        seen = buckets(text)
        size = sum(seen.values())
        soft = [SLOPE * sum(n * w[b] for b, n in seen.items()) / (size + 10) for w in weights]
        loss = [sum(t * math.log1p(math.exp(-s * c)) for t, s, c in zip(trust, soft, row)) for row in code]
        belief = [math.exp(-x * code.shape[1]) for x in loss]
        ranked = sorted(((-b / sum(belief), i) for i, b in enumerate(belief)))
        out.append((names[ranked[0][1]], -ranked[0][0], ranked[1][0] - ranked[0][0] < LEAD))
    return out


def groups_of(texts, k, percent):
    """The smallest place of each text's component."""
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [top(i) for i in range(len(sets))]


def test_language_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in docs}
    want = languages_of([r.text for r in docs], [(r.text, r.lang) for r in docs if r.lang and r.text is not None and not held[r.doc_id]])
    got = {r.doc_id: r for r in op2_language_id(spark, sf).collect()}
    assert len(got) == len(docs)
    for r, (lang, score, unsure) in zip(docs, want):
        g = got[r.doc_id]
        assert (g.held_out, g.lang_pred, g.ambiguous) == (held[r.doc_id], lang, unsure) and abs(g.score - score) < 1e-3, r.doc_id


def test_quality_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs}
    labels = [(docs[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if not held[r.doc_id] and r.quality is not None]
    want = dict(zip(docs, quality_scores(list(docs.values()), labels)))
    got = op5_quality(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == held[r.doc_id] and abs(r.score - want[r.doc_id]) < 1e-6 and r.predicted == (r.score >= 0.7)


def test_links_query(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    calls = {(r.conv_id, r.turn): r for r in turns if r.role != "assistant"}
    answers = {(r.conv_id, r.turn): r for r in turns if r.role == "assistant"}
    assert len(calls) + len(answers) == len(turns)

    def level(key):
        return 1 + level((key[0], key[1] - 1)) if calls[key].role == "user" and (key[0], key[1] - 1) in calls else 0

    want = []
    for (conv, turn), r in calls.items():
        problem = "unknown tool" if r.role not in ("user", "system") else "type of text" if r.text is None else None
        status = problem or ("ok" if (conv, turn + 1) in answers else "no result")
        body = {"arguments": {"chars": len(r.text or ""), "text": r.text}, "id": f"call-{turn}", "name": r.role, "type": "call"}
        want.append((conv, turn, level((conv, turn)), f"call-{turn}", 0, status, json.dumps(body, sort_keys=True)))
    for (conv, turn), r in answers.items():
        key = (conv, turn - 1)
        place = (turn - 1, level(key), "ok") if key in calls else (None, None, "no call")
        want.append((conv, place[0], place[1], f"call-{turn - 1}", 1, place[2], json.dumps({"content": r.text, "id": f"call-{turn - 1}", "type": "result"}, sort_keys=True)))
    got = [(r.conv_id, r.turn, r.level, r.call_id, r.part, r.status, json.dumps(json.loads(r.json), sort_keys=True)) for r in op9_tool_links(spark, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.fixture(scope="module")
def corpus(spark, sf, tmp_path_factory):
    """The small documents with copies, secrets, nulls, empty and repeated rows, and their labels."""
    where = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = sorted((r for r in docs.collect() if r.text and 300 < len(r.text.split()) < 2000 and r.lang), key=lambda r: r.doc_id)[:12]
    odd = [r.asDict() for r in good]
    for i, r in enumerate(odd):
        r["doc_id"] = 90_000 + i
        words = r["text"].split(" ")
        if i % 4 == 2:  # no copy of the first, so it stays and is redacted
            words = words[::-1]
        r["text"] = " ".join(words + [[], [f"one{i}"], [f"password=xK9mQ2vLp7wTz4Rb{i}"], words[:1]][i % 4])
    blank = dict(odd[0], doc_id=91_000, text=None, lang=None), dict(odd[0], doc_id=91_001, text=""), dict(odd[1], doc_id=None)
    extra = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in [*odd, *blank, odd[3]]], docs.schema)
    docs.union(extra).write.parquet(f"{where}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{where}/labels.parquet")
    return where


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_pipeline(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{corpus}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "secrets", "packing"]
    at = {c: i for i, c in enumerate(docs.columns)}
    for name, stage in corpus_pipeline.STAGES[:4]:
        rows, before = docs.collect(), rows_of(docs)
        texts = [r.text for r in rows]
        out = stage(spark, docs, corpus)
        out.write.parquet(f"{corpus}/after-{name}.parquet")
        docs = spark.read.parquet(f"{corpus}/after-{name}.parquet")
        assert docs.columns == list(at)
        if name == "quality":
            scores = quality_scores(texts, [(r.text, marks[r.doc_id]) for r in rows if marks.get(r.doc_id) is not None])
            want = [tuple(r) for r, s in zip(rows, scores) if s >= 0.7]
        elif name == "language":
            found = languages_of(texts, [(r.text, r.lang) for r in rows if r.lang and r.text is not None])
            want = [tuple(r[:at["lang"]]) + (r.lang or lang,) + tuple(r[at["lang"] + 1 :]) for r, (lang, _, unsure) in zip(rows, found) if not unsure]
        elif name == "near_duplicates":
            known = sorted((r for r in rows if r.doc_id is not None), key=lambda r: (r.doc_id, r.text))
            parts = groups_of([r.text for r in known], 5, 80)
            want = [tuple(r) for i, r in enumerate(known) if parts[i] == i] + [tuple(r) for r in rows if r.doc_id is None]
            assert len(want) < len(rows)
        else:
            want = []
            for r in rows:
                kept, end = "", 0
                for _, a, b, *_ in sorted(find(r.text or ""), key=lambda s: s[1]):
                    if a >= end:
                        kept += r.text[end:a] + "[SECRET]"
                    end = max(end, b)
                kept = kept + r.text[end:] if end else r.text
                want.append(tuple(dict(r.asDict(), text=kept, n_chars=len(kept) if end else r.n_chars)[c] for c in at))
            assert want != [tuple(r) for r in rows]
        assert rows_of(docs) == sorted(want, key=str) and len(want) > 50, name
        assert name == "secrets" or len(want) < len(before) or name == "language"
    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, corpus).toPandas()
    got = Counter()
    for doc, rows in pieces.fillna({"doc_id": -1}).groupby("doc_id"):
        ids = np.concatenate([np.frombuffer(b, "<u4") for b in rows.sort_values("start").ids])
        got[int(doc), tuple(ids)] += 1
    assert got == Counter((-1 if r.doc_id is None else r.doc_id, (*tok.encode(r.text, add_special_tokens=False).ids, 1)) for r in docs.collect())


def test_pipeline_runs_all_stages(spark, corpus):
    done = corpus_pipeline.run(spark, corpus)
    assert done.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(done.columns)
