"""Queries over the synthetic corpus tables, one per operator."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.arc_convert import pages_round_trip
from skeinflow.llm.ball_tree import hard_negatives
from skeinflow.llm.language_id import fit, identify
from skeinflow.llm.lattice_dedup import near_duplicates
from skeinflow.llm.kd_search import nearest
from skeinflow.llm.packing import pack
from skeinflow.llm.periodic_runs import find_runs
from skeinflow.llm.piece_transducer import round_trip
from skeinflow.llm.quality import quality
from skeinflow.llm.secrets import find_secrets
from skeinflow.llm.tool_links import link, quoted
from skeinflow.llm.vertical_join import jaccard_components
from skeinflow.llm.voronoi_join import top_products


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)")
    model = fit(docs.where(~held_out))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] != "guess")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("guess"),
    )


def op4_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where("vec_id % 100 = 0"), k=10)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality(docs, labels, fold="crc32(cast(doc_id as string)) % 4 = 2")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer_file("byte_bpe_50k.json"), keep_ids=False)


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, tokenizer_file("piece_bpe_32k.model"))


def op9_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn that is no assistant's is a call of a tool named after its role, answered by the assistant turn that follows it.

    Turns whose number is repeated in a conversation stay as rows of status ``repeated id``.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked = F.coalesce(F.col("role"), F.lit("none")) != "assistant"
    call = F.concat(F.lit("call-"), F.col("turn").cast("string"))
    calls = turns.where(asked).select(
        "conv_id", "turn", call.alias("call_id"), F.col("role").alias("tool"),
        F.create_map(F.lit("text"), quoted("text"), F.lit("chars"), F.coalesce(F.length("text"), F.lit(0)).cast("string")).alias("arguments"),
        F.when(F.col("role") == "user", F.array(F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string")))).alias("after"),
    )
    results = turns.where(~asked).select("conv_id", F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))
    form = '{"additionalProperties":false,"properties":{"chars":{"minimum":0,"type":"integer"},"text":{"type":"string"}},"required":["chars","text"],"type":"object"}'
    schemas = spark.createDataFrame(
        [(tool, ["text"], {"text": "string", "chars": "integer"}, form) for tool in ("user", "system")],
        "tool string, required array<string>, types map<string,string>, schema string",
    )
    return link(calls, results, schemas, repeats=True)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, k=3, percent=90)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_products(rows, rows.where("vec_id % 20 = 0"), k=20)


def echo(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the documents: from some word on, the words that follow it again and again."""
    if doc_id is None or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), echo=echo)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # the greatest length, then the smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    one = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return one.select(
        "doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"),
        F.expr("1000 * b.length div -b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def queries() -> dict:
    return {
        "op1_lattice_dedup": op1_lattice_dedup,
        "op2_language_id": op2_language_id,
        "op3_secret_scan": op3_secret_scan,
        "op4_kd_search": op4_kd_search,
        "op5_quality": op5_quality,
        "op6_packing": op6_packing,
        "op7_arc_to_warc": op7_arc_to_warc,
        "op8_piece_transducer": op8_piece_transducer,
        "op9_tool_links": op9_tool_links,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_voronoi_join": op12_voronoi_join,
        "op13_periodic_runs": op13_periodic_runs,
    }


#: SQL: ids and whole-number vectors.
_WHOLE = """w AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor({} * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


def oracle_sql() -> dict[str, str]:
    value = " + ".join(f"{1 << (4 - j)} * substr(b, 5 * i + {j + 1}, 1)::INT" for j in range(5))
    return {
        "op7_arc_to_warc": f"""
            WITH p AS (SELECT page_id, encode(coalesce(html, '')) body FROM pages),
            q AS (SELECT page_id, octet_length(body) payload_bytes, unhex(sha1(body))::BIT::VARCHAR b FROM p),
            d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {value}, 1)), '') payload_digest FROM q),
            m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) latest FROM d)
            SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END record_type,
                   CASE WHEN page_id < latest THEN latest END refers_to, TRUE intact FROM m""",
        "op11_hard_negatives": f"""
            WITH {_WHOLE.format(256)}, r AS (SELECT w.id, w.v, CASE WHEN w.id % 7 = 0 THEN (e.label + 1) % 10 ELSE e.label END AS lab FROM w JOIN embeddings e ON e.vec_id = w.id WHERE e.label IS NOT NULL),
            d AS (SELECT a.id AS aid, a.lab = b.lab AS same, b.id AS bid, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0),
            p AS (SELECT aid, bid AS pid, s AS ps FROM d WHERE same QUALIFY row_number() OVER (PARTITION BY aid ORDER BY s DESC, bid) <= 5),
            n AS (SELECT p.aid, pid, row_number() OVER (PARTITION BY p.aid, pid ORDER BY s DESC, bid) AS k, bid, ps, s FROM p JOIN d ON d.aid = p.aid AND NOT same AND 30 * ps <= 100 * s AND 100 * s <= 90 * ps)
            SELECT aid AS anchor_id, pid AS positive_id, CAST(k AS INTEGER) AS rank, bid AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE k <= 10""",
        "op12_voronoi_join": f"""
            WITH {_WHOLE.format(64)}, d AS (SELECT q.id AS qid, s.id AS sid, CAST(list_dot_product(q.v, s.v) AS BIGINT) AS s FROM w q JOIN w s ON q.id <> s.id WHERE q.id % 20 = 0),
            k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, sid) AS k FROM d)
            SELECT qid AS query_id, CAST(k AS INTEGER) AS rank, sid AS vec_id, s AS score FROM k WHERE k <= 20""",
    }
