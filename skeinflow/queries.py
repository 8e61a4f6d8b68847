"""Named queries over the star-schema tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinflow.operators import dfg as D
from skeinflow.operators import forest as N
from skeinflow.operators import traces as T
from skeinflow.operators.components import components, strong_components
from skeinflow.operators.relations import event_object_sets, patterns, relations_from
from skeinflow.plans.repair import suggest
from skeinflow.plans.session import Session, accepted_table, enumerate_trees, greedy_table, metrics, score_table
from skeinflow.plans.tree import Node, rules, table
from skeinflow.sources.ocel_split import read_large_log, write_documents
from skeinflow.sources.scratch import Scratch, keep
from skeinflow.sources.tables import clicks, clicks_by_key, order_trees, orders
from skeinflow.streaming.steps import read_counts, write_counts

LOGS = {"clicks": clicks, "keys": clicks_by_key, "orders": orders}

RELATIONS = {
    "clicks": "SELECT CAST(event_id AS VARCHAR) eid, event_type activity, ts, 'u' || user_id oid, 'user' otype FROM events",
    "keys": """SELECT CAST(event_id AS VARCHAR) eid, event_type activity, ts, 'u' || user_id oid, 'user' otype FROM events
        UNION ALL SELECT CAST(event_id AS VARCHAR), event_type, ts, 'k' || json_extract_string(props, '$.k'), 'key' FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""",
    "orders": """SELECT 'o' || o_orderkey eid, 'place order' activity, o_orderdate ts, 'o' || o_orderkey oid, 'order' otype FROM orders
        UNION ALL SELECT 'o' || o_orderkey, 'place order', o_orderdate, 'c' || o_custkey, 'customer' FROM orders
        UNION ALL SELECT 'l' || l.k, l.activity, l.ts, x.oid, x.otype FROM (
            SELECT l_orderkey ok, l_orderkey || '-' || l_linenumber k, min(l_suppkey) sk, min(l_shipdate) ts,
                   CASE WHEN min(l_returnflag) = 'R' THEN 'return item' WHEN min(l_linestatus) = 'F' THEN 'close item' ELSE 'ship item' END activity
            FROM lineitem GROUP BY l_orderkey, l_linenumber) l
        JOIN orders o ON o.o_orderkey = l.ok AND l.ts >= o.o_orderdate,
        LATERAL (SELECT 'o' || l.ok oid, 'order' otype UNION ALL SELECT 'i' || l.k, 'item' UNION ALL SELECT 's' || l.sk, 'supplier') x""",
}
PATTERNS = """once AS (SELECT DISTINCT eid, activity, oid, otype FROM rel),
    typed AS (SELECT eid, activity, otype, list_sort(list(oid)) part FROM once GROUP BY ALL),
    whole AS (SELECT eid, list_sort(list(oid)) whole FROM once GROUP BY eid),
    seen AS (SELECT activity, otype, part, count(*) n, count(DISTINCT whole) k FROM typed JOIN whole USING (eid) GROUP BY ALL),
    total AS (SELECT activity, count(DISTINCT eid) total FROM once GROUP BY activity),
    pat AS (SELECT activity, otype, TRUE related, max(k) > 1 divergent, max(len(part)) > 1 convergent, sum(n) <> any_value(total) deficient
            FROM seen JOIN total USING (activity) GROUP BY activity, otype)"""
STEPS = """dedup AS (SELECT oid, eid, min(ts) ts, arg_min(activity, (ts, activity)) activity, any_value(otype) otype FROM rel GROUP BY oid, eid),
    nxt AS (SELECT oid, otype, activity source, lead(activity) OVER (PARTITION BY oid ORDER BY ts, eid) target FROM dedup)"""
GRAPH = """steps AS (SELECT n.* FROM nxt n LEFT JOIN pat a ON a.activity = n.source AND a.otype = n.otype LEFT JOIN pat b ON b.activity = n.target AND b.otype = n.otype
             WHERE n.target IS NOT NULL AND NOT (coalesce(a.divergent, FALSE) AND coalesce(b.divergent, FALSE))),
    counted AS (SELECT source, target, count(*) cnt FROM steps GROUP BY ALL),
    dfg AS (SELECT source, target, cnt, CAST(ceil(CAST(cnt AS DOUBLE) / CAST(sum(cnt) OVER () AS DOUBLE) * CAST(100 AS DOUBLE)) AS BIGINT) weight FROM counted)"""
KEPT = """bad AS (SELECT oid FROM (SELECT DISTINCT oid, r.otype, r.activity FROM rel r JOIN pat p ON p.activity = r.activity AND p.otype = r.otype AND p.divergent) GROUP BY oid HAVING count(*) >= 2),
    kept AS (SELECT * FROM rel WHERE oid NOT IN (SELECT oid FROM bad))"""
OFFSETS = """offs AS (SELECT oid, activity, CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY oid)) / 1000000) AS BIGINT) secs FROM kept),
    hist AS (SELECT activity, secs, count(*) n FROM offs GROUP BY ALL),
    pres AS (SELECT activity, count(DISTINCT oid) objects, CAST(count(DISTINCT oid) AS DOUBLE) / (SELECT count(DISTINCT oid) FROM kept) share FROM kept GROUP BY activity)"""
MISSING = """names AS (SELECT source x FROM dfg UNION SELECT target FROM dfg),
    missing AS (SELECT a.x source, b.x target FROM names a, names b WHERE a.x <> b.x AND NOT EXISTS (SELECT 1 FROM dfg d WHERE d.source = a.x AND d.target = b.x))"""
CLOSURE = "r(source, target) AS (SELECT x, x FROM names UNION SELECT r.source, d.target FROM r JOIN dfg d ON r.target = d.source)"


def _with(log: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}rel AS ({RELATIONS[log]}), " + ", ".join(parts) + " "


def _parts(spark: SparkSession, sf_dir: str, log: str) -> tuple[DataFrame, DataFrame]:
    rel = keep(LOGS[log](spark, sf_dir), "relations")
    return rel, keep(patterns(rel), "patterns")


def _graph(spark: SparkSession, sf_dir: str, log: str) -> DataFrame:
    return keep(D.dfg(*_parts(spark, sf_dir, log)), "graph")


def _kept(spark: SparkSession, sf_dir: str, log: str) -> DataFrame:
    return T.kept_relations(*_parts(spark, sf_dir, log))


def _missing(spark: SparkSession, sf_dir: str, log: str, noise: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Missing edges of a log's graph, and the relations that cost is taken from."""
    rel, pat = _parts(spark, sf_dir, log)
    return D.missing_edges(D.reduce_noise(keep(D.dfg(rel, pat), "graph"), noise)), T.kept_relations(rel, pat)


def _raw_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces by key of the keys log, taken from links alone."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"), F.col("ts").alias("time"), F.get_json_object("props", "$.k").alias("k"))
    links = e.select(F.col("id").alias("event_id"), F.concat(F.lit("k"), "k").alias("object_id"))
    return T.raw_traces(e, links).select("oid", F.array_join("activities", ">").alias("trace"))


#: Given executions, loops and model activities for the queries of coverage and metrics.
CLICK_RUNS, CLICK_LOOPS = [["view"], ["view", "click"], ["click", "view", "purchase"], ["error"], ["nothing"]], ["view", "click"]
MODEL_NAMES = ["place order", "ship item", "pay order"]


#: Seconds between two events of a user from which on another session begins.
GAP = 43200


def _loop_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the traces of all sessions of users."""
    return T.loop_variants(T.traces(T.sessions(clicks(spark, sf_dir), GAP)), CLICK_LOOPS)


def _ocel(spark: SparkSession, sf_dir: str, log: str) -> DataFrame:
    """A log written as OCEL documents, read back in blocks, and its relations."""
    rel = keep(LOGS[log](spark, sf_dir), "relations")
    events = rel.groupBy(F.col("eid").alias("id")).agg(F.min("activity").alias("type"), F.min("ts").alias("time"))
    objects = rel.groupBy(F.col("oid").alias("id")).agg(F.min("otype").alias("type"))
    path = Scratch(spark, "ocel").path("log")
    write_documents(events, objects, rel.select(F.col("eid").alias("event_id"), F.col("oid").alias("object_id"), F.lit("").alias("qualifier")), path)
    found = read_large_log(spark, path)
    return relations_from(found["events"], found["objects"], found["e2o"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    found = components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")), Scratch(spark, "components"))
    names = edges.select(F.explode(F.array("source", "target")).alias("activity")).distinct()
    return names.join(found.withColumnRenamed("node", "activity"), "activity", "left").select("activity", F.coalesce("component", "activity").alias("component"))


def _strong(spark: SparkSession, edges: DataFrame) -> DataFrame:
    found = strong_components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")), Scratch(spark, "components"))
    return found.withColumnRenamed("node", "activity")


def _suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session.open(clicks(spark, sf_dir), noise=0.04)
    rows = [(x.cut_type, x.set1, x.set2, [f"{a}->{b}" for a, b, _ in x.added], [f"{a}->{b}" for a, b, _ in x.removed], x.total_cost) for x in s.suggestions()]
    return spark.createDataFrame(rows, "cut_type string, set1 array<string>, set2 array<string>, added array<string>, removed array<string>, total_cost long")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session.open(clicks(spark, sf_dir), noise=0.04)
    rows = [(i, str(t), "/".join(c), *v) for i, (t, c, v) in enumerate(enumerate_trees(s))]
    return spark.createDataFrame(rows, "rank long, tree string, chosen string, fitness double, precision double, f_score double")


def _tree(spark: SparkSession, sf_dir: str, log: str, loops: bool = False) -> DataFrame:
    s = Session.open(LOGS[log](spark, sf_dir))
    return table(spark, s.with_self_loops() if loops else s.tree)


def _score(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    s = Session.open(orders(spark, sf_dir))
    return spark.createDataFrame([getattr(s, kind)()], "fitness double, precision double, f_score double")


#: Given executions, of no tree in particular: a table that Spark and SQL both count against the orders log.
GIVEN_RUNS = [["place order", x] for x in ("close item", "return item", "ship item")]


#: A given tree for greedy replay and the rules: an order is placed, then items go their ways; nothing is returned and then shipped.
GIVEN_LOOP = Node("sequence", [Node("place order"), Node("loop", [Node("exclusive", [Node("ship item"), Node("close item"), Node("return item")])])])
GIVEN_TREE = Node("sequence", [Node("place order"), Node("exclusive", [Node("ship item"), Node("sequence", [Node("close item"), Node("return item")])])])


#: Given trees whose executions are few enough to be written down for SQL, one list of executions a tree.
GIVEN_TREES = [
    GIVEN_TREE, Node("sequence", [Node("place order"), Node("parallel", [Node("ship item"), Node("close item")])]),
    Node("sequence", [Node("exclusive", [Node("place order"), Node("tau")]), Node("redo", [Node("return item"), Node("ship item")])]),
]
GIVEN_LANGUAGES = [
    [["place order", "ship item"], ["place order", "close item", "return item"]], [["place order", "ship item", "close item"], ["place order", "close item", "ship item"]],
    [first + ["return item"] + ["ship item", "return item"] * n for first in (["place order"], []) for n in range(3)],
]


def _given_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session.open(orders(spark, sf_dir))
    return spark.createDataFrame([s.conformance(GIVEN_TREE)], "fitness double, precision double, f_score double")


def _replay_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_table(_kept(spark, sf_dir, "orders"), spark.createDataFrame([(r,) for r in GIVEN_RUNS], "run array<string>"))


#: What the flowers of some order trees become.
GIVEN_NEW = Node("sequence", [Node("ship item"), Node("redo", [Node("close item"), Node("tau")])])


#: A tree given for sessions of users, with activities in every context that self-loops are told apart by.
GIVEN_SESSION = Node("parallel", [
    Node("exclusive", [Node("error"), Node("signup")]), Node("sequence", [Node("view"), Node("exclusive", [Node("click"), Node("purchase")])]),
])


def _self_loops(spark: SparkSession, sf_dir: str, corrected: bool) -> DataFrame:
    s = Session.open(T.sessions(clicks(spark, sf_dir), GAP))
    s.tree = GIVEN_SESSION
    return table(spark, s.with_self_loops(corrected)).select("node_id", "label")


#: Stretches of time that a log arrives in.
PARTS = 4


def _streamed(spark: SparkSession, sf_dir: str, log: str) -> DataFrame:
    """Counts of steps of a log that arrives as files, stretch by stretch, in micro-batches."""
    rel = keep(LOGS[log](spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "relations")
    lo, hi = rel.agg(F.min("ts"), F.max("ts")).first()
    span = int((hi - lo).total_seconds() // PARTS) + 1 if lo is not None else 1
    part = F.coalesce(F.floor(F.timestamp_diff("SECOND", F.lit(lo).cast("timestamp_ntz"), "ts") / span), F.lit(0))
    path = Scratch(spark, "stream").path("log")
    for i in range(PARTS):
        rel.where(part == i).write.mode("append").parquet(f"{path}/in")
    arriving = spark.readStream.schema(rel.schema).option("maxFilesPerTrigger", 8).parquet(f"{path}/in")
    write_counts(arriving, path, span + 1).awaitTermination()
    return read_counts(spark, path)


def _tops(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_id = '0.1'")


def _collapsed(nodes: DataFrame) -> DataFrame:
    return N.collapse(nodes, _tops(nodes))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for log in LOGS:
        out |= {
            f"relations_{log}": lambda s, d, k=log: LOGS[k](s, d),
            f"patterns_{log}": lambda s, d, k=log: patterns(LOGS[k](s, d)),
            f"dfg_{log}": lambda s, d, k=log: _graph(s, d, k),
            f"dfg_by_type_{log}": lambda s, d, k=log: D.dfg_by_type(LOGS[k](s, d)),
            f"endpoints_{log}": lambda s, d, k=log: D.endpoints(LOGS[k](s, d)),
            f"traces_{log}": lambda s, d, k=log: T.traces(_kept(s, d, k)).select("oid", "otype", F.array_join("activities", ">").alias("trace")),
        }
    out |= {
        "event_object_sets": lambda s, d: event_object_sets(orders(s, d)).select("eid", "activity", F.array_join("objects", ",").alias("objects")),
        "endpoints_by_type_orders": lambda s, d: D.endpoints(orders(s, d), True),
        "dfg_noise_clicks": lambda s, d: D.reduce_noise(_graph(s, d, "clicks"), 0.04),
        "dfg_noise_orders": lambda s, d: D.reduce_noise(_graph(s, d, "orders"), 0.3),
        "dfg_filtered_clicks": lambda s, d: D.drop_activities(_graph(s, d, "clicks"), ["error"]),
        "dfg_induced_clicks": lambda s, d: D.induced(_graph(s, d, "clicks"), ["click", "view", "purchase"]),
        "trace_offsets_orders": lambda s, d: T.offsets(_kept(s, d, "orders")),
        "traces_collapsed_clicks": lambda s, d: T.traces(_kept(s, d, "clicks")).select("oid", F.array_join(T.collapse(F.col("activities")), ">").alias("trace")),
        "activity_presence_orders": lambda s, d: T.presence(_kept(s, d, "orders")),
        "missing_edges_orders": lambda s, d: D.missing_edges(_graph(s, d, "orders")),
        "add_cost_order_orders": lambda s, d: _rounded(T.order_cost(*_missing(s, d, "orders")), "cost"),
        "add_cost_curve_orders": lambda s, d: _rounded(T.curve_cost(*_missing(s, d, "orders")), "cost").select("source", "target", "cost"),
        "add_cost_logistic_orders": lambda s, d: _rounded(T.curve_cost(*_missing(s, d, "orders"), "logistic", None), "cost").select("source", "target", "cost"),
        "add_cost_curve_clicks": lambda s, d: _rounded(T.curve_cost(*_missing(s, d, "clicks", 0.04)), "cost").select("source", "target", "cost"),
        "add_cost_no_floor_orders": lambda s, d: _rounded(T.curve_cost(*_missing(s, d, "orders"), floor=None), "cost").select("source", "target", "cost"),
        "curve_series_orders": lambda s, d: _rounded(T.curve_series(*_missing(s, d, "orders")), "mass", "later").select("source", "target", "i", "mass", "later"),
        "relations_ocel_keys": lambda s, d: _ocel(s, d, "keys"),
        "relations_ocel_orders": lambda s, d: _ocel(s, d, "orders"),
        "raw_traces_keys": _raw_traces,
        "loop_variants_clicks": lambda s, d: _loop_variants(s, d).select(F.array_join("activities", ">").alias("trace")),
        "coverage_clicks": lambda s, d: T.log_coverage(T.sessions(clicks(s, d), GAP), s.createDataFrame([(r,) for r in CLICK_RUNS], "run array<string>"), CLICK_LOOPS),
        "log_metrics_orders": lambda s, d: T.log_metrics(orders(s, d), MODEL_NAMES),
        "bidirectional_pairs_clicks": lambda s, d: D.bidirectional(_graph(s, d, "clicks")),
        "reachability_orders": lambda s, d: D.reachability(_graph(s, d, "orders")),
        "components_orders": lambda s, d: _components(s, _graph(s, d, "orders")),
        "sccs_clicks": lambda s, d: _strong(s, _graph(s, d, "clicks")),
        "sccs_orders": lambda s, d: _strong(s, _graph(s, d, "orders")),
        "replay_counts_orders": _replay_counts,
        "replay_trees_orders": lambda s, d: accepted_table(keep(_kept(s, d, "orders"), "kept"), GIVEN_TREES),
        "conformance_given_orders": _given_conformance,
        "violations_sequence_orders": lambda s, d: T.violations(_kept(s, d, "orders"), ["place order"], ["return item"], "sequence"),
        "violations_exclusive_orders": lambda s, d: T.violations(_kept(s, d, "orders"), ["close item"], ["return item"], "exclusive"),
        "violations_tree_orders": lambda s, d: T.rule_violations(_kept(s, d, "orders"), rules(GIVEN_TREE)),
        "replay_greedy_orders": lambda s, d: greedy_table(T.traces(orders(s, d)), GIVEN_LOOP),
        "metrics_orders": lambda s, d: metrics(orders(s, d), GIVEN_LOOP),
        "descendants_orders": lambda s, d: N.descendants(order_trees(s, d), _tops(order_trees(s, d))).select("tree_id", "node_id", "depth"),
        "open_flower_orders": lambda s, d: N.open_flowers(order_trees(s, d)).select("tree_id", "node_id", F.array_join("activities", ",").alias("activities")),
        "collapse_orders": lambda s, d: _collapsed(keep(order_trees(s, d), "trees")),
        "replace_flowers_orders": lambda s, d: N.replace_flowers(order_trees(s, d), ["close item", "ship item"], table(s, GIVEN_NEW)),
        "dfg_by_type_stream_clicks": lambda s, d: _streamed(s, d, "clicks"),
        "dfg_by_type_stream_keys": lambda s, d: _streamed(s, d, "keys"),
        "self_loops_sessions": lambda s, d: _self_loops(s, d, False),
        "self_loops_corrected_sessions": lambda s, d: _self_loops(s, d, True),
        "tree_orders": lambda s, d: _tree(s, d, "orders"),
        "tree_clicks": lambda s, d: _tree(s, d, "clicks"),
        "tree_keys": lambda s, d: _tree(s, d, "keys"),
        "tree_clicks_loops": lambda s, d: _tree(s, d, "clicks", True),
        "suggestions_clicks": _suggestions,
        "candidate_trees_clicks": _candidates,
        "conformance_orders": lambda s, d: _score(s, d, "conformance"),
        "replay_orders": lambda s, d: _score(s, d, "replay"),
    }
    return out


#: SQL: the nodes of the order trees, and with all nodes above each.
ORDER_TREES = """WITH RECURSIVE line AS (SELECT l_orderkey k, l_linenumber n, min(l_suppkey) sk,
        CASE WHEN min(l_returnflag) = 'R' THEN 'return item' WHEN min(l_linestatus) = 'F' THEN 'close item' ELSE 'ship item' END a FROM lineitem GROUP BY ALL),
    sup AS (SELECT 'o' || k tree_id, '0.1.' || min(n) id, CAST(min(n) AS INTEGER) pos, list_sort(list(DISTINCT a)) names FROM line GROUP BY k, sk),
    nodes AS (SELECT DISTINCT 'o' || o_orderkey tree_id, '0' node_id, CAST(NULL AS VARCHAR) parent_id, 0 child_pos, 'sequence' label FROM orders
        UNION ALL SELECT DISTINCT 'o' || o_orderkey, '0.0', '0', 0, 'place order' FROM orders
        UNION ALL SELECT DISTINCT tree_id, '0.1', '0', 1, 'parallel' FROM sup
        UNION ALL SELECT tree_id, id, '0.1', pos, CASE WHEN len(names) > 1 THEN 'flower' ELSE names[1] END FROM sup
        UNION ALL SELECT tree_id, id || '.' || (i - 1), id, CAST(i - 1 AS INTEGER), names[i] FROM (SELECT *, unnest(range(1, len(names) + 1)) i FROM sup WHERE len(names) > 1)),
    down AS (SELECT *, [node_id] above, [child_pos] place FROM nodes WHERE parent_id IS NULL
        UNION ALL SELECT n.*, list_append(d.above, n.node_id), list_append(d.place, n.child_pos) FROM down d JOIN nodes n ON n.tree_id = d.tree_id AND n.parent_id = d.node_id),
    held AS (SELECT tree_id, parent_id node_id, list_sort(list(DISTINCT label)) names FROM down WHERE parent_id IS NOT NULL GROUP BY ALL) """


def _self_loops_sql(corrected: bool) -> str:
    """The given session tree with its self-loops: a session of a leaf's context without the activity makes the loop optional."""

    def has(*names: str) -> str:
        return f"list_has_any(acts, [{', '.join(repr(x) for x in names)}])"

    inner = (has("view"), "") if corrected else (has("click", "purchase"), "view")
    context = {
        "0.0.0": ("error", f"{has('view', 'click', 'purchase')} AND NOT {has('signup')}"), "0.0.1": ("signup", f"{has('view', 'click', 'purchase')} AND NOT {has('error')}"),
        "0.1.0": ("view", has("click", "purchase")),
        "0.1.1.0": ("click", f"{inner[0]} AND NOT {has('purchase', *inner[1].split())}"), "0.1.1.1": ("purchase", f"{inner[0]} AND NOT {has('click', *inner[1].split())}"),
    }
    leaves = " UNION ALL ".join(f"SELECT '{p}' p, '{a}' a, (SELECT count(*) FILTER ({c} AND NOT {has(a)}) FROM seq) n" for p, (a, c) in context.items())
    return f"""WITH step AS (SELECT user_id, event_type a, ts, CAST(event_id AS VARCHAR) eid, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) > INTERVAL {GAP} SECOND AS far FROM events),
        cut AS (SELECT *, count(*) FILTER (far) OVER (PARTITION BY user_id ORDER BY ts, eid ROWS UNBOUNDED PRECEDING) k FROM step),
        nxt AS (SELECT a, lead(a) OVER (PARTITION BY user_id, k ORDER BY ts, eid) b FROM cut), seq AS (SELECT list(DISTINCT a) acts FROM cut GROUP BY user_id, k),
        leaf AS ({leaves}), looped AS (SELECT *, a IN (SELECT a FROM nxt WHERE a = b) again FROM leaf)
        SELECT p node_id, CASE WHEN again THEN 'redo' ELSE a END AS label FROM looped
        UNION ALL SELECT p || '.0', CASE WHEN n > 0 THEN 'tau' ELSE a END FROM looped WHERE again UNION ALL SELECT p || '.1', CASE WHEN n > 0 THEN a ELSE 'tau' END FROM looped WHERE again
        UNION ALL SELECT * FROM (VALUES ('0', 'parallel'), ('0.0', 'exclusive'), ('0.1', 'sequence'), ('0.1.1', 'exclusive')) t(node_id, label)"""


def _curve_sql(log: str, graph: str, kernel: str, floor: bool, series: bool = False) -> str:
    """The curve costs by the plain formula: every bucket of every pair against the whole histogram; or the curves."""
    phi = "least(1, greatest(0, 0.5::DOUBLE * ((g.t - h.secs) / g.bw + 1)))" if kernel == "uniform" else "1 / (1 + exp(-1.702::DOUBLE * (g.t - h.secs) / g.bw))"
    wide = "4" if kernel == "uniform" else "1"
    last = f"""SELECT source, target, round({'greatest(1, ' * floor}CASE WHEN max(abs(score)) OVER () > 0 THEN (1 - score / max(abs(score)) OVER ()) * 100 ELSE score END{')' * floor}, 6) cost FROM every"""
    if series:
        last = "SELECT source, target, CAST(i AS INTEGER) i, round(coalesce(mass, 0), 6) mass, round(later, 6) later FROM later LEFT JOIN mass USING (source, target, i)"
    return _with(
        log, PATTERNS, STEPS, GRAPH if graph == "dfg" else GRAPH.replace("dfg AS", "dfg0 AS") + f", {graph}", MISSING, KEPT, OFFSETS,
        "expanded AS (SELECT activity, secs::DOUBLE secs FROM offs)",
        f"""stat AS (SELECT activity, count(*) size, min(secs) lo, max(secs) hi,
             CASE WHEN count(*) < 2 OR coalesce(stddev_samp(secs), 0) = 0 THEN 1 ELSE 1.06::DOUBLE * stddev_samp(secs) * pow(count(*)::DOUBLE, -0.2::DOUBLE) * {wide} END bw FROM expanded GROUP BY activity)""",
        """pair AS (SELECT m.source, m.target, a.size na, b.size nb, b.bw, pa.share sa, pb.share sb, least(a.lo, b.lo) lo, greatest(a.hi, b.hi) hi
             FROM missing m JOIN stat a ON a.activity = m.source JOIN stat b ON b.activity = m.target JOIN pres pa ON pa.activity = m.source JOIN pres pb ON pb.activity = m.target)""",
        "edge AS (SELECT *, lo - ((hi - lo) * 0.1::DOUBLE + 1) x0, ((hi + ((hi - lo) * 0.1::DOUBLE + 1)) - (lo - ((hi - lo) * 0.1::DOUBLE + 1))) / 100::DOUBLE step FROM pair)",
        "grid AS (SELECT *, x0 + i * step r, x0 + (i + 1) * step t FROM edge, (SELECT unnest(range(100)) i))",
        f"later AS (SELECT g.source, g.target, i, any_value(step) step, any_value(sa) sa, any_value(sb) sb, 1 - sum(h.n * {phi}) / any_value(g.nb) later FROM grid g JOIN hist h ON h.activity = g.target GROUP BY g.source, g.target, i)",
        "mass AS (SELECT g.source, g.target, i, sum(h.n)::DOUBLE / any_value(g.na) mass FROM grid g JOIN hist h ON h.activity = g.source AND h.secs >= g.r AND h.secs <= g.t GROUP BY g.source, g.target, i)",
        "area AS (SELECT source, target, (sum(step * later) - sum(step * coalesce(mass, 0))) * any_value(sa) * any_value(sb) score FROM later LEFT JOIN mass USING (source, target, i) GROUP BY source, target)",
        "every AS (SELECT source, target, coalesce(score, 0) score FROM missing LEFT JOIN area USING (source, target))",
    ) + last


def _before(left: str, *right: str) -> str:
    """SQL: some event of ``left`` comes after the first of ``right``."""
    first = "least(" + ", ".join(f"nullif(coalesce(list_position(acts, '{x}'), 0), 0)" for x in right) + ")"
    return f"(list_contains(acts, '{left}') AND coalesce(len(acts) + 1 - list_position(list_reverse(acts), '{left}') > {first}, FALSE))"


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    ends = """f AS (SELECT otype, oid, arg_min(activity, (ts, eid)) a, arg_max(activity, (ts, eid)) z FROM rel GROUP BY otype, oid),
        side AS (SELECT otype, a activity, TRUE s FROM f UNION ALL SELECT otype, z, FALSE FROM f)"""
    trace = "tr AS (SELECT oid, otype, list(activity ORDER BY ts, eid) acts FROM kept GROUP BY oid, otype)"
    collapsed = "list_filter(acts, lambda x, i: i = 1 OR x <> acts[i - 1])"
    once_placed = "acts[1] = 'place order' AND NOT list_contains(acts[2:], 'place order')"
    loops = ", ".join(repr(x) for x in CLICK_LOOPS)
    variants = f"""step AS (SELECT user_id, event_type, ts, CAST(event_id AS VARCHAR) eid, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) > INTERVAL {GAP} SECOND AS far FROM events),
        cut AS (SELECT *, count(*) FILTER (far) OVER (PARTITION BY user_id ORDER BY ts, eid ROWS UNBOUNDED PRECEDING) k FROM step),
        seq AS (SELECT list(event_type ORDER BY ts, eid) a FROM cut GROUP BY user_id, k),
        once AS (SELECT DISTINCT list_filter(a, lambda x, i: i = 1 OR x <> a[i - 1] OR x NOT IN ({loops})) a FROM seq),
        place AS (SELECT a, unnest(range(1, len(a) + 1)) i FROM once),
        grown AS (SELECT a FROM once UNION SELECT a[1:i] || list_resize([a[i]], t, a[i]) || a[i + 1:] FROM place, (SELECT unnest([1, 2]) t) WHERE a[i] IN ({loops}))"""
    for log in LOGS:
        out |= {
            f"relations_{log}": RELATIONS[log],
            f"patterns_{log}": _with(log, PATTERNS) + "SELECT * FROM pat",
            f"dfg_{log}": _with(log, PATTERNS, STEPS, GRAPH) + "SELECT * FROM dfg",
            f"dfg_by_type_{log}": _with(log, STEPS) + "SELECT otype, source, target, count(*) cnt FROM nxt WHERE target IS NOT NULL GROUP BY ALL",
            f"endpoints_{log}": _with(log, ends) + "SELECT activity, bool_or(s) is_start, bool_or(NOT s) is_end FROM side GROUP BY activity",
            f"traces_{log}": _with(log, PATTERNS, KEPT, trace) + "SELECT oid, otype, array_to_string(acts, '>') trace FROM tr",
        }
    noise = "cut AS (SELECT * FROM dfg WHERE weight > (SELECT floor(CAST(sum(weight) AS DOUBLE) * CAST({} AS DOUBLE)) FROM dfg))"
    base = (PATTERNS, STEPS, GRAPH)
    out |= {
        "event_object_sets": _with("orders", "x AS (SELECT eid, max(activity) activity, list_sort(list(DISTINCT oid)) o FROM rel GROUP BY eid)") + "SELECT eid, activity, array_to_string(o, ',') objects FROM x",
        "endpoints_by_type_orders": _with("orders", ends) + "SELECT otype, activity, bool_or(s) is_start, bool_or(NOT s) is_end FROM side GROUP BY otype, activity",
        "dfg_noise_clicks": _with("clicks", *base, noise.format(0.04)) + "SELECT * FROM cut",
        "dfg_noise_orders": _with("orders", *base, noise.format(0.3)) + "SELECT * FROM cut",
        "dfg_filtered_clicks": _with("clicks", *base) + "SELECT * FROM dfg WHERE source <> 'error' AND target <> 'error'",
        "dfg_induced_clicks": _with("clicks", *base) + "SELECT * FROM dfg WHERE source IN ('click', 'view', 'purchase') AND target IN ('click', 'view', 'purchase')",
        "trace_offsets_orders": _with("orders", PATTERNS, KEPT, OFFSETS) + "SELECT oid, activity, secs, count(*) n FROM offs GROUP BY ALL",
        "traces_collapsed_clicks": _with("clicks", PATTERNS, KEPT, trace) + f"SELECT oid, array_to_string({collapsed}, '>') trace FROM tr",
        "activity_presence_orders": _with("orders", PATTERNS, KEPT, OFFSETS) + "SELECT * FROM pres",
        "missing_edges_orders": _with("orders", *base, MISSING) + "SELECT * FROM missing",
        "add_cost_order_orders": _with(
            "orders", *base, MISSING, KEPT, OFFSETS, "sz AS (SELECT activity, sum(n) size FROM hist GROUP BY activity)",
            """pq AS (SELECT m.source, m.target, sum(CASE WHEN b.secs > a.secs THEN a.n * b.n ELSE 0 END)::DOUBLE / sum(a.n * b.n)::DOUBLE * any_value(pa.share) * any_value(pb.share) p
                FROM missing m JOIN hist a ON a.activity = m.source JOIN hist b ON b.activity = m.target JOIN pres pa ON pa.activity = m.source JOIN pres pb ON pb.activity = m.target GROUP BY m.source, m.target)""",
        ) + "SELECT source, target, round(CASE WHEN p > 0 THEN (1 - p) * 100 ELSE 99999::DOUBLE END, 6) cost FROM missing LEFT JOIN pq USING (source, target)",
        "add_cost_curve_orders": _curve_sql("orders", "dfg", "uniform", True),
        "add_cost_curve_clicks": _curve_sql("clicks", "dfg AS (SELECT * FROM dfg0 WHERE weight > (SELECT floor(CAST(sum(weight) AS DOUBLE) * CAST(0.04 AS DOUBLE)) FROM dfg0))", "uniform", True),
        "add_cost_no_floor_orders": _curve_sql("orders", "dfg", "uniform", False),
        "curve_series_orders": _curve_sql("orders", "dfg", "uniform", False, True),
        "relations_ocel_keys": RELATIONS["keys"],
        "relations_ocel_orders": RELATIONS["orders"],
        "raw_traces_keys": "SELECT 'k' || json_extract_string(props, '$.k') oid, string_agg(event_type, '>' ORDER BY ts, CAST(event_id AS VARCHAR)) trace FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY oid",
        "loop_variants_clicks": f"WITH {variants} SELECT array_to_string(a, '>') trace FROM grown",
        "coverage_clicks": f"WITH {variants}, runs AS (SELECT DISTINCT unnest([{', '.join('[' + ', '.join(repr(x) for x in r) + ']' for r in CLICK_RUNS)}]) a) "
        "SELECT count(*) executions, count(*) FILTER (a IN (SELECT a FROM grown)) covered, count(*) FILTER (a IN (SELECT a FROM grown)) * 100.0::DOUBLE / count(*) AS share FROM runs",
        "log_metrics_orders": _with("orders") .rstrip().rstrip(",") + f" SELECT count(DISTINCT oid) traces, count(DISTINCT eid) events, count(DISTINCT activity) activities, count(DISTINCT activity) FILTER (activity IN ({', '.join(repr(x) for x in MODEL_NAMES)})) / {len(MODEL_NAMES)}::DOUBLE activity_precision FROM rel",
        "add_cost_logistic_orders": _curve_sql("orders", "dfg", "logistic", False),
        "bidirectional_pairs_clicks": _with("clicks", *base) + "SELECT a.source, a.target FROM dfg a JOIN dfg b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target",
        "reachability_orders": _with("orders", *base, MISSING, CLOSURE, recursive=True) + "SELECT DISTINCT source, target FROM r",
        "components_orders": _with("orders", *base, MISSING, "u AS (SELECT source, target FROM dfg UNION SELECT target, source FROM dfg)", CLOSURE.replace("dfg", "u"), recursive=True) + "SELECT source activity, min(target) component FROM r GROUP BY source",
        **{
            f"sccs_{log}": _with(log, *base, MISSING, CLOSURE, recursive=True) + "SELECT a.source activity, min(a.target) component FROM r a JOIN r b ON a.source = b.target AND a.target = b.source GROUP BY a.source"
            for log in ("clicks", "orders")
        },
        "replay_counts_orders": _with(
            "orders", PATTERNS, KEPT, trace, f"run AS (SELECT otype, {collapsed} run FROM tr)", "single AS (SELECT run, count(*) n FROM run WHERE len(run) = len(list_distinct(run)) GROUP BY run)",
            "model AS (SELECT unnest([" + ", ".join("[" + ", ".join(f"'{x}'" for x in r) + "]" for r in GIVEN_RUNS) + "]) m)",
            "types AS (SELECT otype, list(DISTINCT activity) names FROM kept GROUP BY otype)",
            "own AS (SELECT DISTINCT list_filter(m, lambda x: list_contains(names, x)) run FROM types, model)",
        ) + "SELECT count(*) executions, count(n) fitting_executions, CAST(coalesce(sum(n), 0) AS BIGINT) fitting_traces, (SELECT count(*) FROM tr) traces FROM own LEFT JOIN single USING (run) WHERE len(own.run) > 0",
        "replay_trees_orders": _with(
            "orders", PATTERNS, KEPT, trace, f"run AS (SELECT otype, {collapsed} run FROM tr)", "single AS (SELECT run, count(*) n FROM run WHERE len(run) = len(list_distinct(run)) GROUP BY run)",
            "types AS (SELECT otype, list(DISTINCT activity) names FROM kept GROUP BY otype)",
            "model AS (" + " UNION ALL ".join(f"SELECT {i} AS candidate, unnest([{', '.join('[' + ', '.join(map(repr, r)) + ']' for r in runs)}]) m" for i, runs in enumerate(GIVEN_LANGUAGES)) + ")",
            "own AS (SELECT DISTINCT candidate, list_filter(m, lambda x: list_contains(names, x)) run FROM types, model)",
        ) + """SELECT CAST(candidate AS INTEGER) candidate, count(*)::DOUBLE executions, count(n) fitting_executions, CAST(coalesce(sum(n), 0) AS BIGINT) fitting_traces, (SELECT count(*) FROM tr) traces
            FROM own LEFT JOIN single USING (run) WHERE len(own.run) > 0 GROUP BY candidate""",
        "conformance_given_orders": _with(
            "orders", PATTERNS, STEPS, ends, "kinds AS (UNPIVOT pat ON related, divergent, convergent, deficient INTO NAME k VALUE v)",
            "held AS (SELECT k, otype o, activity x, '' y FROM kinds WHERE v)",
            "lg AS (SELECT CASE WHEN s THEN 'start' ELSE 'end' END k, otype o, activity x, '' y FROM side UNION SELECT 'step', otype, source, target FROM nxt WHERE target IS NOT NULL UNION SELECT * FROM held)",
            "types AS (SELECT otype, list(activity) names FROM pat GROUP BY otype)",
            f"own AS (SELECT otype, list_filter(m, lambda x: list_contains(names, x)) run FROM types, (SELECT unnest([{', '.join('[' + ', '.join(map(repr, r)) + ']' for r in GIVEN_LANGUAGES[0])}]) m))",
            f"""model AS (SELECT * FROM held WHERE x IN ({', '.join(map(repr, sorted(GIVEN_TREE.activities())))}) UNION SELECT 'start', otype, run[1], '' FROM own WHERE len(run) > 0 UNION SELECT 'end', otype, run[len(run)], '' FROM own WHERE len(run) > 0
                UNION SELECT 'step', otype, run[i], run[i + 1] FROM (SELECT *, unnest(range(1, len(run))) i FROM own))""",
            "n AS (SELECT count(*)::DOUBLE c, (SELECT count(*) FROM lg) / 1::DOUBLE l, (SELECT count(*) FROM model) / 1::DOUBLE m FROM lg JOIN model USING (k, o, x, y))",
        ) + "SELECT c / l AS fitness, c / m AS \"precision\", 2 * (c / l) * (c / m) / (c / l + c / m) f_score FROM n",
        "violations_sequence_orders": _with("orders", PATTERNS, KEPT, trace) + f"SELECT count(*) traces, count(*) FILTER ({_before('place order', 'return item')}) violating FROM tr",
        "violations_tree_orders": _with("orders", PATTERNS, KEPT, trace) + f"""SELECT count(*) traces, count(*) FILTER ({_before('place order', 'ship item', 'close item', 'return item')}
            OR (list_contains(acts, 'ship item') AND list_has_any(acts, ['close item', 'return item'])) OR {_before('close item', 'return item')}) violating FROM tr""",
        "replay_greedy_orders": _with("orders", trace.replace("FROM kept", "FROM rel")) + f"SELECT count(*) traces, count(*) FILTER ({once_placed}) fitting FROM tr",
        "metrics_orders": _with("orders", trace.replace("FROM kept", "FROM rel")) + f"""SELECT count(DISTINCT oid) traces, count(DISTINCT eid) events, count(DISTINCT activity) activities,
            count(DISTINCT activity) FILTER (activity IN ('place order', 'ship item', 'close item', 'return item')) / 4::DOUBLE activity_precision,
            (SELECT count(*) FILTER ({once_placed})::DOUBLE / count(*) FROM tr) fitness FROM rel""",
        **{f"dfg_by_type_stream_{log}": out[f"dfg_by_type_{log}"] for log in ("clicks", "keys")},
        "self_loops_sessions": _self_loops_sql(False),
        "self_loops_corrected_sessions": _self_loops_sql(True),
        "descendants_orders": ORDER_TREES + "SELECT tree_id, node_id, CAST(len(above) - list_position(above, '0.1') AS INTEGER) depth FROM down WHERE list_contains(above, '0.1')",
        "open_flower_orders": ORDER_TREES + """, one AS (SELECT * FROM down WHERE label = 'flower' QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY place) = 1)
            SELECT tree_id, node_id, array_to_string(names, ',') activities FROM one JOIN held USING (tree_id, node_id)""",
        "collapse_orders": ORDER_TREES + """, acts AS (SELECT tree_id, list_sort(list(DISTINCT label)) names FROM down WHERE list_contains(above, '0.1') AND label NOT IN ('parallel', 'flower') GROUP BY tree_id)
            SELECT tree_id, node_id, parent_id, child_pos, CASE WHEN node_id = '0.1' THEN 'flower' ELSE label END label FROM down WHERE len(above) < 3
            UNION ALL SELECT tree_id, '0.1.' || (i - 1), '0.1', CAST(i - 1 AS INTEGER), names[i] FROM (SELECT *, unnest(range(1, len(names) + 1)) i FROM acts)""",
        "replace_flowers_orders": ORDER_TREES + """, hit AS (SELECT d.* FROM down d JOIN held h USING (tree_id, node_id) WHERE d.label = 'flower' AND h.names = ['close item', 'ship item']),
            part AS (SELECT * FROM (VALUES ('', NULL, 0, 'sequence'), ('.0', '', 0, 'ship item'), ('.1', '', 1, 'redo'), ('.1.0', '.1', 0, 'close item'), ('.1.1', '.1', 1, 'tau')) t(id, up, pos, label))
            SELECT tree_id, node_id, parent_id, child_pos, label FROM down d WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.tree_id = d.tree_id AND list_contains(d.above, h.node_id))
            UNION ALL SELECT tree_id, h.node_id || p.id, CASE WHEN up IS NULL THEN h.parent_id ELSE h.node_id || up END, CASE WHEN up IS NULL THEN h.child_pos ELSE pos END, p.label FROM hit h, part p""",
        "violations_exclusive_orders": _with("orders", PATTERNS, KEPT, trace) + "SELECT count(*) traces, count(*) FILTER (list_contains(acts, 'close item') AND list_contains(acts, 'return item')) violating FROM tr",
    }
    return out
