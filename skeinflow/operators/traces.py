"""Traces of objects, and what the cost model needs of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.operators.order import changed, in_order, running_sums
from skeinflow.sources.scratch import keep, lean


def kept_relations(relations: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows of objects in whose trace fewer than two activities are divergent for the object's type."""
    loose = patterns.where("divergent").select("activity", "otype")
    bad = relations.select("oid", "otype", "activity").distinct().join(loose, ["activity", "otype"], "left_semi")
    gone = bad.groupBy("oid").agg(F.count("*").alias("n")).where("n >= 2").select("oid")
    return relations.join(gone, "oid", "left_anti")


def traces(relations: DataFrame) -> DataFrame:
    """(oid, otype, activities): each object's activities in order of (ts, eid).  A trace is one row, as long as the object's history."""
    events = F.array_sort(F.collect_list(F.struct("ts", "eid", "activity")))
    return relations.groupBy("oid", "otype").agg(F.transform(events, lambda x: x["activity"]).alias("activities"))


def collapse(activities: F.Column) -> F.Column:
    """Runs of one activity become one."""
    return F.filter(activities, lambda x, i: (i == 0) | (x != F.get(activities, i - 1)))


def offsets(relations: DataFrame) -> DataFrame:
    """(oid, activity, secs, n): whole seconds since the object's first event, and how often."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    start = relations.groupBy("oid").agg(F.min("ts").alias("t0"))
    secs = F.floor((micros - F.unix_micros(F.col("t0").cast("timestamp"))) / 1_000_000)
    return relations.join(start, "oid").select("oid", "activity", secs.alias("secs")).groupBy("oid", "activity", "secs").agg(F.count("*").alias("n"))


def presence(relations: DataFrame) -> DataFrame:
    """(activity, objects, share): the share of objects that have the activity."""
    with lean(relations.sparkSession):
        total = relations.select("oid").distinct().count()
    held = relations.select("oid", "activity").distinct().groupBy("activity").agg(F.count("*").alias("objects"))
    return held.select("activity", "objects", (F.col("objects").cast("double") / float(total or 1)).alias("share"))


def histogram(relations: DataFrame) -> DataFrame:
    """(activity, secs, n) over all objects."""
    return offsets(relations).groupBy("activity", "secs").agg(F.sum("n").alias("n"))


def _profile(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``histogram`` and ``presence`` from offsets written once."""
    each = keep(offsets(keep(relations, "kept")), "offsets")
    return keep(each.groupBy("activity", "secs").agg(F.sum("n").alias("n")), "histogram"), keep(presence(each).select("activity", "share"), "presence")


NEVER = 99999.0


def order_cost(missing: DataFrame, relations: DataFrame) -> DataFrame:
    """(source, target, cost): 100 * (1 - p) where p is the chance that target comes after source, both present; ``NEVER`` if p is 0.

    Pairs of occurrences are counted from running sums over the histogram, never made.  ``missing`` has at most activities squared rows.
    """
    hist, share = _profile(relations)
    missing = keep(missing.select("source", "target"), "missing")
    # what a source's times ask of the target's histogram, once for each target
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    asks = hist.withColumnRenamed("activity", "source").join(F.broadcast(missing), "source").select(F.col("target").alias("activity"), "source", "secs", F.lit(1).alias("k"), F.col("n").alias("a"), zero.alias("b"))
    data = hist.select("activity", none.alias("source"), "secs", F.lit(0).alias("k"), zero.alias("a"), F.col("n").alias("b"))
    sums = running_sums(asks.union(data), ["activity"], ["secs", "k"], {"until": F.col("b")}).where("source is not null")
    own = hist.groupBy("activity").agg(F.sum("n").alias("nb"))
    counts = sums.groupBy("source", "activity").agg(F.sum("a").alias("na"), F.sum(F.col("a") * F.col("until")).alias("not_after")).join(own, "activity").withColumnRenamed("activity", "target")
    whole = counts.select("source", "target", (F.col("na") * F.col("nb") - F.col("not_after")).alias("after"), "na", "nb")
    a, b = (share.select(F.col("activity").alias(c), F.col("share").alias(f"p_{c}")) for c in ("source", "target"))
    p = F.col("after").cast("double") / (F.col("na") * F.col("nb")).cast("double") * F.col("p_source") * F.col("p_target")
    joined = missing.select("source", "target").join(whole.where("na > 0 and nb > 0"), ["source", "target"], "left").join(a, "source", "left").join(b, "target", "left")
    return joined.select("source", "target", F.when(p > 0, (1.0 - p) * 100.0).otherwise(F.lit(NEVER)).alias("cost"))


BUCKETS = 100
#: The logistic kernel: slope, cells of a bandwidth, bandwidths of a block, order of the series within a cell.
SLOPE, CELLS, REACH, ORDER = 1.702, 32, 24, 5


def _logistic(z: F.Column, moments: list[str]) -> F.Column:
    """The logistic function summed over a cell's events around z, from their counts and moments: its Taylor series.

    A derivative is a polynomial in the function itself, s: each comes from the
    one before by the chain rule with s' = s - s^2.
    """
    s = 1.0 / (1.0 + F.exp(-z))
    poly, total, divisor = [0, 1], F.lit(0.0), 1
    for k, moment in enumerate(moments):
        value = F.lit(0.0)
        for c in reversed(poly):
            value = value * s + float(c)
        total = total + F.col(moment) * value / float(divisor)
        slopes = [i * c for i, c in enumerate(poly)][1:]
        poly = [a - b for a, b in zip([0, *slopes, 0], [0, 0, *slopes], strict=True)]
        divisor *= k + 1
    return total


def logistic_sums(points: DataFrame, hist: DataFrame, widths: DataFrame) -> DataFrame:
    """(points' columns, until): for each point (activity, t) the sum of n * logistic(SLOPE * (t - secs) / bw) over the activity's histogram.

    Histograms become cells of bw / CELLS with moments up to ``ORDER``, in blocks
    of ``REACH`` bandwidths.  A point is held against the cells of three blocks;
    blocks before them count whole and later ones not at all, from running sums.
    The error is below 1e-12 of the activity's events, whatever the histogram.
    """
    u = SLOPE * ((F.col("cell") + 0.5) * F.col("bw") / float(CELLS) - F.col("secs")) / F.col("bw")
    moments = [f"m{k}" for k in range(ORDER + 1)]
    placed = hist.join(widths, "activity").withColumn("cell", F.floor(F.col("secs") * float(CELLS) / F.col("bw")))
    cells = placed.withColumn("u", u).groupBy("activity", "bw", "cell").agg(*[F.sum(F.col("n") * F.pow("u", F.lit(float(k)))).alias(m) for k, m in enumerate(moments)])
    cells = keep(cells.withColumn("block", F.floor(F.col("cell") / float(CELLS * REACH))), "cells")
    columns = points.columns
    points = points.join(widths, "activity").withColumn("at", F.floor(F.col("t") / (F.col("bw") * float(REACH)))).withColumn("point", F.struct(*columns)).select("point", "activity", "t", "at")
    near = points.withColumn("block", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1))).join(cells, ["activity", "block"])
    centre = (F.col("cell") + 0.5) * F.col("bw") / float(CELLS)
    near = near.groupBy("point").agg(F.sum(_logistic(SLOPE * (F.col("t") - centre) / F.col("bw"), moments)).alias("near"))
    none = F.lit(None).cast(points.schema["point"].dataType)
    asks = points.select("point", "activity", (F.col("at") - 2).alias("x"), F.lit(2).alias("k"), F.lit(0.0).alias("m0"))
    data = cells.groupBy("activity", "block").agg(F.sum("m0").alias("m0")).select(none.alias("point"), "activity", F.col("block").alias("x"), F.lit(1).alias("k"), "m0")
    whole = running_sums(asks.union(data), ["activity"], ["x", "k"], {"whole": F.col("m0")}).where("point is not null").select("point", "whole")
    return whole.join(near, "point", "left").select("point.*", (F.col("whole") + F.coalesce("near", F.lit(0.0))).alias("until"))


def curve_series(missing: DataFrame, relations: DataFrame, kernel: str = "uniform") -> DataFrame:
    """(source, target, i, step, share_a, share_b, mass, later): the two curves of each missing edge over the buckets of its range.

    ``mass`` is source's share in a bucket, ``later`` the smoothed chance that
    target is still to come.  Buckets look up counts and sums below their bounds
    in one running sum per activity.  ``kernel="logistic"`` has no closed form;
    see ``logistic_sums``.
    """
    hist, share = _profile(relations)
    missing = keep(missing.select("source", "target"), "missing")
    stats = hist.groupBy("activity").agg(
        F.sum("n").alias("size"), F.min("secs").alias("lo"), F.max("secs").alias("hi"), F.sum(F.col("n") * F.col("secs").cast("double")).alias("s"),
        F.sum(F.col("n") * F.col("secs").cast("double") * F.col("secs").cast("double")).alias("ss"),
    )
    mean = stats.select("activity", (F.col("s") / F.col("size")).alias("mean"))
    spread = hist.join(mean, "activity").groupBy("activity").agg(F.sum(F.col("n") * F.pow(F.col("secs") - F.col("mean"), 2)).alias("dev"))
    sd = F.sqrt(F.col("dev") / (F.col("size") - 1))
    wide = 4.0 if kernel == "uniform" else 1.0
    bw = F.when((F.col("size") < 2) | (F.col("dev") == 0), 1.0).otherwise(F.lit(1.06) * sd * F.pow(F.col("size").cast("double"), F.lit(-0.2)) * wide)
    known = stats.join(spread, "activity").join(share, "activity").select("activity", "size", "lo", "hi", "share", bw.alias("bw"))
    known = keep(known, "activities")
    a, b = ((known.select(*[F.col(c).alias(f"{c}_{x}" if c != "activity" else n) for c in known.columns])) for x, n in (("a", "source"), ("b", "target")))
    low, high = F.least("lo_a", "lo_b").cast("double"), F.greatest("hi_a", "hi_b").cast("double")
    margin = (high - low) * 0.1 + 1.0
    grid = missing.select("source", "target").join(a, "source").join(b, "target").withColumns({"x0": low - margin, "step": ((high + margin) - (low - margin)) / float(BUCKETS)})
    grid = grid.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    grid = grid.withColumns({"r": F.col("x0") + F.col("i") * F.col("step"), "t": F.col("x0") + (F.col("i") + 1) * F.col("step")})
    looks = [("ra", "source", F.col("r"), 0), ("ta", "source", F.col("t"), 2)]
    if kernel == "uniform":
        looks += [("lb", "target", F.col("t") - F.col("bw_b"), 0), ("ub", "target", F.col("t") + F.col("bw_b"), 2)]
    look = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.col(name).alias("activity"), x.alias("x"), F.lit(k).alias("k")) for w, name, x, k in looks]))
    asks = grid.select("source", "target", "i", look.alias("l")).select("source", "target", "i", "l.*", F.lit(0).cast("long").alias("n"))
    none = F.lit(None)
    data = hist.select(none.cast("string").alias("source"), none.cast("string").alias("target"), none.cast("int").alias("i"), none.cast("string").alias("w"), "activity", F.col("secs").cast("double").alias("x"), F.lit(1).alias("k"), "n")
    sums = {"c": F.col("n"), "s": F.col("n") * F.col("x")}
    found = running_sums(asks.union(data), ["activity"], ["x", "k"], sums).where("w is not null")
    pick = {f"{c}_{w}": F.max(F.when(F.col("w") == w, F.col(c))) for w, *_ in looks for c in ("c", "s")}
    at = grid.join(found.groupBy("source", "target", "i").agg(*[v.alias(k) for k, v in pick.items()]), ["source", "target", "i"])
    if kernel == "uniform":
        k, s = F.col("c_ub") - F.col("c_lb"), F.col("s_ub") - F.col("s_lb")
        until = F.col("c_lb") + 0.5 * (k * (F.col("t") / F.col("bw_b") + 1.0) - s / F.col("bw_b"))
    else:
        late = logistic_sums(grid.select("source", F.col("target").alias("activity"), "i", "t"), hist, known.select("activity", "bw"))
        at = at.join(late.select("source", F.col("activity").alias("target"), "i", "until"), ["source", "target", "i"])
        until = F.col("until")
    mass = (F.col("c_ta") - F.col("c_ra")) / F.col("size_a")
    return at.select("source", "target", "i", "step", "share_a", "share_b", mass.alias("mass"), (1.0 - until / F.col("size_b")).alias("later"))


def curve_cost(missing: DataFrame, relations: DataFrame, kernel: str = "uniform", floor: float | None = 1.0) -> DataFrame:
    """(source, target, score, cost): the area between the curves of ``curve_series``, scaled so that the largest costs nothing; at least ``floor``."""
    missing = keep(missing.select("source", "target"), "missing")  # at most activities squared
    points = curve_series(missing, relations, kernel)
    area = points.groupBy("source", "target").agg(((F.sum(F.col("step") * F.col("later")) - F.sum(F.col("step") * F.col("mass"))) * F.first("share_a") * F.first("share_b")).alias("score"))
    every = missing.select("source", "target").join(area, ["source", "target"], "left").select("source", "target", F.coalesce("score", F.lit(0.0)).alias("score"))
    most = F.max(F.abs("score")).over(Window.partitionBy())
    cost = F.when(most > 0, (1.0 - F.col("score") / most) * 100.0).otherwise(F.col("score"))
    return every.select("source", "target", "score", (F.greatest(cost, F.lit(float(floor))) if floor is not None else cost).alias("cost"))


def violations(relations: DataFrame, left: list[str], right: list[str], kind: str) -> DataFrame:
    """(traces, violating): traces that break a cut; sequence: every event of ``left`` comes before the first of ``right``; exclusive: not both."""
    return rule_violations(relations, [(kind, set(left), set(right))])


def rule_violations(relations: DataFrame, rules: list[tuple[str, set[str], set[str]]]) -> DataFrame:
    """(traces, violating): traces that break any of the rules (kind, left, right) as ``violations`` says.

    Only the last event of the left and the first of the right side are kept of
    an object for each rule, by partial aggregates, so no trace is gathered.
    Without rules nothing is violated.
    """
    key = F.struct("ts", "eid")
    sides, bad = [], F.lit(False)
    for i, (kind, left, right) in enumerate(rules):
        one, two = (F.when(F.col("activity").isin(sorted(side)), key) for side in (left, right))
        sides += [F.max(one).alias(f"left{i}"), F.min(two).alias(f"right{i}")]
        both = F.col(f"left{i}").isNotNull() & F.col(f"right{i}").isNotNull()
        bad = bad | (both if kind == "exclusive" else both & (F.col(f"left{i}") > F.col(f"right{i}")))
    traces = relations.groupBy("oid", "otype").agg(F.count("*").alias("_events"), *sides)
    return traces.agg(F.count("*").alias("traces"), F.count_if(bad).alias("violating"))


def raw_traces(events: DataFrame, e2o: DataFrame) -> DataFrame:
    """(oid, activities) of every object id that a link names, declared or not, in order of (time, id).

    ``events``: id, type, time; ``e2o``: event_id, object_id.  Links to unknown
    events and without an object are left out.
    """
    named = events.select(F.col("id").alias("event_id"), F.col("type").alias("activity"), F.col("time").alias("ts"))
    held = e2o.select("event_id", F.col("object_id").alias("oid")).where("oid is not null").join(named, "event_id")
    seen = F.array_sort(F.collect_list(F.struct("ts", F.col("event_id").alias("eid"), "activity")))
    return held.groupBy("oid").agg(F.transform(seen, lambda x: x["activity"]).alias("activities"))


#: Traces are told apart by length and by two sums of hash(activity) * base^position modulo a prime: (modulus, base, seed).
FIELDS = ((2147483647, 1103515245, 1), (2147483629, 1566083941, 2))


def power(at: F.Column, field: tuple[int, int, int]) -> F.Column:
    """base^at modulo the field's prime, for 0 <= at < 2^32: a product over the bits of ``at``."""
    modulus, base, _ = field
    out = F.lit(1).cast("long")
    for bit in range(32):
        factor = F.when(F.shiftright(at, bit).bitwiseAND(1) == 1, pow(base, 1 << bit, modulus)).otherwise(1)
        out = F.pmod(out * factor, F.lit(modulus).cast("long"))
    return out


def letter(activity: F.Column, field: tuple[int, int, int]) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(field[2]), activity), F.lit(field[0]).cast("long"))


def term(activity: F.Column, at: F.Column, field: tuple[int, int, int]) -> F.Column:
    return F.pmod(letter(activity, field) * power(at, field), F.lit(field[0]).cast("long"))


def trace_prints(relations: DataFrame) -> DataFrame:
    """(oid, otype, n, x, y, single) of each object's trace with repeats collapsed: its length, two fingerprints, and whether no activity comes twice.

    Sums over events, added up before the shuffle; no trace is gathered in a row.
    """
    steps = in_order(relations, ("oid", "otype")).where((F.col("pos") == 1) | ~F.col("before.activity").eqNullSafe(F.col("activity")))
    once = steps.groupBy("oid", "otype", "activity").agg(F.count("*").alias("n"), *[F.pmod(F.sum(term(F.col("activity"), F.col("run"), f)), F.lit(f[0]).cast("long")).alias(x) for f, x in zip(FIELDS, "xy", strict=True)])
    sums = [F.pmod(F.sum(x), F.lit(f[0]).cast("long")).alias(x) for f, x in zip(FIELDS, "xy", strict=True)]
    return once.groupBy("oid", "otype").agg(F.sum("n").alias("n"), *sums, (F.max("n") == 1).alias("single"))


def run_prints(runs: DataFrame, column: str = "run") -> DataFrame:
    """``runs`` with n, x and y of an array of activities, as ``trace_prints`` has them for traces."""

    def total(field):
        at = F.transform(F.col(column), lambda a, i: term(a, (i + 1).cast("long"), field))
        return F.aggregate(at, F.lit(0).cast("long"), lambda s, v: F.pmod(s + v, F.lit(field[0]).cast("long")))

    return runs.withColumns({"n": F.size(column).cast("long"), "x": total(FIELDS[0]), "y": total(FIELDS[1])})


def sessions(relations: DataFrame, gap: int) -> DataFrame:
    """The relations with each object cut where more than ``gap`` seconds pass between two events: ``oid`` becomes oid and number of the stretch."""

    def later(was: F.Column, now: F.Column) -> F.Column:
        return now["ts"].cast("timestamp") > was["ts"].cast("timestamp") + F.expr(f"INTERVAL {int(gap)} SECONDS")

    return in_order(relations, new=later).select("eid", "activity", "ts", F.concat_ws("-", "oid", "run").alias("oid"), "otype")


def loop_variants(runs: DataFrame, loops: list[str]) -> DataFrame:
    """(activities): distinct traces with runs of ``loops`` cut to one, each as it is and with one or two more at each of their places.

    ``runs`` has a column activities; a trace with p places of such activities
    becomes 1 + 2 * p.
    """
    inside = F.array(*[F.lit(x) for x in loops]).cast("array<string>")
    names = F.col("activities")
    once = runs.select(F.filter(names, lambda x, i: (i == 0) | (x != F.get(names, i - 1)) | ~F.array_contains(inside, x)).alias("activities")).distinct()
    places = F.filter(F.sequence(F.lit(1), F.size("activities")), lambda i: F.array_contains(inside, F.get("activities", i - 1)))

    def grown(times: int):
        longer = F.transform(places, lambda i: F.concat(F.slice("activities", 1, i), F.array_repeat(F.get("activities", i - 1), times), F.slice("activities", i + 1, F.size("activities"))))
        return F.when(F.size("activities") > 0, longer).otherwise(F.array().cast("array<array<string>>"))

    return once.select(F.explode(F.concat(F.array("activities"), grown(1), grown(2))).alias("activities")).distinct()


def variant_prints(relations: DataFrame, loops: list[str], longest: int) -> DataFrame:
    """Distinct (n, x, y) of the ``loop_variants`` of the log's traces that have at most ``longest`` events.

    A variant's sum follows from the trace's: what stands before the place stays,
    what stands after it moves on.  Only objects that can give so short a variant
    get beyond the count of their events.
    """

    def kept(was: F.Column, now: F.Column) -> F.Column:
        return changed(was, now) | ~now["activity"].isin(list(loops))

    steps = in_order(relations, ("oid", "otype"), new=kept)
    steps = steps.where((F.col("pos") == 1) | kept(F.col("before"), F.struct("activity", "ts"))).select("oid", "otype", "activity", F.col("run").alias("at"))
    short = steps.groupBy("oid", "otype").agg(F.count("*").alias("n")).where(F.col("n") <= longest)
    way = Window.partitionBy("oid", "otype").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # at most ``longest`` rows
    terms = {x: term(F.col("activity"), F.col("at"), f) for f, x in zip(FIELDS, "xy", strict=True)}
    upto = steps.join(short, ["oid", "otype"]).withColumns({f"upto_{k}": F.pmod(F.sum(v).over(way), F.lit(f[0]).cast("long")) for (k, v), f in zip(terms.items(), FIELDS, strict=True)})
    whole = Window.partitionBy("oid", "otype").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = upto.withColumns({x: F.last(f"upto_{x}").over(whole) for x in "xy"})

    def grown(times: int):
        def moved(field, x):
            p = F.lit(field[0]).cast("long")
            more = F.lit(0).cast("long")
            for i in range(1, times + 1):
                more = more + F.pmod(letter(F.col("activity"), field) * power(F.col("at") + i, field), p)
            after = F.pmod(F.pmod(F.col(x) - F.col(f"upto_{x}"), p) * pow(field[1], times, field[0]), p)
            return F.pmod(F.col(f"upto_{x}") + more + after, p).alias(x)

        return F.struct((F.col("n") + times).alias("n"), *[moved(f, x) for f, x in zip(FIELDS, "xy", strict=True)])

    same = F.struct("n", "x", "y")
    made = F.when(F.col("activity").isin(list(loops)), F.array(same, grown(1), grown(2))).otherwise(F.array(same))
    return upto.select(F.explode(made).alias("v")).select("v.*").distinct()


def coverage(variants: DataFrame, runs: DataFrame) -> DataFrame:
    """(executions, covered, share): how many executions (run) are among the traces, in percent.

    ``variants`` has (n, x, y), as ``variant_prints`` makes them, or ``activities``.
    """
    if "activities" in variants.columns:
        variants = run_prints(variants, "activities")
    held = run_prints(runs.select("run").distinct()).join(variants.select("n", "x", "y", F.lit(True).alias("found")).distinct(), ["n", "x", "y"], "left")
    counts = held.agg(F.count("*").alias("executions"), F.count("found").alias("covered"))
    return counts.select("executions", "covered", F.coalesce(F.try_divide(F.col("covered") * 100.0, "executions"), F.lit(0.0)).alias("share"))


def log_coverage(relations: DataFrame, runs: DataFrame, loops: list[str]) -> DataFrame:
    """``coverage`` of executions (run) by the loop variants of a log's traces; traces longer than the longest execution can't cover one and are left early."""
    longest = runs.agg(F.max(F.size("run"))).first()[0] or 0
    return coverage(variant_prints(relations, loops, longest), runs)


def log_metrics(relations: DataFrame, model: list[str]) -> DataFrame:
    """One row: traces, events, activities of the log, and the share of the model's activities that the log has.

    ``model`` is a set of activities; without any the share is 0.
    """
    names = sorted(set(model))
    known = F.count_distinct(F.when(F.col("activity").isin(names), F.col("activity")))
    share = (known / float(len(names))) if names else F.lit(0.0)
    return relations.agg(
        F.count_distinct("oid").alias("traces"), F.count_distinct("eid").alias("events"), F.count_distinct("activity").alias("activities"), share.alias("activity_precision")
    )
