"""Discovery sessions: a log's graph and tree, repairs, undo, self-loops and scores."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from skeinflow.operators import dfg as D
from skeinflow.operators import traces as T
from skeinflow.operators.dfg import MOST_ACTIVITIES
from skeinflow.operators.order import in_order
from skeinflow.operators.relations import patterns
from skeinflow.plans.automaton import Automata, walk
from skeinflow.plans.cuts import discover
from skeinflow.plans.graph import Edges
from skeinflow.plans.repair import Suggestion, suggest
from skeinflow.plans.tree import TAU, Node, collapse, descendants, open_flower, relations_of, replace_flowers, replay_greedily, rules
from skeinflow.sources.scratch import keep, lean


@dataclass
class Session:
    relations: DataFrame
    patterns: DataFrame
    steps: DataFrame
    edges: Edges
    activities: set[str]
    starts: set[str]
    ends: set[str]
    tree: Node | None
    endpoints: set[tuple[str, str, str]]
    costs: Edges = field(default_factory=dict)
    journal: dict[str, Suggestion] = field(default_factory=dict)

    @classmethod
    def open(cls, relations: DataFrame, noise: float = 0.0, remove: tuple[str, ...] = ()) -> Session:
        """Graph, endpoints and tree of a log; noise and removals act on the graph, not on endpoints."""
        relations = keep(relations, "relations")
        held = keep(patterns(relations), "patterns")
        names = {r.activity for r in held.select("activity").distinct().limit(MOST_ACTIVITIES + 1).collect()}
        if len(names) > MOST_ACTIVITIES:
            raise ValueError(f"more than {MOST_ACTIVITIES} activities")
        with lean(relations.sparkSession):
            kinds = D.endpoints(relations, True).collect()  # at most activities times types
        steps = keep(D.dfg_by_type(relations), "steps")
        graph = D.drop_activities(D.reduce_noise(D.dfg(relations, held, steps), noise), list(remove))
        edges = {(r.source, r.target): int(r.weight) for r in graph.collect()}
        names -= set(remove)
        starts, ends = {r.activity for r in kinds if r.is_start}, {r.activity for r in kinds if r.is_end}
        kinds = {(r.otype, r.activity, s) for r in kinds for s in ("start", "end") if r[f"is_{s}"]}
        return cls(relations, held, steps, edges, names, starts, ends, discover(edges, names, starts, ends), kinds)

    @property
    def perfectly_cut(self) -> bool:
        return self.tree is None or open_flower(self.tree) is None

    def _graph(self) -> DataFrame:
        return self.relations.sparkSession.createDataFrame([(a, b, int(w)) for (a, b), w in sorted(self.edges.items())], "source string, target string, weight long")

    def add_costs(self, kind: str = "curve") -> Edges:
        """What each missing edge costs to add, kept for the session."""
        if not self.costs:
            kept, gone = T.kept_relations(self.relations, self.patterns), D.missing_edges(self._graph())
            table = T.curve_cost(gone, kept) if kind == "curve" else T.order_cost(gone, kept)
            self.costs = {(r.source, r.target): r.cost for r in table.collect()}
        return self.costs

    def suggestions(self) -> list[Suggestion]:
        """Repairs for the first flower; none if there is no flower."""
        found = open_flower(self.tree) if self.tree else None
        return suggest(self.edges, found[1], self.starts, self.ends, self.add_costs(), self.relations.sparkSession) if found else []

    def select(self, choice: Suggestion) -> Session:
        """Apply a repair: change the graph, and replace the flower by the cut's node."""
        self.edges = choice.apply(self.edges)
        names = set(choice.set1) | set(choice.set2)
        node = Node(choice.cut_type, [discover(self.edges, part, self.starts, self.ends) for part in (choice.set1, choice.set2)])
        path = next(p for p, n in self.tree.walk() if n.label == "flower" and {c.label for c in n.children} == names)
        self.tree = replace_flowers(self.tree, names, node)
        self.journal[path] = choice
        self.costs = {e: c for e, c in self.costs.items() if e not in {a[:2] for a in choice.added}}
        return self

    def modify(self, path: str) -> Session:
        """Reopen a subtree: undo the repairs made below it, and make it a flower."""
        for p in descendants(self.tree, path):
            if (made := self.journal.pop(p, None)) is not None:
                self.edges = {e: w for e, w in self.edges.items() if e not in {a[:2] for a in made.added}} | {(a, b): w for a, b, w in made.removed}
                self.costs |= {(a, b): float(c) for a, b, c in made.added}
        self.tree, _ = collapse(self.tree, path)
        return self

    def totals(self) -> tuple[int, int]:
        """Edges removed and added so far."""
        return sum(len(s.removed) for s in self.journal.values()), sum(len(s.added) for s in self.journal.values())

    def with_self_loops(self, corrected: bool = False) -> Node | None:
        """The tree with each activity that follows itself wrapped: ``redo(a, tau)`` if every trace of its context has it, else ``redo(tau, a)``.

        The context in a sequence or parallel node is the traces with a sibling's
        activity; in an exclusive node those of the other branch of the nearest
        ancestor of another kind (all if there is none), without traces of the
        ancestor's first branch or of siblings.  The first branch is taken for the
        activity's own and the second for the other, wherever the activity is; with
        ``corrected``, its own is the one it lies in, and all others count as the
        other.  One aggregation answers for all.
        """
        if self.tree is None:
            return None
        loops = {a for a, b in self.edges if a == b}
        nodes = dict(self.tree.walk())
        asked = {}
        for path, n in nodes.items():
            parent = nodes.get(path.rpartition(".")[0])
            if n.children or n.label not in loops or parent is None or parent.label in ("redo", "flower"):
                continue
            near = set().union(set(), *(c.activities() for c in parent.children if c is not n))
            if parent.label != "exclusive":
                asked[path] = (n.label, near, None)
                continue
            up = path.rpartition(".")[0]
            while up and nodes[up].label == "exclusive":
                up = up.rpartition(".")[0]
            if up and len(nodes[up].children) > 1:
                branches = [c.activities() for c in nodes[up].children]
                own = int(path[len(up) + 1 :].partition(".")[0]) if corrected else 0
                other = set().union(*(b for i, b in enumerate(branches) if i != own)) if corrected else branches[1]
                asked[path] = (n.label, other, branches[own] | near)
            else:
                asked[path] = (n.label, None, near)
        tree = self.tree
        if asked:
            held = T.kept_relations(self.relations, self.patterns).groupBy("oid").agg(F.collect_set("activity").alias("acts"))

            def touches(names: set[str]):
                return F.arrays_overlap("acts", F.array(*[F.lit(x) for x in sorted(names)])) if names else F.lit(False)

            counts = []
            for i, (label, some, none) in enumerate(asked.values()):
                inside = F.lit(True) if some is None else touches(some)
                if none:
                    inside &= ~touches(none - {label})
                counts.append(F.count_if(inside & ~F.array_contains("acts", label)).alias(f"without{i}"))
            lacking = held.agg(*counts).first()
            for i, (path, (label, *_)) in enumerate(asked.items()):
                pair = [Node(TAU), Node(label)] if lacking[i] else [Node(label), Node(TAU)]
                tree = tree.replace(path, Node("redo", pair))
        return tree

    def replay(self, tree: Node | None = None) -> tuple[float, float, float]:
        """(fitness, precision, F) by the tree's executions, each projected to the activities of a type's traces."""
        return scores(keep(T.kept_relations(self.relations, self.patterns), "kept"), [tree or self.tree])[0]

    def violation_rate(self, tree: Node | None = None) -> float:
        """The share of traces, in percent, that break a rule of the tree's upper sequence and exclusive nodes."""
        r = T.rule_violations(T.kept_relations(self.relations, self.patterns), rules(tree or self.tree)).first()
        return r.violating * 100.0 / r.traces if r.traces else 0.0

    def conformance(self, tree: Node | None = None) -> tuple[float, float, float]:
        """(fitness, precision, F) by abstractions.

        For each object type the starts, ends and steps of its traces are held
        against those of the tree projected to the type's activities, and the
        log's patterns (activity, type, kind) against those that the tree's leaves
        carry, which are the log's own of the tree's activities.  Fitness is the
        common share of the log's, precision of the tree's.
        """
        tree = tree or self.tree
        steps = {(r.otype, r.source, r.target) for r in self.steps.collect()}
        related: dict[str, set[str]] = {}
        held = set()
        for r in self.patterns.collect():
            related.setdefault(r.otype, set()).add(r.activity)
            held |= {("pattern", r.activity, r.otype, kind) for kind in ("related", "divergent", "convergent", "deficient") if r[kind]}
        leaves = tree.activities()
        log, model = self.endpoints | steps | held, {p for p in held if p[1] in leaves}
        for otype, names in related.items():
            s, e, f, _ = relations_of(project(tree, names))
            model |= {(otype, a, "start") for a in s} | {(otype, a, "end") for a in e} | {(otype, a, b) for a, b in f}
        common = len(log & model)
        return f_score(common / len(log) if log else 0.0, common / len(model) if model else 0.0)


def project(tree: Node, names: set[str]) -> Node:
    """The tree with other activities silent."""
    if not tree.children:
        return tree if tree.label in names else Node(TAU)
    if tree.label == "flower":
        return Node("flower", [c for c in tree.children if c.label in names] or [Node(TAU)])
    return Node(tree.label, [project(c, names) for c in tree.children])


def f_score(fitness: float, precision: float) -> tuple[float, float, float]:
    both = fitness + precision
    return fitness, precision, 2 * fitness * precision / both if both else 0.0


def known_types(kept: DataFrame) -> dict[str, list[str]]:
    """The activities of each object type; more than ``MOST_ACTIVITIES`` squared pairs are an error."""
    with lean(kept.sparkSession):
        known = kept.select("otype", "activity").distinct().limit(MOST_ACTIVITIES**2 + 1).collect()
    if len(known) > MOST_ACTIVITIES**2:
        raise ValueError(f"more than {MOST_ACTIVITIES**2} pairs of type and activity")
    types: dict[str, list[str]] = {}
    for r in known:
        types.setdefault(r.otype, []).append(r.activity)
    return {k: sorted(v) for k, v in sorted(types.items())}


def score_table(kept: DataFrame, runs: DataFrame, by: list[str] = ()) -> DataFrame:
    """(executions, fitting_executions, traces, fitting_traces) of candidate executions against a log, for each key of ``by``.

    Traces have repeats collapsed; those that still hold an activity twice fit
    nothing, but count.  Traces and executions meet by length and fingerprints.
    """
    prints = keep(T.trace_prints(kept), "prints")

    def projected(names: list[str]):
        return F.filter("run", lambda x: x.isin(names))

    each = F.array(*[projected(names) for names in known_types(kept).values()] or [F.array().cast("array<string>")])
    own = T.run_prints(runs.select(*by, F.explode(each).alias("run")).where("size(run) > 0").distinct())
    single = prints.where("single").groupBy("n", "x", "y").agg(F.count("*").alias("m"))
    fit = own.join(single, ["n", "x", "y"], "left").groupBy(*by).agg(F.count("*").alias("executions"), F.count("m").alias("fitting_executions"), F.coalesce(F.sum("m"), F.lit(0)).alias("fitting_traces"))
    return fit.withColumn("traces", F.lit(prints.count()))


def accepted_table(kept: DataFrame, trees: list[Node]) -> DataFrame:
    """(candidate, executions, fitting_executions, traces, fitting_traces) of all executions of each tree, however many.

    Executions are counted in an automaton, on which the traces run; their number
    is a double.  Traces without a repeated activity are as long as there are
    activities at most; one object of each distinct one is looked up, and only its
    events are put in a row.  Candidates are numbered from 0 and judged in one pass.
    """
    spark = kept.sparkSession
    prints, types = keep(T.trace_prints(kept), "prints"), known_types(kept)
    tables, sizes = [], []
    for i, tree in enumerate(trees):
        machine = Automata()
        whole = machine.of(tree)
        own = machine.without_empty(machine.union(machine.project(whole, names) for names in types.values()))
        tables.append(machine.table(own))
        sizes.append((i, float(machine.count(own))))
    single = keep(prints.where("single").groupBy("n", "x", "y").agg(F.count("*").alias("m"), F.min(F.struct("oid", "otype")).alias("o")).select("m", "o.*"), "distinct")
    steps = in_order(kept.join(single.select("oid", "otype"), ["oid", "otype"], "left_semi"), ("oid", "otype")).where((F.col("pos") == 1) | ~F.col("before.activity").eqNullSafe(F.col("activity")))
    rows = steps.groupBy("oid", "otype").agg(F.array_sort(F.collect_list(F.struct("run", "activity"))).alias("steps"))  # at most as many as activities

    @F.pandas_udf("array<int>")
    def fitting(traces: pd.Series) -> pd.Series:
        return traces.map(lambda names: [i for i, t in enumerate(tables) if walk(t, names)])

    fit = rows.select("oid", "otype", F.explode(fitting(F.transform("steps", lambda s: s["activity"]))).alias("candidate")).join(single, ["oid", "otype"])
    found = fit.groupBy("candidate").agg(F.count("*").alias("fitting_executions"), F.sum("m").alias("fitting_traces"))
    every = spark.createDataFrame(sizes, "candidate int, executions double").join(found, "candidate", "left")
    return every.select("candidate", "executions", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fitting_executions", "fitting_traces")], F.lit(prints.count()).alias("traces"))


def greedy_table(runs: DataFrame, tree: Node) -> DataFrame:
    """(traces, fitting) of a table of traces (activities) replayed greedily on a tree.

    A trace fits if all went on and every event was used, or if nothing was
    missed and some event was used.  Equal traces are replayed once.
    """

    @F.pandas_udf("boolean")
    def fits(names: pd.Series) -> pd.Series:
        def fit(trace) -> bool:
            fine, used, missed = replay_greedily(tree, list(trace))
            return fine and used == len(trace) or used > 0 and missed == 0

        return names.map(fit)

    once = runs.groupBy("activities").agg(F.count("*").alias("n"))
    marked = once.select("n", F.when(fits("activities"), F.col("n")).otherwise(0).alias("fit"))
    return marked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("traces"), F.coalesce(F.sum("fit"), F.lit(0)).alias("fitting"))


def metrics(relations: DataFrame, tree: Node) -> DataFrame:
    """One row: ``log_metrics`` of the tree's activities, and the fitness of greedy replay."""
    r = greedy_table(T.traces(relations), tree).first()
    return T.log_metrics(relations, sorted(tree.activities())).withColumn("fitness", F.lit(r.fitting / r.traces if r.traces else 0.0))


def metrics_text(row: Row) -> str:
    """The metrics as lines of text."""
    return "\n".join(f"{k}: {v:.4f}" if isinstance(v, float) else f"{k}: {v}" for k, v in row.asDict().items())


def scores(kept: DataFrame, trees: list[Node]) -> list[tuple[float, float, float]]:
    """(fitness, precision, F) of each tree."""
    rows = accepted_table(kept, trees).orderBy("candidate").collect()  # one for each tree
    return [f_score(r.fitting_traces / r.traces if r.traces else 0.0, r.fitting_executions / r.executions if r.executions else 0.0) for r in rows]


def enumerate_trees(session: Session, most: int = 200) -> list[tuple[Node, tuple[str, ...], tuple[float, float, float]]]:
    """Every tree that some sequence of repairs leads to, with the kinds chosen and its replay scores, best first.

    Trees with an open flower for which nothing can be suggested are kept.  More
    than ``most`` are an error.
    """
    costs = session.add_costs("order")
    todo, done = [(session.edges, session.tree, ())], []
    while todo:
        edges, tree, chosen = todo.pop()
        found = open_flower(tree)
        options = suggest(edges, found[1], session.starts, session.ends, costs, session.relations.sparkSession) if found else []
        if not options:
            done.append((tree, chosen))
        for s in options:
            now = s.apply(edges)
            node = Node(s.cut_type, [discover(now, part, session.starts, session.ends) for part in (s.set1, s.set2)])
            todo.append((now, replace_flowers(tree, found[1], node), (*chosen, s.cut_type)))
        if len(todo) + len(done) > most:
            raise ValueError(f"more than {most} trees")
    marks = scores(keep(T.kept_relations(session.relations, session.patterns), "kept"), [t for t, _ in done])
    return sorted(((t, c, m) for (t, c), m in zip(done, marks, strict=True)), key=lambda x: tuple(-v for v in x[2]))
