"""The cheapest change of a graph's edges that makes a cut of each kind hold."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import SparkSession

from skeinflow.plans.cuts import exclusive_ok, local_endpoints, parallel_ok, redo_ok, sequence_ok
from skeinflow.plans.graph import INFINITE, Edges, Network, Ways, closure, induced, reach

ABSENT = 999_999


@dataclass
class Suggestion:
    cut_type: str
    set1: list[str]
    set2: list[str]
    added: list[tuple[str, str, int]] = field(default_factory=list)
    removed: list[tuple[str, str, int]] = field(default_factory=list)

    @property
    def total_cost(self) -> int:
        return sum(e[2] for e in self.added + self.removed)

    def apply(self, edges: Edges) -> Edges:
        gone = {e[:2] for e in self.removed}
        return {e: w for e, w in edges.items() if e not in gone} | {(a, b): 1 for a, b, _ in self.added}


def _made(kind: str, one, two, added, removed, edges: Edges, costs: Edges) -> Suggestion:
    price = [(a, b, int(costs.get((a, b), ABSENT))) for a, b in sorted(added)]
    return Suggestion(kind, sorted(one), sorted(two), price, [(a, b, int(edges[a, b])) for a, b in sorted(removed)])


def _best(found: Iterable[Suggestion]) -> Suggestion | None:
    """Least cost, then the most even split, then the smallest first set."""
    return min(found, key=lambda s: (s.total_cost, abs(len(s.set1) - len(s.set2)), s.set1), default=None)


#: Activities from which on pairs are dealt to Spark tasks, and pairs of a task.
MANY, SHARE = 60, 500


def _of_pairs(spark: SparkSession | None, names: set[str], cheapest) -> Suggestion | None:
    """The best of ``cheapest(pairs)`` over all ordered pairs of activities: in tasks if there are many, each returning its own best."""
    ordered = sorted(names)
    n = len(ordered)
    if spark is None or n < MANY:
        return cheapest(itertools.permutations(ordered, 2))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = (int(i) for batch in batches for i in batch["id"])
        best = cheapest((ordered[i // n], ordered[i % n]) for i in numbers if i // n != i % n)
        yield pd.DataFrame({"found": [json.dumps(vars(best))] if best else []}, dtype=object)

    rows = spark.range(0, n * n, 1, -(-n * n // SHARE)).mapInPandas(run, "found string").collect()  # one a task
    read = (json.loads(r.found) for r in rows)
    return _best([Suggestion(**{**x, "added": [tuple(e) for e in x["added"]], "removed": [tuple(e) for e in x["removed"]]}) for x in read])


def best_exclusive(edges: Edges, names: set[str]) -> Suggestion | None:
    """An exact minimum cut of the symmetric weights, over all sinks for one source."""
    if len(names) < 2:
        return None
    both: Edges = {}
    for (a, b), w in edges.items():
        if a != b:
            both[a, b] = both.get((a, b), 0) + w
            both[b, a] = both.get((b, a), 0) + w
    net, (first, *rest) = Network(both, names), sorted(names)
    found, least = [], INFINITE
    for t in rest:
        for s, e in ((first, t), (t, first)):
            value, side = net.cut([s], [e], least)
            if side is not None:
                least = value
                removed = [x for x in edges if (x[0] in side) != (x[1] in side)]
                found.append(_made("exclusive", side, names - side, [], removed, edges, {}))
    return _best(found)


def best_sequence(edges: Edges, names: set[str], costs: Edges, spark: SparkSession | None = None) -> Suggestion | None:
    """For each ordered pair: cut the way from a to b; the first set is what still leads to b; missing ways are added in alphabetical order.

    A pair whose cut alone costs more than the best so far is left at once.
    """
    inside = {e: w for e, w in edges.items() if e[0] in names and e[1] in names}

    def cheapest(pairs: Iterable[tuple[str, str]]) -> Suggestion | None:
        net, whole, best, seen = Network(inside, names), Ways(inside, names), None, set()
        for a, b in pairs:
            removed = frozenset()
            if whole.far[a] & whole.bit[b]:
                side = net.cut([a], [b], best.total_cost if best else INFINITE)[1]
                if side is None:
                    continue
                removed = frozenset(e for e in inside if e[0] in side and e[1] not in side)
            if (removed, b) in seen:
                continue
            seen.add((removed, b))
            now = Ways(inside.keys() - removed, names)
            one = {x for x in names if now.far[x] & now.bit[b]}
            two = names - one
            if not two:
                continue
            added = []
            for s1, s2 in itertools.product(sorted(one), sorted(two)):
                if not now.far[s1] & now.bit[s2]:
                    added.append((s1, s2))
                    now.add(s1, s2)
            if now.ordered(one, two):
                best = _best([x for x in (best, _made("sequence", one, two, added, removed, edges, costs)) if x])
        return best

    return _of_pairs(spark, names, cheapest)


def best_sequence_cut(edges: Edges, names: set[str], spark: SparkSession | None = None) -> Suggestion | None:
    """The cheapest sequence cut by removals alone: of all minimum cuts between an activity and one it reaches, those after which every activity of the first set still reaches all of the second."""
    inside = {e: w for e, w in edges.items() if e[0] in names and e[1] in names}

    def cheapest(pairs: Iterable[tuple[str, str]]) -> Suggestion | None:
        net, whole, best = Network(inside, names), Ways(inside, names), None
        for a, b in pairs:
            if not whole.far[b] & whole.bit[a]:
                continue
            side = net.cut([b], [a], best.total_cost if best else INFINITE)[1]  # what stays behind: the second set
            if side is None:
                continue
            removed = {e for e in inside if e[0] in side and e[1] not in side}
            if Ways(inside.keys() - removed, names).ordered(names - side, side):
                best = _best([x for x in (best, _made("sequence", names - side, side, [], removed, edges, {})) if x])
        return best

    return _of_pairs(spark, names, cheapest)


def best_parallel(edges: Edges, names: set[str], starts: set[str], ends: set[str], costs: Edges, force_endpoints: bool = True, unit_cost: bool = False) -> Suggestion | None:
    """A minimum cut of the graph of what is missing, with a start and an end tied to each side.

    One start lies on some side, and so does one end: either both on one, or on
    different ones.  It is enough to try the others as their partners and rivals,
    2 (starts - 1) (ends - 1) flows, or one flow for each other activity if no
    start and end are asked for.
    """
    missing: Edges = {}
    for a, b in itertools.combinations(sorted(names), 2):
        absent = [e for e in ((a, b), (b, a)) if e not in edges]
        if absent:
            missing[a, b] = missing[b, a] = len(absent) if unit_cost else sum(int(costs.get(e, 1.0)) for e in absent)
    if force_endpoints:
        (s1, *other_starts), (e1, *other_ends) = sorted(starts) or [None], sorted(ends) or [None]
        seeds = [
            (one, two) for s2 in other_starts for e2 in other_ends for one, two in (({s1, e1}, {s2, e2}), ({s1, e2}, {s2, e1}))
            if not one & two
        ]
    else:
        first, *rest = sorted(names)
        seeds = [({first}, {b}) for b in rest]
    priced = unit_cost or all(e in costs for pair in missing for e in (pair, pair[::-1]) if e not in edges)  # else capacities are not what is reported
    net, found, least = Network(missing, names), [], INFINITE
    for one, two in seeds:
        value, side = net.cut(one, two, least)
        if side is None:
            continue
        least = value if priced else INFINITE
        other = names - side
        added = [e for a in side for b in other for e in ((a, b), (b, a)) if e not in edges]
        price = dict.fromkeys(added, 1) if unit_cost else costs
        found.append(_made("parallel", side, other, added, [], edges, price))
    return _best(found)


def _bypasses(edges: Edges, x: str, side: set[str], fixed: set[str]) -> set[tuple[str, str]]:
    """Missing edges c -> d for c -> x -> d, if both are in the side, or one is and the other starts or ends."""
    before, after = {a for a, b in edges if b == x}, {b for a, b in edges if a == x}
    reach_of = side | fixed
    pairs = ((c, d) for c in before & reach_of for d in after & reach_of)
    return {(c, d) for c, d in pairs if (c in side or d in side) and (c, d) not in edges}


def _crossing(edges: Edges, one: set[str], two: set[str], fixed: set[str]) -> set[tuple[str, str]]:
    """Edges between body and redo part whose ends neither start nor end."""
    return {(a, b) for a, b in edges if a not in fixed and b not in fixed and (a in one and b in two or a in two and b in one)}


def best_redo(edges: Edges, names: set[str], starts: set[str], ends: set[str], costs: Edges) -> Suggestion | None:
    """Split what neither starts nor ends into body and redo part, one activity after another in alphabetical order.

    An activity only on the way from starts to ends joins the body, one only on
    the way back the redo part.  On both, it goes where it cannot be spared: to
    the body if only starts no longer reach ends without it, to the redo part if
    only the way back breaks.  If that does not decide, the cheaper place is
    taken, and the redo part at equal price: the other side gets edges that
    bypass the activity, and edges across are removed.  Ends and starts that the
    redo part does not follow or lead to then get their cheapest edge.
    """
    far = closure(edges, names)
    if not starts or not ends or not all(e in far[s] and s in far[e] for s in starts for e in ends):
        return None
    fixed, now = starts | ends, dict(edges)
    one, two = set(fixed), set()
    added: dict[tuple[str, str], float] = {}
    removed: set[tuple[str, str]] = set()

    def way(sources: set[str], x: str, others: set[str]) -> bool:
        return any(x in reach(now, s, others) for s in sources)

    def broken(without: Edges, sources: set[str], targets: set[str]) -> bool:
        return any(t not in reach(without, s) for s in sources for t in targets)

    def trial(x: str, to_body: bool) -> tuple[int, set, set]:
        body, again = (one | {x}, two) if to_body else (one, two | {x})
        new = _bypasses(now, x, two if to_body else one, fixed)
        gone = _crossing({**now, **dict.fromkeys(new, 1)}, body, again, fixed)
        price = {e: int(costs.get(e, ABSENT)) for e in new}
        return sum(price.values()) + int(sum(price.get(e, now.get(e, 0)) for e in gone)), new, gone

    for x in sorted(names - fixed):
        ahead, back = way(starts, x, ends), way(ends, x, starts)
        if not ahead and not back:
            return None
        new: set[tuple[str, str]] = set()
        to_body = ahead
        if ahead and back:
            left = {e: w for e, w in now.items() if x not in e}
            lost, lost_back = broken(left, starts, ends), broken(left, ends, starts)
            to_body = lost
            if lost == lost_back:
                for_body, for_redo = trial(x, True), trial(x, False)
                to_body = for_body[0] < for_redo[0]
                new = (for_body if to_body else for_redo)[1]
        (one if to_body else two).add(x)
        added |= {e: costs.get(e, ABSENT) for e in new}
        now |= {e: int(costs.get(e, ABSENT)) for e in new}
        gone = _crossing(now, one, two, fixed)
        removed |= gone
        now = {e: w for e, w in now.items() if e not in gone}
    if not two:
        return None
    for e in sorted(ends):
        if not any((e, x) in now for x in two):
            added[min(((e, x) for x in two), key=lambda p: (costs.get(p, ABSENT), p))] = 0
    for s in sorted(starts):
        if not any((x, s) in now for x in two):
            added[min(((x, s) for x in two), key=lambda p: (costs.get(p, ABSENT), p))] = 0
    # an edge that was added and then fell between the parts is neither
    return _made("redo", one, two, set(added) - removed, removed & set(edges), edges, costs)


def suggest(edges: Edges, names: set[str], starts: set[str], ends: set[str], costs: Edges, spark: SparkSession | None = None) -> list[Suggestion]:
    """For a flower: the cheapest exclusive, sequence, parallel and redo cut that hold after their repair."""
    starts, ends = local_endpoints(edges, names, starts, ends)
    own = induced(edges, names)
    out = []
    for s in (
        best_exclusive(own, names), best_sequence(own, names, costs, spark), best_parallel(own, names, starts, ends, costs), best_redo(own, names, starts, ends, costs)
    ):
        if s is None or not s.set1 or not s.set2:
            continue
        now, one, two = s.apply(own), set(s.set1), set(s.set2)
        holds = {
            "exclusive": lambda: exclusive_ok(now, one, two), "sequence": lambda: sequence_ok(now, one, two),
            "parallel": lambda: parallel_ok(now, one, two, starts, ends), "redo": lambda: redo_ok(now, one, two, starts, ends),
        }[s.cut_type]
        if holds():
            out.append(s)
    return out
