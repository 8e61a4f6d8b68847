"""Cheapest repairs with prices and endpoints against exhaustive search, and on larger graphs."""

import itertools
import random
import time

from skeinflow.plans import repair as R
from skeinflow.plans.cuts import sequence_ok
from skeinflow.plans.graph import Network, Ways, bipartitions, closure, reach


def graphs(n, most=6):
    rng = random.Random(n)
    for _ in range(n):
        names = "abcdefg"[: rng.randrange(2, most + 1)]
        edges = {e: rng.randrange(1, 9) for e in itertools.product(names, repeat=2) if rng.random() < rng.choice([0.2, 0.4, 0.7])}
        costs = {e: float(rng.randrange(1, 100)) for e in itertools.permutations(names, 2)}
        yield set(names), edges, set(rng.sample(names, rng.randrange(1, len(names) + 1))), set(rng.sample(names, rng.randrange(1, len(names) + 1))), costs


def smallest_side(edges, names, a, b):
    """(value, side) of all minimum cuts between two nodes: the one all others contain."""
    cuts = [(sum(w for (x, y), w in edges.items() if x in p and y not in p), p) for p, q in bipartitions(names) if a in p and b in q]
    value = min(v for v, _ in cuts)
    return value, set.intersection(*(p for v, p in cuts if v == value))


def test_network_gives_the_smallest_side_and_can_be_used_again():
    for names, edges, *_ in graphs(60):
        net = Network(edges, names)
        for a, b in itertools.permutations(sorted(names), 2):
            value, side = smallest_side(edges, names, a, b)
            assert net.cut([a], [b]) == (value, side)
            assert (net.cut([a], [b], value - 1)[1] is None) == (value > 0) and net.cut([a], [b], value)[1] == side


def test_ways_equal_closure():
    for names, edges, *_ in graphs(60):
        ways, now = Ways(edges, names), dict(edges)
        for a, b in random.Random(1).sample(sorted(itertools.permutations(names, 2)), 2):
            assert {x: ways.bits(far) for x, far in closure(now, names).items()} == ways.far
            ways.add(a, b)
            now[a, b] = 1


def test_best_sequence_equals_its_definition():
    """Pair by pair with cuts by enumeration, and reachability searched anew for each edge."""
    for names, edges, _, _, costs in graphs(60):
        found = []
        for a, b in itertools.permutations(sorted(names), 2):
            removed = [e for e in edges if e[0] in (side := smallest_side(edges, names, a, b)[1]) and e[1] not in side] if b in reach(edges, a) else []
            now = {e: w for e, w in edges.items() if e not in removed}
            one = {x for x in names if b in reach(now, x)}
            two, added = names - one, []
            for e in itertools.product(sorted(one), sorted(two)):
                if e[1] not in reach(now, e[0]):
                    added.append(e)
                    now[e] = 1
            if two and sequence_ok(now, one, two):
                found.append((sum(edges[e] for e in removed) + sum(int(costs[e]) for e in added), abs(len(one) - len(two)), sorted(one), sorted(removed), sorted(added)))
        got = R.best_sequence(edges, names, costs)
        assert (got is None) == (not found)
        if found:
            assert (got.total_cost, abs(len(got.set1) - len(got.set2)), got.set1) == min(found)[:3]
            assert any((sorted(e[:2] for e in got.removed), sorted(e[:2] for e in got.added)) == f[3:] for f in found if f[:3] == min(found)[:3])


def test_best_sequence_by_removals_is_the_least_of_its_pairs():
    some = 0
    for names, edges, *_ in graphs(150):
        best = []
        for a, b in itertools.permutations(sorted(names), 2):
            if a in reach(edges, b):
                value, side = smallest_side(edges, names, b, a)
                if sequence_ok({e: w for e, w in edges.items() if not (e[0] in side and e[1] not in side)}, names - side, side):
                    best.append(value)
        got = R.best_sequence_cut(edges, names)
        assert (got is None) == (not best) and (got is None or got.total_cost == min(best))
        some += bool(best)
    assert some > 20


def test_best_parallel_with_prices_and_endpoints_equals_exhaustive():
    some = 0
    for names, edges, starts, ends, costs in graphs(150):
        def price(p, q, edges=edges, costs=costs):
            return sum(int(costs[e]) for a in p for b in q for e in ((a, b), (b, a)) if e not in edges)

        forced = [price(p, q) for p, q in bipartitions(names) if all(side & ends and side & starts for side in (p, q))]
        got = R.best_parallel(edges, names, starts, ends, costs)
        assert (got is None) == (not forced) and (got is None or got.total_cost == min(forced))
        some += bool(forced)
        free = R.best_parallel(edges, names, starts, ends, costs, force_endpoints=False)
        assert free.total_cost == min(price(p, q) for p, q in bipartitions(names))
    assert some > 50


def test_two_hundred_activities(spark):
    rng = random.Random(5)
    names = [f"a{i:03}" for i in range(200)]
    edges = {(a, b): rng.randrange(1, 20) for i, a in enumerate(names) for b in rng.sample(names[max(0, i - 8) : i + 9], 5) if a != b}
    costs = dict.fromkeys(itertools.permutations(names, 2), 50.0)
    begun = time.time()
    here = R.best_parallel(edges, set(names), set(names[:5]), set(names[-5:]), costs)
    assert here.total_cost == sum(c for *_, c in here.added)
    cut = R.best_sequence_cut(edges, set(names), spark)
    alone = R.best_exclusive(edges, set(names))
    assert cut is None or cut.total_cost >= 0 and sequence_ok(cut.apply(edges), set(cut.set1), set(cut.set2))
    assert 0 < alone.total_cost <= min(sum(w for (x, y), w in edges.items() if (x == n) != (y == n)) for n in names)
    assert time.time() - begun < 200


def test_pairs_in_tasks_equal_pairs_here(spark, monkeypatch):
    monkeypatch.setattr(R, "MANY", 2)
    monkeypatch.setattr(R, "SHARE", 7)
    for names, edges, _, _, costs in list(graphs(60))[:4]:
        assert R.best_sequence(edges, names, costs, spark) == R.best_sequence(edges, names, costs)
        assert R.best_sequence_cut(edges, names, spark) == R.best_sequence_cut(edges, names)
