"""Cut detection and the discovery of a process tree.

Ties are broken alphabetically, so equal inputs give equal trees.
"""

from __future__ import annotations

from collections.abc import Iterable

from skeinflow.plans.graph import Edges, bipartitions, closure, components, induced, reach, strong_components
from skeinflow.plans.tree import Node

Parts = tuple[set[str], set[str]]


def local_endpoints(edges: Edges, names: set[str], starts: set[str], ends: set[str]) -> Parts:
    """Starts: inherited, or entered from outside; ends: inherited, or left for the outside."""
    entered = {b for a, b in edges if b in names and a not in names}
    left = {a for a, b in edges if a in names and b not in names}
    return (starts & names) | entered, (ends & names) | left


def exclusive_ok(edges: Edges, one: set[str], two: set[str]) -> bool:
    return not any((a in one) != (b in one) for a, b in edges if a in one | two and b in one | two)


def sequence_ok(edges: Edges, one: set[str], two: set[str]) -> bool:
    far = closure(edges, one | two)
    return all(b in far[a] and a not in far[b] for a in one for b in two)


def parallel_ok(edges: Edges, one: set[str], two: set[str], starts: set[str], ends: set[str]) -> bool:
    sides = all(part & starts and part & ends for part in (one, two))
    return sides and all((a, b) in edges and (b, a) in edges for a in one for b in two)


def redo_ok(edges: Edges, one: set[str], two: set[str], starts: set[str], ends: set[str]) -> bool:
    if not starts <= one or not ends <= one or not starts or not ends or not two:
        return False
    return all(any((e, x) in edges for x in two) for e in ends) and all(any((x, s) in edges for x in two) for s in starts)


def exclusive_cut(edges: Edges, names: set[str]) -> Parts | None:
    parts = components(edges, names)
    return (parts[0], names - parts[0]) if len(parts) > 1 else None


def sequence_cut(edges: Edges, names: set[str]) -> Parts | None:
    """Strong components with edges out only come first, those with edges in only second, the others where they fit."""
    groups = strong_components(edges, names)
    if len(groups) < 2:
        return None
    where = {n: i for i, g in enumerate(groups) for n in g}
    steps = {(where[a], where[b]) for a, b in edges if a in where and b in where and where[a] != where[b]}
    sources, targets = {a for a, _ in steps}, {b for _, b in steps}
    one, two = sources - targets, targets - sources
    far = closure(edges, names)
    for g in range(len(groups)):  # topological order
        if g in sources and g in targets:
            member = min(groups[g])
            late = all(member in far[min(groups[o])] and min(groups[o]) not in far[member] for o in one)
            (two if late else one).add(g)
    parts = tuple(set().union(*(groups[i] for i in side)) if side else set() for side in (one, two))
    return parts if all(parts) else None


def parallel_cut(edges: Edges, names: set[str]) -> Parts | None:
    def tied(x: str, side: set[str]) -> bool:
        return all((x, y) in edges and (y, x) in edges for y in side)

    one, two = set(), set()
    for x in sorted(names):
        if one and tied(x, one):
            two.add(x)
        elif not two or tied(x, two):
            one.add(x)
        else:
            return None
    return (one, two) if two else None


def redo_cut(edges: Edges, names: set[str], starts: set[str], ends: set[str]) -> Parts | None:
    body, again = starts | ends, set()
    ahead = set().union(*(reach(edges, s, ends, True) for s in starts))
    back = set().union(*(reach(edges, e, starts, True) for e in ends))
    for x in sorted(names - body):
        if (x in ahead) == (x in back):
            return None
        (body if x in ahead else again).add(x)
    return (body, again) if again else None


def find_cut(edges: Edges, names: set[str], starts: set[str], ends: set[str], exhaustive: bool = False) -> tuple[str, set[str], set[str]] | None:
    """The first of exclusive, sequence, parallel and redo that holds, with its two sets; all arguments are local."""
    checks = {
        "exclusive": lambda a, b: exclusive_ok(edges, a, b), "sequence": lambda a, b: sequence_ok(edges, a, b),
        "parallel": lambda a, b: parallel_ok(edges, a, b, starts, ends), "redo": lambda a, b: redo_ok(edges, a, b, starts, ends),
    }
    if exhaustive:
        if len(names) > 15:
            raise ValueError("exhaustive search is for 15 activities at most")
        return next(((k, a, b) for k, ok in checks.items() for a, b in bipartitions(names) if ok(a, b)), None)
    finders = {
        "exclusive": lambda: exclusive_cut(edges, names), "sequence": lambda: sequence_cut(edges, names),
        "parallel": lambda: parallel_cut(edges, names), "redo": lambda: redo_cut(edges, names, starts, ends),
    }
    for kind, find in finders.items():
        parts = find()
        if parts and checks[kind](*parts):
            return kind, *parts
    return None


def discover(edges: Edges, names: Iterable[str], starts: Iterable[str], ends: Iterable[str], exhaustive: bool = False) -> Node | None:
    """The process tree: cuts as long as one holds, else a flower of what is left.  No activities give None."""
    names, starts, ends = set(names), set(starts), set(ends)
    if not names:
        return None
    if len(names) == 1:
        return Node(next(iter(names)))
    local = local_endpoints(edges, names, starts, ends)
    cut = find_cut(induced(edges, names), names, *local, exhaustive=exhaustive)
    if cut is None:
        return Node("flower", [Node(n) for n in sorted(names)])
    kind, one, two = cut
    return Node(kind, [discover(edges, part, *local, exhaustive=exhaustive) for part in (one, two)])
