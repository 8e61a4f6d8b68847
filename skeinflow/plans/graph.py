"""Small weighted digraphs: a graph is a dict (source, target) -> weight."""

from __future__ import annotations

import itertools
from collections import defaultdict, deque
from collections.abc import Iterable

Edges = dict[tuple[str, str], float]
INFINITE = float("inf")


def induced(edges: Edges, names: Iterable[str]) -> Edges:
    names = set(names)
    return {e: w for e, w in edges.items() if e[0] in names and e[1] in names}


def reach(edges: Edges, start: str, avoid: Iterable[str] = (), stop_at_start: bool = False) -> set[str]:
    """What ``start`` reaches, itself included; a node of ``avoid`` is reached but not left.

    The start is left even if it is in ``avoid``, unless ``stop_at_start``.
    """
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    avoid, seen, todo = set(avoid), {start}, deque([start])
    while todo:
        a = todo.popleft()
        if a in avoid and (a != start or stop_at_start):
            continue
        for b in out[a]:
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def closure(edges: Edges, names: Iterable[str]) -> dict[str, set[str]]:
    return {n: reach(edges, n) for n in names}


def components(edges: Edges, names: Iterable[str]) -> list[set[str]]:
    """Weakly connected components, each by its smallest member first."""
    both = {**edges, **{(b, a): w for (a, b), w in edges.items()}}
    out, left = [], sorted(names)
    while left:
        part = reach(both, left[0]) & set(left)
        out.append(part)
        left = [n for n in left if n not in part]
    return out


def strong_components(edges: Edges, names: Iterable[str]) -> list[set[str]]:
    """Strongly connected components by mutual reachability, in topological and then alphabetical order."""
    names = sorted(names)
    far = closure(edges, names)
    groups: dict[str, set[str]] = {}
    for n in names:
        root = min(m for m in far[n] if m in far and n in far[m])
        groups.setdefault(root, set()).add(n)
    left, out = dict(sorted(groups.items())), []
    while left:
        free = next(r for r in left if not any(r in far[o] for o in left if o != r))
        out.append(left.pop(free))
    return out


class Network:
    """Capacities between numbered nodes, for many cuts of one graph; layers by breadth, then blocking paths."""

    def __init__(self, capacity: Edges, names: Iterable[str] = ()):
        self.names = sorted({*names, *(x for e in capacity for x in e)})
        self.number = {x: i for i, x in enumerate(self.names)}
        self.out: list[list[int]] = [[] for _ in range(len(self.names) + 2)]  # arcs of each node; two nodes tie sources and sinks together
        self.head: list[int] = []
        self.full: list[float] = []
        for (x, y), w in sorted(capacity.items()):
            if x != y and w > 0:
                self._arc(self.number[x], self.number[y], w)

    def _arc(self, a: int, b: int, w: float) -> None:
        for x, y, c in ((a, b, w), (b, a, 0)):
            self.out[x].append(len(self.head))
            self.head.append(y)
            self.full.append(c)

    def cut(self, sources: Iterable[str], sinks: Iterable[str], most: float = INFINITE) -> tuple[float, set[str] | None]:
        """(value, smallest source side) of a minimum cut; the side is None as soon as the value exceeds ``most``."""
        sources, sinks = sorted(set(sources)), sorted(set(sinks))
        start, end, arcs = len(self.names), len(self.names) + 1, len(self.head)
        for x in sources:
            self._arc(start, self.number[x], INFINITE)
        for x in sinks:
            self._arc(self.number[x], end, INFINITE)
        try:
            return self._flow(start, end, most)
        finally:
            for _ in range(arcs, len(self.head), 2):
                self.out[self.head[-1]].pop()
                self.out[self.head[-2]].pop()
                del self.head[-2:], self.full[-2:]

    def _flow(self, start: int, end: int, most: float) -> tuple[float, set[str] | None]:
        rest, head, out, value = list(self.full), self.head, self.out, 0.0
        while True:
            level = {start: 0}
            todo = deque([start])
            while todo and end not in level:
                x = todo.popleft()
                for e in out[x]:
                    if rest[e] > 0 and head[e] not in level:
                        level[head[e]] = level[x] + 1
                        todo.append(head[e])
            if end not in level:
                return value, {self.names[x] for x in level if x < start}
            at, path, x = dict.fromkeys(level, 0), [], start
            while True:
                if x == end:
                    push = min(rest[e] for e in path)
                    value += push
                    if value > most:
                        return value, None
                    for e in path:
                        rest[e] -= push
                        rest[e ^ 1] += push
                    path, x = [], start
                    continue
                arcs = out[x]
                while at[x] < len(arcs):
                    e = arcs[at[x]]
                    if rest[e] > 0 and level.get(head[e]) == level[x] + 1:
                        break
                    at[x] += 1
                else:
                    if x == start:
                        break
                    e = path.pop()
                    x = head[e ^ 1]
                    at[x] += 1
                    continue
                path.append(e)
                x = head[e]


def min_cut(capacity: Edges, sources: Iterable[str], sinks: Iterable[str]) -> tuple[float, set[str]]:
    """(value, smallest source side) of a minimum cut."""
    sources, sinks = set(sources), set(sinks)
    return Network(capacity, sources | sinks).cut(sources, sinks)


class Ways:
    """Which node reaches which, itself included, as one whole number of bits a node; edges may be added."""

    def __init__(self, edges: Iterable[tuple[str, str]], names: Iterable[str]):
        self.bit = {x: 1 << i for i, x in enumerate(sorted(names))}
        self.far = dict(self.bit)
        for x, y in edges:
            self.far[x] |= self.bit[y]
        for k, bit in self.bit.items():
            through = self.far[k]
            for x, seen in self.far.items():
                if seen & bit:
                    self.far[x] = seen | through

    def bits(self, names: Iterable[str]) -> int:
        return sum(self.bit[x] for x in names)

    def add(self, x: str, y: str) -> None:
        bit, through = self.bit[x], self.far[y]
        for z, seen in self.far.items():
            if seen & bit:
                self.far[z] = seen | through

    def ordered(self, one: Iterable[str], two: Iterable[str]) -> bool:
        """All of ``one`` reach all of ``two``, and none the other way."""
        first, second = self.bits(one), self.bits(two)
        return all(self.far[x] & second == second for x in one) and not any(self.far[x] & first for x in two)


def bipartitions(names: Iterable[str]):
    """All ordered splits into two non-empty sets, for tests and exhaustive search."""
    names = sorted(names)
    for size in range(1, len(names)):
        for part in itertools.combinations(names, size):
            yield set(part), set(names) - set(part)
