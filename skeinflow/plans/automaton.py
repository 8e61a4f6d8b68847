"""Languages of process trees as minimal automata: executions are counted and traces checked without listing any.

A state is whether it accepts, and its steps by activity.  Equal states are one
state, so a language has one number, and every operation is worked out once for
each pair of states.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable

from skeinflow.plans.tree import OPERATORS, TAU, Node

#: States of all languages of an ``Automata`` at most.
MOST_STATES = 1_000_000
NOTHING, EMPTY = 0, 1  # the language without words, and that of the empty word


class Automata:
    def __init__(self, most: int = MOST_STATES):
        self.most = most
        self.states: list[tuple[bool, tuple[tuple[str, int], ...]]] = []
        self.known: dict[tuple, int] = {}
        self.done: dict[tuple, int] = {}
        self._make(False, {})
        self._make(True, {})
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 200_000))  # as deep as words are long

    def _make(self, accepts: bool, steps: dict[str, int]) -> int:
        state = accepts, tuple(sorted((a, s) for a, s in steps.items() if s != NOTHING))
        if state not in self.known:
            if len(self.states) >= self.most:
                raise ValueError(f"more than {self.most} states")
            self.known[state] = len(self.states)
            self.states.append(state)
        return self.known[state]

    def _join(self, x: int, y: int) -> int:
        if x == y or y == NOTHING:
            return x
        if x == NOTHING:
            return y
        key = ("or", *sorted((x, y)))
        if key not in self.done:
            (ax, sx), (ay, sy) = self.states[x], self.states[y]
            steps = dict(sx)
            for a, s in sy:
                steps[a] = self._join(steps[a], s) if a in steps else s
            self.done[key] = self._make(ax or ay, steps)
        return self.done[key]

    def union(self, parts: Iterable[int]) -> int:
        out = NOTHING
        for p in parts:
            out = self._join(out, p)
        return out

    def then(self, x: int, y: int) -> int:
        """Words of x followed by words of y."""
        if x == NOTHING or y == NOTHING:
            return NOTHING
        if x == EMPTY or y == EMPTY:
            return y if x == EMPTY else x
        key = ("then", x, y)
        if key not in self.done:
            accepts, steps = self.states[x]
            out = self._make(False, {a: self.then(s, y) for a, s in steps})
            self.done[key] = self._join(out, y) if accepts else out
        return self.done[key]

    def shuffle(self, x: int, y: int) -> int:
        """All ways to lay a word of x and one of y into each other."""
        if x == NOTHING or y == NOTHING:
            return NOTHING
        if x == EMPTY or y == EMPTY:
            return y if x == EMPTY else x
        key = ("with", *sorted((x, y)))
        if key not in self.done:
            (ax, sx), (ay, sy) = self.states[x], self.states[y]
            steps: dict[str, int] = {}
            for a, s in [*((a, self.shuffle(s, y)) for a, s in sx), *((a, self.shuffle(x, s)) for a, s in sy)]:
                steps[a] = self._join(steps.get(a, NOTHING), s)
            self.done[key] = self._make(ax and ay, steps)
        return self.done[key]

    def project(self, x: int, names: Iterable[str]) -> int:
        """The words with all other activities left out."""
        names = frozenset(names)

        def of(s: int) -> int:
            key = ("only", names, s)
            if key not in self.done:
                accepts, steps = self.states[s]
                out = self._make(accepts, {a: of(t) for a, t in steps if a in names})
                for a, t in steps:
                    if a not in names:
                        out = self._join(out, of(t))
                self.done[key] = out
            return self.done[key]

        return of(x)

    def without_empty(self, x: int) -> int:
        return self._make(False, dict(self.states[x][1]))

    def of(self, tree: Node) -> int:
        """A tree's executions: redo runs its body one to three times; operators use their first two children.

        A flower, an operator with fewer children and any other inner node give
        the empty word, as does a silent leaf.
        """
        if not tree.children:
            return EMPTY if tree.label.lower() == TAU else self._make(False, {tree.label: EMPTY})
        if tree.label not in OPERATORS or tree.label == "flower" or len(tree.children) < 2:
            return EMPTY
        one, two = (self.of(c) for c in tree.children[:2])
        if tree.label == "exclusive":
            return self._join(one, two)
        if tree.label == "sequence":
            return self.then(one, two)
        if tree.label == "parallel":
            return self.shuffle(one, two)
        again = self.then(two, one)
        return self.then(one, self.union([EMPTY, again, self.then(again, again)]))

    def count(self, x: int) -> int:
        """How many different words."""
        key = ("count", x)
        if key not in self.done:
            accepts, steps = self.states[x]
            self.done[key] = accepts + sum(self.count(s) for _, s in steps)
        return self.done[key]

    def table(self, x: int) -> dict[int, tuple[bool, dict[str, int]]]:
        """The states that x needs, x as state 0."""
        number, todo, out = {x: 0}, [x], {}
        while todo:
            s = todo.pop()
            accepts, steps = self.states[s]
            for _, t in steps:
                if t not in number:
                    number[t] = len(number)
                    todo.append(t)
            out[number[s]] = accepts, {a: number[t] for a, t in steps}
        return out


def walk(table: dict[int, tuple[bool, dict[str, int]]], word: Iterable[str]) -> bool:
    """Whether the word is accepted."""
    state = 0
    for a in word:
        if (state := table[state][1].get(a)) is None:
            return False
    return table[state][0]
