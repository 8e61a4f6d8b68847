"""Process trees."""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

OPERATORS = ("sequence", "exclusive", "parallel", "redo", "flower")
TAU = "tau"


@dataclass
class Node:
    label: str
    children: list[Node] = field(default_factory=list)

    def walk(self, path: str = "0") -> Iterator[tuple[str, Node]]:
        """(id, node) in pre-order; the id is the path of child positions."""
        yield path, self
        for i, c in enumerate(self.children):
            yield from c.walk(f"{path}.{i}")

    def activities(self) -> set[str]:
        return {n.label for _, n in self.walk() if not n.children and n.label not in OPERATORS and n.label.lower() != TAU}

    def __str__(self) -> str:
        return f"{self.label}({', '.join(map(str, self.children))})" if self.children else self.label

    def to_dict(self, path: str = "0") -> dict:
        return {"id": path, "label": self.label, "children": [c.to_dict(f"{path}.{i}") for i, c in enumerate(self.children)]}

    @classmethod
    def from_dict(cls, d: dict) -> Node:
        return cls(d["label"], [cls.from_dict(c) for c in d.get("children", [])])

    def replace(self, path: str, new: Node) -> Node:
        """A copy with the node of that id replaced."""
        if path == "0":
            return new
        first, _, rest = path.removeprefix("0.").partition(".")
        children = list(self.children)
        children[int(first)] = children[int(first)].replace(f"0.{rest}" if rest else "0", new)
        return Node(self.label, children)

    def at(self, path: str) -> Node:
        return dict(self.walk())[path]


def forest_json(trees: list[Node]) -> str:
    return json.dumps([t.to_dict(str(i)) for i, t in enumerate(trees)])


def read_forest(text: str) -> list[Node]:
    return [Node.from_dict(d) for d in json.loads(text)]


def table(spark: SparkSession, tree: Node | None) -> DataFrame:
    """(node_id, parent_id, child_pos, depth, label, kind)."""
    rows = []
    for path, n in tree.walk() if tree else ():
        parent, _, pos = path.rpartition(".")
        rows.append((path, parent or None, int(pos), path.count("."), n.label, n.label if n.children else "leaf"))
    return spark.createDataFrame(rows, "node_id string, parent_id string, child_pos int, depth int, label string, kind string")


def open_flower(tree: Node) -> tuple[str, set[str]] | None:
    """Id and activities of the first flower in pre-order."""
    return next(((p, {c.label for c in n.children}) for p, n in tree.walk() if n.label == "flower"), None)


def replace_flowers(tree: Node, names: set[str], new: Node) -> Node:
    """Every flower over exactly these activities, or over none, becomes the new node."""
    if tree.label == "flower" and (not tree.children or {c.label for c in tree.children} == names):
        return new
    return Node(tree.label, [replace_flowers(c, names, new) for c in tree.children])


def descendants(tree: Node, path: str) -> list[str]:
    return [p for p, _ in tree.walk() if p == path or p.startswith(path + ".")]


def collapse(tree: Node, path: str) -> tuple[Node, set[str]]:
    """The subtree becomes a flower of its activities; those are returned as well."""
    names = tree.at(path).activities()
    return tree.replace(path, Node("flower", [Node(n) for n in sorted(names)])), names


def conformance_form(tree: Node, patterns: dict[str, dict[str, list[str]]], path: str = "0") -> dict:
    """The tree with operators renamed, stable UUIDs, and each leaf's object types by pattern."""
    kinds = {"redo": "Loop", "parallel": "Concurrency", "exclusive": "ExclusiveChoice", "sequence": "Sequence"}
    node = {"uuid": str(uuid.uuid5(uuid.NAMESPACE_OID, path))}
    if tree.label in kinds:
        return node | {"operator": kinds[tree.label], "children": [conformance_form(c, patterns, f"{path}.{i}") for i, c in enumerate(tree.children)]}
    if tree.label.lower() == TAU:
        return node | {"activity": None}
    names = {"related": "relational", "divergent": "divergent", "convergent": "convergent", "deficient": "deficient"}
    return node | {"activity": tree.label} | {k: patterns.get(v, {}).get(tree.label, []) for k, v in names.items()}


def language(tree: Node, most: int = 100_000) -> set[tuple[str, ...]]:
    """Executions: redo runs its body one to three times; operators use their first two children.  More than ``most`` are an error."""

    def check(out: set) -> set:
        if len(out) > most:
            raise ValueError(f"more than {most} executions")
        return out

    def shuffle(a: tuple, b: tuple) -> Iterator[tuple]:
        for places in itertools.combinations(range(len(a) + len(b)), len(a)):
            x, y, put = iter(a), iter(b), set(places)
            yield tuple(next(x) if i in put else next(y) for i in range(len(a) + len(b)))

    if not tree.children:
        return {()} if tree.label.lower() == TAU else {(tree.label,)}
    if tree.label not in OPERATORS or tree.label == "flower" or len(tree.children) < 2:
        return {()}
    one, two = (language(c, most) for c in tree.children[:2])
    if tree.label == "exclusive":
        return check(one | two)
    if tree.label == "sequence":
        return check({a + b for a in one for b in two})
    if tree.label == "parallel":
        out: set = set()
        for a in one:
            for b in two:
                for s in shuffle(a, b):
                    out.add(s)
                    check(out)
        return out
    out = set(one)
    grown = one
    for _ in range(2):
        grown = check({g + b + a for g in grown for b in two for a in one})
        out |= grown
    return check(out)


def relations_of(tree: Node) -> tuple[set[str], set[str], set[tuple[str, str]], bool]:
    """(starts, ends, follows, may be empty) of a tree's language, by the rules of each operator."""
    if not tree.children:
        if tree.label.lower() == TAU:
            return set(), set(), set(), True
        return {tree.label}, {tree.label}, set(), False
    parts = [relations_of(c) for c in tree.children]
    if tree.label == "flower":
        names = set().union(*(p[0] for p in parts))
        return names, names, {(a, b) for a in names for b in names}, True
    s, e, f, empty = parts[0]
    for s2, e2, f2, empty2 in parts[1:]:
        if tree.label == "exclusive":
            s, e, f, empty = s | s2, e | e2, f | f2, empty or empty2
        elif tree.label == "sequence":
            s, e, f, empty = s | (s2 if empty else set()), e2 | (e if empty2 else set()), f | f2 | {(a, b) for a in e for b in s2}, empty and empty2
        elif tree.label == "parallel":
            mine, other = ({x for g in (f1, s1, e1) for y in g for x in (y if isinstance(y, tuple) else (y,))} for s1, e1, f1 in ((s, e, f), (s2, e2, f2)))
            f = f | f2 | {(a, b) for a in mine for b in other} | {(b, a) for a in mine for b in other}
            s, e, empty = s | s2, e | e2, empty and empty2
        else:  # redo: body, then any number of (second, body)
            f = f | f2 | {(a, b) for a in e for b in s2} | {(a, b) for a in e2 for b in s}
            if empty2:
                f |= {(a, b) for a in e for b in s}
            if empty:
                s, e, f = s | s2, e | e2, f | {(a, b) for a in e2 for b in s2}
    return s, e, f, empty


def rules(tree: Node) -> list[tuple[str, set[str], set[str]]]:
    """(kind, left, right) of the sequence and exclusive nodes that only such nodes lie above; the first two children count."""
    if tree.label not in ("sequence", "exclusive") or len(tree.children) < 2:
        return []
    one, two = tree.children[:2]
    return [(tree.label, one.activities(), two.activities()), *rules(one), *rules(two)]


def replay_greedily(tree: Node, trace: list[str], at: int = 0) -> tuple[bool, int, int]:
    """(went on, events used, activities missed) of a trace from ``at`` on, without backtracking.

    Past the end all goes on.  An exclusive node takes its first branch that uses
    an event; parallel children run one after the other and never stop; a loop
    repeats its first child while that uses events.  Any other label, operators
    included, is an activity.
    """
    if at >= len(trace):
        return True, 0, 0
    if tree.label == "exclusive":
        tried = (replay_greedily(c, trace, at) for c in tree.children)
        return next((t for t in tried if t[0] and t[1]), (False, 0, 1))
    used = missed = 0
    if tree.label in ("sequence", "parallel"):
        for child in tree.children:
            fine, n, gaps = replay_greedily(child, trace, at + used)
            used, missed = used + n, missed + gaps
            if not fine and tree.label == "sequence":
                return False, used, missed
        return True, used, missed
    if tree.label == "loop":
        n = 1
        while tree.children and n and at + used < len(trace):
            fine, n, gaps = replay_greedily(tree.children[0], trace, at + used)
            used, missed = used + n, missed + gaps
            if not fine:
                break
        return True, used, missed
    return (True, 1, 0) if trace[at] == tree.label else (False, 0, 1)
