"""Gene trees: neighbour joining, midpoint rooting, Newick, and ladders.

Trees are small (a query's hits); each is one group's work.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.schemas import LADDER, TREE


class Node:
    __slots__ = ("name", "length", "children")

    def __init__(self, name: str = "", length: float = 0.0, children: list[Node] | None = None):
        self.name, self.length, self.children = name, length, children or []


def distance(a: np.ndarray, b: np.ndarray, most: float = 3.0) -> float:
    """Log-corrected share of differences over columns without a gap in either row."""
    both = (a != ord("-")) & (b != ord("-"))
    n = int(both.sum())
    if not n:
        return most
    p = float((a[both] != b[both]).sum()) / n
    return most if p >= 1 - math.exp(-most) else -math.log(1 - p)


def neighbour_joining(names: list[str], d: np.ndarray) -> Node:
    """An unrooted tree as a node of three children (fewer for fewer names); ties by order."""
    nodes = [Node(n) for n in names]
    d = d.astype(float).copy()
    while len(nodes) > 3:
        n = len(nodes)
        total = d.sum(axis=1)
        q = (n - 2) * d - total[:, None] - total[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = divmod(int(np.argmin(q)), n)
        i, j = min(i, j), max(i, j)
        li = 0.5 * d[i, j] + (total[i] - total[j]) / (2 * (n - 2))
        nodes[i].length, nodes[j].length = max(0.0, li), max(0.0, d[i, j] - li)
        new = 0.5 * (d[i] + d[j] - d[i, j])
        keep = [k for k in range(n) if k not in (i, j)]
        out = np.zeros((n - 1, n - 1))
        out[:-1, :-1] = d[np.ix_(keep, keep)]
        out[-1, :-1] = out[:-1, -1] = np.maximum(new[keep], 0)
        nodes = [nodes[k] for k in keep] + [Node("", 0.0, [nodes[i], nodes[j]])]
        d = out
    if len(nodes) == 3:
        for i, (j, k) in enumerate(((1, 2), (0, 2), (0, 1))):
            nodes[i].length = max(0.0, 0.5 * (d[i, j] + d[i, k] - d[j, k]))
    elif len(nodes) == 2:
        nodes[0].length = nodes[1].length = d[0, 1] / 2
    return Node("", 0.0, nodes) if len(nodes) > 1 else nodes[0]


def midpoint_root(tree: Node) -> Node:
    """Root at the middle of the longest path between leaves; a tree without lengths stays as it is."""
    if len(tree.children) < 2:
        return tree
    near: dict[int, list[tuple[Node, float]]] = {}
    order: list[Node] = []

    def link(root: Node) -> None:
        stack = [root]
        while stack:
            n = stack.pop()
            order.append(n)
            near.setdefault(id(n), [])
            for c in n.children:
                near[id(n)].append((c, c.length))
                near.setdefault(id(c), []).append((n, c.length))
                stack.append(c)

    link(tree)

    def farthest(start: Node) -> tuple[Node, dict[int, tuple[Node | None, float]]]:
        seen: dict[int, tuple[Node | None, float]] = {id(start): (None, 0.0)}
        stack, best = [start], (start, 0.0)
        while stack:
            n = stack.pop()
            for m, length in near[id(n)]:
                if id(m) not in seen:
                    seen[id(m)] = (n, seen[id(n)][1] + length)
                    stack.append(m)
                    if not m.children and seen[id(m)][1] > best[1] + 1e-12:
                        best = (m, seen[id(m)][1])
        return best[0], seen

    first = next(n for n in order if not n.children)
    a, _ = farthest(first)
    b, back = farthest(a)
    half = back[id(b)][1] / 2
    if half <= 0:
        return tree
    n = b
    while back[id(n)][0] is not None and back[id(back[id(n)][0])][1] > half:
        n = back[id(n)][0]
    m = back[id(n)][0]
    up = back[id(n)][1] - half

    def hang(node: Node, parent: Node, length: float) -> Node:
        out = Node(node.name, length)
        stack = [(node, parent, out)]
        while stack:
            x, p, copy = stack.pop()
            for c, ln in near[id(x)]:
                if c is not p:
                    child = Node(c.name, ln)
                    copy.children.append(child)
                    stack.append((c, x, child))
        return out

    root = Node("", 0.0, [hang(n, m, up), hang(m, n, half - back[id(m)][1])])
    # a former root of two children is now a step without a fork
    return _without_knees(root)


def _without_knees(tree: Node) -> Node:
    stack = [tree]
    while stack:
        n = stack.pop()
        for i, c in enumerate(n.children):
            while len(c.children) == 1:
                only = c.children[0]
                only.length += c.length
                n.children[i] = c = only
            stack.append(c)
    return tree


def to_newick(tree: Node) -> str:
    parts: list[str] = []
    stack: list = [(tree, 0)]
    while stack:
        n, at = stack.pop()
        if isinstance(n, str):
            parts.append(n)
            continue
        if n.children:
            parts.append("(")
            stack.append((f"){n.name}:{n.length:.6g}" if n is not tree else ")", 0))
            for i in range(len(n.children) - 1, -1, -1):
                stack.append((n.children[i], 0))
                if i:
                    stack.append((",", 0))
        else:
            parts.append(f"{n.name}:{n.length:.6g}")
    return "".join(parts) + ";"


_TOKEN = re.compile(r"\s*([(),;]|:[^(),;]*|'(?:[^']|'')*'|[^(),:;\s]+)")


def parse_newick(text: str) -> Node:
    root = Node()
    stack, node = [], root
    for m in _TOKEN.finditer(text):
        t = m[1]
        if t == "(":
            child = Node()
            node.children.append(child)
            stack.append(node)
            node = child
        elif t == ",":
            child = Node()
            stack[-1].children.append(child)
            node = child
        elif t == ")":
            node = stack.pop()
        elif t == ";":
            break
        elif t.startswith(":"):
            try:
                node.length = float(t[1:])
            except ValueError:
                node.length = 0.0
        else:
            node.name = t.strip("'")
    if stack:
        raise ValueError("unbalanced tree")
    return root


def ladder(tree: Node, query: str) -> list[tuple[str, int]]:
    """(leaf, step) of each named leaf: ancestors of the query up to the common one; empty without the query."""
    parent: dict[int, Node] = {}
    leaves: list[Node] = []
    stack = [tree]
    while stack:
        n = stack.pop()
        for c in n.children:
            parent[id(c)] = n
            stack.append(c)
        if not n.children and n.name:
            leaves.append(n)
    own = next((n for n in leaves if n.name == query), None)
    if own is None:
        return []
    step = {id(own): 0}
    n, k = own, 0
    while id(n) in parent:
        n, k = parent[id(n)], k + 1
        step[id(n)] = k
    out = []
    for leaf in leaves:
        path, n = [], leaf
        while id(n) not in step:
            path.append(n)
            n = parent[id(n)]
        k = step[id(n)]
        out.append((leaf.name, k))
        if n is not own:
            for x in path:
                step[id(x)] = k
    return out


def build_trees(aligned: DataFrame) -> DataFrame:
    """(query, newick): a midpoint-rooted neighbour-joining tree for each alignment of two rows or more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("target")
        names = [str(t) for t in pdf["target"]]
        if len(names) < 2:
            return pd.DataFrame({"query": pd.Series([], dtype="int64"), "newick": pd.Series([], dtype=object)})
        rows = [np.frombuffer(r.encode("ascii", "replace"), np.uint8) for r in pdf["row"]]
        d = np.zeros((len(rows), len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                d[i, j] = d[j, i] = distance(rows[i], rows[j])
        return pd.DataFrame({"query": [int(pdf["query"].iloc[0])], "newick": [to_newick(midpoint_root(neighbour_joining(names, d)))]})

    return aligned.groupBy("query").applyInPandas(run, TREE)


def ladders(trees: DataFrame, root: bool = False) -> DataFrame:
    """(query, leaf, step) of each tree; ``root`` roots it at the midpoint first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for q, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tree = parse_newick(text)
                for leaf, step in ladder(midpoint_root(tree) if root else tree, str(q)):
                    out[0].append(q)
                    out[1].append(int(leaf))
                    out[2].append(step)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], names=["query", "leaf", "step"])

    return trees.select(F.col("query").cast("long").alias("query"), "newick").mapInArrow(run, LADDER)
