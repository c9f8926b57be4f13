"""Guide trees: neighbor joining, Newick in and out, merge waves."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame


@dataclass
class Clade:
    """A node of a binary tree; a leaf has a name and no children."""

    name: str | None = None
    children: list[Clade] = field(default_factory=list)

    def leaves(self) -> list[str]:
        stack, out = [self], []
        while stack:
            c = stack.pop()
            if c.children:
                stack.extend(reversed(c.children))
            else:
                out.append(c.name)
        return out


def distance_matrix(pairs: DataFrame, names: list) -> np.ndarray:
    """Dense distances of a listing of pairs; pairs that aren't listed are at distance 1.

    For guide trees of up to a few thousand genomes: the matrix has the square of their number.
    """
    at = {n: i for i, n in enumerate(names)}
    d = np.ones((len(names), len(names)))
    np.fill_diagonal(d, 0)
    for r in pairs.select("a", "b", "distance").toLocalIterator():
        i, j = at[r["a"]], at[r["b"]]
        d[i, j] = d[j, i] = r["distance"]
    return d


def q_matrix(d: np.ndarray) -> np.ndarray:
    """The criterion of neighbor joining; the diagonal is infinite."""
    sums = d.sum(axis=1)
    q = (len(d) - 2) * d - sums[:, None] - sums[None, :]
    np.fill_diagonal(q, np.inf)
    return q


def joined_distances(d: np.ndarray, i: int, j: int) -> np.ndarray:
    """Distances of the new node to all nodes."""
    return (d[i] + d[j] - d[i, j]) / 2


def neighbor_joining(d: np.ndarray, names: list[str]) -> Clade:
    """The tree of a distance matrix. One name gives a leaf; of equal pairs the first in row order is joined."""
    nodes = [Clade(n) for n in names]
    if not nodes:
        raise ValueError("a tree needs at least one leaf")
    d = np.array(d, dtype=float)
    while len(nodes) > 2:
        i, j = divmod(int(np.argmin(q_matrix(d))), len(d))
        i, j = min(i, j), max(i, j)
        new = joined_distances(d, i, j)
        keep = [k for k in range(len(d)) if k not in (i, j)]
        grown = np.zeros((len(keep) + 1, len(keep) + 1))
        grown[:-1, :-1] = d[np.ix_(keep, keep)]
        grown[-1, :-1] = grown[:-1, -1] = new[keep]
        nodes = [nodes[k] for k in keep] + [Clade(children=[nodes[i], nodes[j]])]
        d = grown
    return nodes[0] if len(nodes) == 1 else Clade(children=nodes)


def balanced(names: list[str]) -> Clade:
    """A tree of least height over the leaves in their order."""
    level = [Clade(n) for n in names]
    while len(level) > 1:
        level = [Clade(children=level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def waves(tree: Clade) -> list[list[Clade]]:
    """Inner nodes by height: all merges of one wave are independent and run in one job."""
    heights: dict[int, int] = {}
    levels: list[list[Clade]] = []
    stack = [(tree, False)]
    while stack:
        node, done = stack.pop()
        if not node.children:
            heights[id(node)] = 0
        elif done:
            h = heights[id(node)] = 1 + max(heights[id(c)] for c in node.children)
            while len(levels) < h:
                levels.append([])
            levels[h - 1].append(node)
        else:
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children))
    return levels


def to_newick(tree: Clade) -> str:
    """Newick text; names with other characters than letters, digits, '_', '.', '-', '|' are quoted."""
    out: list[str] = []
    stack: list = [tree]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.children:
            a, b = item.children
            stack.extend([")", b, ",", a, "("])
        else:
            name = item.name or ""
            plain = name and all(c.isalnum() or c in "_.-|" for c in name)
            out.append(name if plain else "'" + name.replace("'", "''") + "'")
    return "".join(out) + ";"


def parse_newick(text: str) -> Clade:
    """A strictly bifurcating tree; labels of inner nodes and branch lengths are read and dropped."""
    at, n = 0, len(text)

    def blanks() -> None:
        nonlocal at
        while at < n and text[at].isspace():
            at += 1

    def label() -> str:
        nonlocal at
        blanks()
        if at < n and text[at] == "'":
            out, at = [], at + 1
            while True:
                if at >= n:
                    raise ValueError("a quoted name has no end")
                if text[at] == "'":
                    if text[at + 1 : at + 2] == "'":
                        out.append("'")
                        at += 2
                        continue
                    at += 1
                    return "".join(out)
                out.append(text[at])
                at += 1
        begin = at
        while at < n and text[at] not in "(),:;'" and not text[at].isspace():
            at += 1
        return text[begin:at]

    def length() -> None:
        nonlocal at
        blanks()
        if at < n and text[at] == ":":
            at += 1
            blanks()
            begin = at
            while at < n and text[at] not in "(),;" and not text[at].isspace():
                at += 1
            try:
                float(text[begin:at])
            except ValueError:
                raise ValueError(f"a branch length is no number: {text[begin:at]!r}") from None

    # an explicit stack: trees may be as deep as they have leaves
    open_: list[list[Clade]] = []
    done: Clade | None = None
    while True:
        blanks()
        if at >= n:
            raise ValueError("the tree ends early")
        if text[at] == "(":
            open_.append([])
            at += 1
            continue
        name = label()
        if not name:
            raise ValueError(f"a leaf has no name at {at}")
        node = Clade(name)
        length()
        while open_:
            open_[-1].append(node)
            blanks()
            if at < n and text[at] == ",":
                at += 1
                node = None
                break
            if at < n and text[at] == ")":
                at += 1
                children = open_.pop()
                if len(children) != 2:
                    raise ValueError(f"an inner node has {len(children)} children instead of 2")
                label()
                length()
                node = Clade(children=children)
                continue
            raise ValueError("a bracket isn't closed")
        if node is not None:
            done = node
            break
    blanks()
    if at < n and text[at] == ";":
        at += 1
    blanks()
    if at < n:
        raise ValueError(f"text after the tree: {text[at : at + 20]!r}")
    return done


def attach(tree: Clade, names: list[str]) -> Clade:
    """Checks that leaves and names are the same, each once."""
    leaves = tree.leaves()
    for what, items in (("leaf", leaves), ("name", names)):
        twice = sorted(x for x, c in Counter(items).items() if c > 1)
        if twice:
            raise ValueError(f"{what} occurs more than once: {', '.join(twice[:5])}")
    missing, left = sorted(set(names) - set(leaves)), sorted(set(leaves) - set(names))
    if missing:
        raise ValueError(f"not in the tree: {', '.join(missing[:5])}")
    if left:
        raise ValueError(f"only in the tree: {', '.join(left[:5])}")
    return tree
