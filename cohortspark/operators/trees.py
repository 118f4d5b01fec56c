"""Cluster trees: rendering as text, and merging of branches whose leaves have one name (driver side: trees are short)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Tree:
    """A leaf has a name; an inner node has branches, and a name once all its leaves have the same."""

    name: str = ""
    branches: list[Tree] = field(default_factory=list)


def from_merges(leaves: list[str], merges: list[tuple[int, int]]) -> Tree:
    """A tree of leaves 0..n-1; the k-th merge joins two nodes into node n + k, and the last one is the root."""
    nodes = [Tree(name) for name in leaves]
    for a, b in merges:
        nodes.append(Tree("", [nodes[a], nodes[b]]))
    return nodes[-1]


def merged(tree: Tree) -> Tree:
    """Branches whose leaves agree up to the last underscore become one leaf of that name; single branches are passed over."""
    if not tree.branches:
        return Tree(tree.name.rpartition("_")[0] or tree.name)
    own = [merged(b) for b in tree.branches]
    if len(own) == 1:
        return own[0]
    names = {b.name for b in own}
    if len(names) == 1 and all(not b.branches for b in own):
        return Tree(names.pop())
    return Tree("", own)


def lines(tree: Tree) -> list[str]:
    """The tree as lines of text, first branches on top."""
    if not tree.branches:
        return [f"--{tree.name}"]
    out = []
    for n, branch in enumerate(tree.branches):
        last = n == len(tree.branches) - 1
        inner = lines(branch)
        out.append("+" + inner[0])
        out += [("   " if last else "|  ") + line for line in inner[1:]]
    return out
