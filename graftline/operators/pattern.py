"""Pattern matching: a pattern is compiled to joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.graph import Graph


@dataclass(frozen=True)
class Pattern:
    """nodes: name -> attribute sets that a match must contain; edges: (source, target) -> the same; types: name -> a type of the typing.

    directed: False if every edge is matched either way; undirected: edges that are, where others aren't."""

    nodes: dict[str, dict[str, list[str]]]
    edges: dict[tuple[str, str], dict[str, list[str]]] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    directed: bool = True
    undirected: frozenset[tuple[str, str]] = frozenset()


def _join_order(p: Pattern) -> list[tuple[str, str]]:
    """Edges so that each touches what is bound already, closing cycles first; a new part starts where none does."""
    left, bound, out = list(p.edges), set(), []
    while left:
        best = max(left, key=lambda e: (len({*e} & bound) == 2, len({*e} & bound) == 1, bool(p.edges[e]), sum(bool(p.nodes[x]) or x in p.types for x in e)))
        left.remove(best)
        out.append(best)
        bound |= {*best}
    return out


def _parts(p: Pattern) -> int:
    """How many parts of the pattern no edge connects."""
    top = {n: n for n in p.nodes}

    def find(x: str) -> str:
        while top[x] != x:
            x = top[x]
        return x

    for a, b in p.edges:
        top[find(a)] = find(b)
    return len({find(n) for n in p.nodes})


def match(graph: Graph, p: Pattern, typing: DataFrame | None = None, within: DataFrame | None = None, product: bool = False) -> DataFrame:
    """All injective matches, a column for each pattern node.

    Parts of the pattern that no edge connects are matched each on its own, and every combination is a match: that must be asked for by `product`.

    Candidates of a node with attributes, a type, or a given node set are found first, so the joins start small; a pair of nodes of the same
    kind is kept apart as soon as both are bound."""
    if not product and _parts(p) > 1:
        raise ValueError("the pattern isn't connected: its matches are a product of its parts' (product=True)")

    def candidates(name: str) -> DataFrame | None:
        out = None
        if p.nodes[name]:
            out = graph.nodes_with(p.nodes[name])
        if name in p.types:
            own = typing.filter(F.col("type") == p.types[name]).select("node_id")
            out = own if out is None else out.join(own, "node_id", "left_semi")
        if within is not None:
            own = within.select("node_id")
            out = own if out is None else out.join(own, "node_id", "left_semi")
        return None if out is None else out.select(F.col("node_id").alias(name))

    chosen = {n: candidates(n) for n in p.nodes}

    def apart(df: DataFrame, new: list[str]) -> DataFrame:
        for a in new:
            for b in df.columns:
                if a != b and not (b in new and b < a):
                    df = df.filter(F.col(a) != F.col(b))
        return df

    out: DataFrame | None = None
    for a, b in _join_order(p):
        e = graph.edges_with(p.edges[a, b]).select(F.col("src").alias(a), F.col("dst").alias(b)) if a != b else graph.edges_with(p.edges[a, b]).filter("src = dst").select(F.col("src").alias(a))
        if (not p.directed or (a, b) in p.undirected) and a != b:
            e = e.unionByName(graph.edges_with(p.edges[a, b]).select(F.col("dst").alias(a), F.col("src").alias(b))).distinct()
        bound = [] if out is None else out.columns
        for n in dict.fromkeys((a, b)):
            if n not in bound and chosen[n] is not None:
                e = e.join(chosen[n], n, "left_semi")
        shared = [n for n in dict.fromkeys((a, b)) if n in bound]
        new = [n for n in dict.fromkeys((a, b)) if n not in bound]
        out = e if out is None else out.join(e, shared) if shared else out.crossJoin(e)
        out = apart(out, new)
    for n in p.nodes:
        if out is None or n not in out.columns:
            own = chosen[n] if chosen[n] is not None else graph.nodes.select(F.col("node_id").alias(n))
            out = apart(own if out is None else out.crossJoin(own), [n])
    return out.select(*p.nodes)
