"""Sesqui-pushout rewriting: a rule and an instance become a fixed sequence of joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.graph import Graph


class RewritingError(ValueError):
    """An instance or typing at which a rule can't be applied."""


NodeAttr = tuple[str, str, str]  # node, key, value
EdgeAttr = tuple[str, str, str, str]  # source, target, key, value


@dataclass(frozen=True)
class Rule:
    """L <- P -> R. p_l: each node of P to its node of L (two of P to one of L: a clone; none: removal); p_r: each node of P to its node of R (two to one: a merge);
    nodes of R that none reaches are added. Edges of P that are missing between images of L's are removed, those of R beyond P's image are added. l_edges, l_attrs and
    l_edge_attrs are what an instance must have."""

    l_nodes: tuple[str, ...]
    p_l: dict[str, str]
    p_r: dict[str, str]
    r_nodes: tuple[str, ...]
    removed_edges: tuple[tuple[str, str], ...] = ()  # pairs of nodes of P
    added_edges: tuple[tuple[str, str], ...] = ()  # pairs of nodes of R
    removed_attrs: tuple[NodeAttr, ...] = ()  # of nodes of P
    added_attrs: tuple[NodeAttr, ...] = ()  # of nodes of R
    name: str = field(default="", compare=False)
    removed_edge_attrs: tuple[EdgeAttr, ...] = ()  # of pairs of nodes of P
    added_edge_attrs: tuple[EdgeAttr, ...] = ()  # of pairs of nodes of R
    l_edges: tuple[tuple[str, str], ...] = ()
    l_attrs: tuple[NodeAttr, ...] = ()
    l_edge_attrs: tuple[EdgeAttr, ...] = ()

    def __post_init__(self) -> None:
        """Raises RewritingError if the parts don't make a span."""
        ls, rs = set(self.l_nodes), set(self.r_nodes)
        wrong = [f"{p} comes from no node of L" for p, l in self.p_l.items() if l not in ls]
        wrong += [f"{p} goes to no node of R" for p in self.p_l if self.p_r.get(p) not in rs]
        wrong += [f"{p} is no node of P" for p in self.p_r if p not in self.p_l]
        for nodes, rows, ends in ((self.p_l, self.removed_edges, 2), (rs, self.added_edges, 2), (self.p_l, self.removed_attrs, 1), (rs, self.added_attrs, 1), (self.p_l, self.removed_edge_attrs, 2), (rs, self.added_edge_attrs, 2), (ls, self.l_edges, 2), (ls, self.l_attrs, 1), (ls, self.l_edge_attrs, 2)):
            wrong += [f"{x} isn't there" for row in rows for x in row[:ends] if x not in nodes]
        if wrong:
            raise RewritingError(f"rule {self.name}: {wrong[0]}")

    @staticmethod
    def identity() -> Rule:
        return Rule((), {}, {}, ())


SCHEMAS = {"nodes": "node_id string", "edges": "src string, dst string", "node_attrs": "node_id string, key string, value string", "edge_attrs": "src string, dst string, key string, value string", "moved": "old string, new string"}


def preimages(mapping: dict[str, str]) -> dict[str, list[str]]:
    """Each image -> what is sent to it, in order: rules refined at large graphs have many nodes, so none is looked for among all."""
    out: dict[str, list[str]] = {}
    for x, y in mapping.items():
        out.setdefault(y, []).append(x)
    return out


def frame(spark, rows, kind: str) -> DataFrame:
    """A rule-sized table."""
    return F.broadcast(spark.createDataFrame(list(rows), SCHEMAS[kind]))


def lacking(graph: Graph, wanted: dict[str, list[tuple]]) -> DataFrame:
    """(problem, at): rows of the graph's tables that are wanted, rule-sized, and aren't there. Each table is read once and reduced by a broadcast of what is asked for."""
    spark = graph.nodes.sparkSession
    out = spark.createDataFrame([], "problem string, at string")
    for kind, rows in wanted.items():
        if rows:
            small, table = spark.createDataFrame(sorted(set(rows)), SCHEMAS[kind]), getattr(graph, kind)
            there = F.broadcast(table.join(F.broadcast(small), small.columns, "left_semi"))
            out = out.unionByName(small.join(there, small.columns, "left_anti").select(F.lit(kind).alias("problem"), F.concat_ws(" ", *small.columns).alias("at")))
    return out


def instance_violations(graph: Graph, rule: Rule, instance: dict[str, str]) -> DataFrame:
    """(problem, at): nodes, edges and attribute values of L that the instance lacks."""
    edge = lambda e: (instance[e[0]], instance[e[1]], *e[2:])
    return lacking(graph, {"nodes": [(instance[x],) for x in rule.l_nodes], "edges": [edge(e) for e in rule.l_edges], "node_attrs": [(instance[n], k, v) for n, k, v in rule.l_attrs], "edge_attrs": [edge(e) for e in rule.l_edge_attrs]})


def check_instance(graph: Graph, rule: Rule, instance: dict[str, str]) -> None:
    """Raises RewritingError for an instance that isn't total, injective, and a homomorphism."""
    if missing := [x for x in rule.l_nodes if x not in instance]:
        raise RewritingError(f"the instance has no place for {missing[0]}")
    if len({instance[x] for x in rule.l_nodes}) < len(rule.l_nodes):
        raise RewritingError("the instance isn't injective")
    bad = instance_violations(graph, rule, instance).first()
    if bad is not None:
        raise RewritingError(f"the instance lacks {bad.problem}: {bad.at}")


def free_ids(graph: Graph, wanted: list[str]) -> dict[str, str]:
    """For each of a few ids that are wanted for new nodes one that no node has: itself, or else with ~2, ~3 and so on."""
    new, left, turn = {x: x for x in wanted}, list(wanted), 1
    while left:
        asked = frame(graph.nodes.sparkSession, [(new[x],) for x in left], "nodes")
        taken = {r.node_id for r in graph.nodes.join(asked, "node_id", "left_semi").collect()}  # as many as are asked for at most
        left, turn = [x for x in left if new[x] in taken], turn + 1
        new |= {x: f"{x}~{turn}" for x in left}
    return new


def places(graph: Graph, rule: Rule, instance: dict[str, str], check: bool = True) -> tuple[dict[str, str], dict[str, str]]:
    """Where P's nodes and R's nodes are to be. The first of a node's copies (by name) keeps its id; with `check`, new ids are such that the graph has no node of that id."""
    at: dict[str, str] = {}
    over, into = preimages(rule.p_l), preimages(rule.p_r)
    for l in rule.l_nodes:
        for k, p in enumerate(sorted(over.get(l, ()))):
            at[p] = instance[l] if k == 0 else f"{instance[l]}#{p}"
    added = {r: f"new:{rule.name}:{r}" for r in rule.r_nodes if r not in into}
    fresh = [*(x for p, x in at.items() if x != instance[rule.p_l[p]]), *added.values()]
    new = free_ids(graph, fresh) if check else {x: x for x in fresh}
    at = {p: new.get(x, x) for p, x in at.items()}
    to = {r: min((at[p] for p in into.get(r, ())), default=None) or new[added[r]] for r in rule.r_nodes}
    return at, to


def rewrite(graph: Graph, rule: Rule, instance: dict[str, str] | None = None, check: bool = True, named: tuple[dict[str, str], dict[str, str]] | None = None) -> tuple[Graph, dict[str, str]]:
    """Applies a rule at an instance (node of L -> node of the graph; by default the nodes of the same names) -> the graph, and where R's nodes are.

    All side tables have the size of the rule, so joins with them are broadcasts; what is deduplicated is the rows of cloned and merged nodes. With `check`, the instance
    is looked up first (an error if it lacks something of L) and ids of new nodes are chosen free; without, nothing runs before the graph is asked for. named: places() as worked out before."""
    spark = graph.nodes.sparkSession
    instance = {x: x for x in rule.l_nodes} if instance is None else instance
    if check:
        check_instance(graph, rule, instance)
    at, to = named or places(graph, rule, instance, check)
    g = graph
    kept = set(rule.p_l.values())
    gone = [(instance[l],) for l in rule.l_nodes if l not in kept]
    if gone:
        g = g.remove_nodes(frame(spark, gone, "nodes"))
    moved = [(instance[rule.p_l[p]], x) for p, x in at.items()]
    if any(a != b for a, b in moved):
        g = g.rename(frame(spark, moved, "moved"), closed=True)
    if rule.removed_edges:
        g = g.remove_edges(frame(spark, [(at[a], at[b]) for a, b in rule.removed_edges], "edges"))
    if rule.removed_attrs:
        g = g.remove_node_attrs(frame(spark, [(at[p], k, v) for p, k, v in rule.removed_attrs], "node_attrs"))
    if rule.removed_edge_attrs:
        g = g.remove_edge_attrs(frame(spark, [(at[a], at[b], k, v) for a, b, k, v in rule.removed_edge_attrs], "edge_attrs"))
    merged = [(at[p], to[r]) for p, r in rule.p_r.items()]
    if any(a != b for a, b in merged):
        g = g.rename(frame(spark, merged, "moved"), closed=True)
    return expand(g, rule, to), to


def expand(g: Graph, rule: Rule, to: dict[str, str], new: list[str] | None = None) -> Graph:
    """Adds what the rule adds, R's nodes being at `to`; new: nodes of R that are added (by default those that P doesn't reach)."""
    spark = g.nodes.sparkSession
    reached = set(rule.p_r.values())
    added = [(to[r],) for r in (new if new is not None else [r for r in rule.r_nodes if r not in reached])]
    if added:
        g = g.add_nodes(frame(spark, added, "nodes"))
    if rule.added_edges:
        g = g.add_edges(frame(spark, [(to[a], to[b]) for a, b in rule.added_edges], "edges"))
    if rule.added_attrs:
        g = g.add_node_attrs(frame(spark, [(to[r], k, v) for r, k, v in rule.added_attrs], "node_attrs"))
    if rule.added_edge_attrs:
        g = g.add_edge_attrs(frame(spark, [(to[a], to[b], k, v) for a, b, k, v in rule.added_edge_attrs], "edge_attrs"))
    return g
