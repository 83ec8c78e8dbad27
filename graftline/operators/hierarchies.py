"""Hierarchies: graphs of any number of levels, typed by maps and linked by relations, rewritten with propagation.

The skeleton (which graph is typed by which) and the rules are small and live on the driver; graphs, typings and relations are tables. A rewrite
sends each graph through one fan table (old, p, new): what a node becomes, once for each copy. Typings follow by joining the fans of both ends."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.graph import Graph
from graftline.operators import category
from graftline.operators.pattern import Pattern, match
from graftline.operators.rewrite import RewritingError, Rule, check_instance, expand, free_ids, lacking, places, rewrite

FAN = "old string, p string, new string"


class HierarchyError(ValueError):
    """A typing, relation or rewrite that the hierarchy doesn't allow."""


@dataclass
class Hierarchy:
    graphs: dict[str, Graph] = field(default_factory=dict)
    typings: dict[tuple[str, str], DataFrame] = field(default_factory=dict)  # (old, new)
    relations: dict[tuple[str, str], DataFrame] = field(default_factory=dict)  # (left, right), once for each pair of graphs
    attrs: dict[str, dict] = field(default_factory=dict)
    typing_attrs: dict[tuple[str, str], dict] = field(default_factory=dict)
    relation_attrs: dict[tuple[str, str], dict] = field(default_factory=dict)
    rules: dict[str, Rule] = field(default_factory=dict)
    rule_attrs: dict[str, dict] = field(default_factory=dict)
    rule_typings: dict[tuple[str, str], tuple[dict[str, str], dict[str, str]]] = field(default_factory=dict)  # (rule, graph): types of nodes of L, of R

    # -- catalogue -----------------------------------------------------------------------------------------------------------
    def successors(self, graph: str) -> list[str]:
        return [t for s, t in self.typings if s == graph]

    def predecessors(self, graph: str) -> list[str]:
        return [s for s, t in self.typings if t == graph]

    def _reach(self, graph: str, step) -> list[str]:
        out, left = [], step(graph)
        while left:
            x = left.pop(0)
            if x not in out:
                out.append(x)
                left += step(x)
        return out

    def above(self, graph: str) -> list[str]:
        """Graphs that type it, through any number of typings."""
        return self._reach(graph, self.successors)

    def below(self, graph: str) -> list[str]:
        return self._reach(graph, self.predecessors)

    def get_ancestors(self, graph: str) -> dict[str, DataFrame]:
        """Graphs below with their composed typings."""
        return {h: self.get_typing(h, graph) for h in self.below(graph)}

    def get_descendants(self, graph: str) -> dict[str, DataFrame]:
        """Graphs above with the composed typings into them."""
        return {t: self.get_typing(graph, t) for t in self.above(graph)}

    def is_graph(self, name: str) -> bool:
        return name in self.graphs

    def is_rule(self, name: str) -> bool:
        return name in self.rules

    def is_typing(self, source: str, target: str) -> bool:
        return (source, target) in self.typings

    def is_rule_typing(self, rule: str, graph: str) -> bool:
        return (rule, graph) in self.rule_typings

    def set_graph_attrs(self, name: str, attrs: dict) -> None:
        self._known(name)
        self.attrs[name] = dict(attrs)

    def set_typing_attrs(self, source: str, target: str, attrs: dict) -> None:
        if (source, target) not in self.typings:
            raise HierarchyError(f"no typing {source} -> {target}")
        self.typing_attrs[source, target] = dict(attrs)

    def get_typing_attrs(self, source: str, target: str) -> dict:
        return self.typing_attrs.get((source, target), {})

    def set_relation_attrs(self, left: str, right: str, attrs: dict) -> None:
        self.relation_attrs[self._relation(left, right)] = dict(attrs)

    def get_relation_attrs(self, left: str, right: str) -> dict:
        return self.relation_attrs.get(self._relation(left, right), {})

    def _known(self, name: str) -> None:
        if name not in self.graphs:
            raise HierarchyError(f"no graph {name}")

    def _relation(self, left: str, right: str) -> tuple[str, str]:
        for k in ((left, right), (right, left)):
            if k in self.relations:
                return k
        raise HierarchyError(f"no relation {left} - {right}")

    def add_empty_graph(self, spark, name: str, attrs: dict | None = None) -> None:
        none = lambda kind: spark.createDataFrame([], kind)
        self.add_graph(name, Graph(none("node_id string"), none("src string, dst string"), none("node_id string, key string, value string"), none("src string, dst string, key string, value string")), attrs)

    def add_graph_from_data(self, spark, name: str, nodes: list[tuple[str, dict]], edges: list[tuple[str, str, dict]], attrs: dict | None = None) -> None:
        """nodes (id, key -> values), edges (source, target, key -> values), as few as a program holds."""
        rows = lambda items: [(*x[:-1], k, v) for x in items for k, vs in x[-1].items() for v in vs]
        make = spark.createDataFrame
        self.add_graph(name, Graph(make([(x[0],) for x in nodes], "node_id string"), make([x[:2] for x in edges], "src string, dst string"), make(rows(nodes), "node_id string, key string, value string"), make(rows(edges), "src string, dst string, key string, value string")), attrs)

    def duplicate_subgraph(self, names: dict[str, str], attach: list[str] | None = None) -> None:
        """Copies of the graphs, old name -> new, with the typings and relations between them, and typings by the graphs in `attach`."""
        for old, new in names.items():
            self._known(old)
            self.add_graph(new, self.graphs[old], dict(self.attrs.get(old, {})))
        for (s, t), m in list(self.typings.items()):
            if s in names and (t in names or t in (attach or [])):
                self.typings[names[s], names.get(t, t)] = m
        for (a, b), r in list(self.relations.items()):
            if a in names and b in names:
                self.relations[names[a], names[b]] = r

    def equal(self, other: Hierarchy) -> bool:
        """The same graphs, typings, relations and rules by name and attributes, with the same rows."""
        said = lambda h, x: {k: v for k, v in getattr(h, x).items() if v}
        if any(said(self, x) != said(other, x) for x in ("attrs", "typing_attrs", "relation_attrs", "rules", "rule_typings")) or self.graphs.keys() != other.graphs.keys() or self.typings.keys() != other.typings.keys():
            return False
        if {frozenset(k) for k in self.relations} != {frozenset(k) for k in other.relations}:
            return False
        same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
        return (
            all(g.equal(other.graphs[k]).first().equal for k, g in self.graphs.items())
            and all(same(m, other.typings[k]) for k, m in self.typings.items())
            and all(same(self.get_relation(*k), other.get_relation(*k)) for k in self.relations)
        )

    # -- rules as members ------------------------------------------------------------------------------------------------
    def add_rule(self, name: str, rule: Rule, attrs: dict | None = None) -> None:
        if name in self.rules or name in self.graphs:
            raise HierarchyError(f"{name} exists")
        self.rules[name], self.rule_attrs[name] = rule, attrs or {}

    def get_rule(self, name: str) -> Rule:
        if name not in self.rules:
            raise HierarchyError(f"no rule {name}")
        return self.rules[name]

    def remove_rule(self, name: str) -> None:
        self.get_rule(name)
        del self.rules[name], self.rule_attrs[name]
        self.rule_typings = {k: v for k, v in self.rule_typings.items() if k[0] != name}

    def add_rule_typing(self, rule: str, graph: str, lhs: dict[str, str], rhs: dict[str, str] | None = None, lhs_total: bool = False, rhs_total: bool = False) -> None:
        """Types of a rule's nodes in a graph. Nodes of R that come from typed nodes of L have their types; nodes of different types can't be merged, and
        what edges and attributes typed nodes have their types must have."""
        self._known(graph)
        r, rhs = self.get_rule(rule), dict(rhs or {})
        for p, x in r.p_r.items():
            t = lhs.get(r.p_l[p])
            if t is not None and rhs.setdefault(x, t) != t:
                raise HierarchyError(f"node {x} of the rule would have types {rhs[x]} and {t}")
        if lhs_total and set(r.l_nodes) - lhs.keys():
            raise HierarchyError("the typing of the left side isn't total")
        if rhs_total and set(r.r_nodes) - rhs.keys():
            raise HierarchyError("the typing of the right side isn't total")
        wanted = {"nodes": [(t,) for t in [*lhs.values(), *rhs.values()]], "edges": [], "node_attrs": [], "edge_attrs": []}
        for types, edges, attrs, edge_attrs in ((lhs, r.l_edges, r.l_attrs, r.l_edge_attrs), (rhs, r.added_edges, r.added_attrs, r.added_edge_attrs)):
            wanted["edges"] += [(types[a], types[b]) for a, b in edges if a in types and b in types]
            wanted["node_attrs"] += [(types[n], k, v) for n, k, v in attrs if n in types]
            wanted["edge_attrs"] += [(types[a], types[b], k, v) for a, b, k, v in edge_attrs if a in types and b in types]
        bad = lacking(self.graphs[graph], wanted).first()
        if bad is not None:
            raise HierarchyError(f"{graph} lacks {bad.problem}: {bad.at}")
        self.rule_typings[rule, graph] = (dict(lhs), rhs)

    def get_rule_typing(self, rule: str, graph: str) -> tuple[dict[str, str], dict[str, str]]:
        return self.rule_typings[rule, graph]

    def find_rule_matching(self, graph: str, rule: str) -> DataFrame:
        """Matches of a rule's left side whose nodes have the types that the rule's typings give them."""
        r = self.get_rule(rule)
        held = lambda rows, ends: {k: vs for x in rows for k, vs in [(x[ends], sorted({y[-1] for y in rows if y[:-1] == x[:-1]}))]}
        nodes = {n: held([x for x in r.l_attrs if x[0] == n], 1) for n in r.l_nodes}
        edges = {e: held([x for x in r.l_edge_attrs if x[:2] == e], 2) for e in r.l_edges}
        typing = {t: lhs for (name, t), (lhs, _) in self.rule_typings.items() if name == rule and t in self.above(graph)}
        return self.find_matching(graph, Pattern(nodes, edges), typing, product=True)

    def apply_rule(self, graph: str, rule: str, instance: dict[str, str], strict: bool = False) -> dict[str, str]:
        """Rewrites by a rule that is a member; its added nodes have the types that its typings say."""
        r = self.get_rule(rule)
        added = [x for x in r.r_nodes if x not in r.p_r.values()]
        typing = {t: {x: (rhs[x],) for x in added if x in rhs} for (name, t), (_, rhs) in self.rule_typings.items() if name == rule and t in self.above(graph)}
        return self.rewrite(graph, r, instance, rhs_typing=typing, strict=strict)

    def shortest_path(self, source: str, target: str) -> list[str] | None:
        paths = [[source]]
        while paths:
            path = paths.pop(0)
            if path[-1] == target:
                return path
            paths += [[*path, t] for t in self.successors(path[-1])]
        return None

    def add_graph(self, name: str, graph: Graph, attrs: dict | None = None) -> None:
        if name in self.graphs:
            raise HierarchyError(f"graph {name} exists")
        self.graphs[name] = graph
        self.attrs[name] = attrs or {}

    def add_typing(self, source: str, target: str, mapping: DataFrame, check: bool = True) -> None:
        """mapping (old, new): total, keeping edges and attributes, without a cycle, and equal to what other paths say."""
        for g in (source, target):
            if g not in self.graphs:
                raise HierarchyError(f"no graph {g}")
        if (source, target) in self.typings:
            raise HierarchyError(f"typing {source} -> {target} exists")
        if source == target or source in self.above(target):
            raise HierarchyError(f"typing {source} -> {target} closes a cycle")
        mapping = mapping.select("old", "new")
        if check:
            bad = category.map_violations(self.graphs[source], self.graphs[target], mapping).first()
            if bad:
                raise HierarchyError(f"typing {source} -> {target}: {bad.problem} at {bad.at}")
            for low in [source, *self.below(source)]:
                for high in [target, *self.above(target)]:
                    if self.shortest_path(low, high):
                        one, two = self.get_typing(low, high), mapping
                        if low != source:
                            two = category.compose(self.get_typing(low, source), two)
                        if high != target:
                            two = category.compose(two, self.get_typing(target, high))
                        if not one.exceptAll(two).unionAll(two.exceptAll(one)).isEmpty():
                            raise HierarchyError(f"paths from {low} to {high} don't commute")
        self.typings[source, target] = mapping

    def get_typing(self, source: str, target: str) -> DataFrame:
        """The typing along a shortest path."""
        path = self.shortest_path(source, target)
        if path is None or len(path) == 1:
            raise HierarchyError(f"no typing {source} -> {target}")
        out = self.typings[path[0], path[1]]
        for a, b in zip(path[1:], path[2:]):
            out = category.compose(out, self.typings[a, b])
        return out

    def add_relation(self, left: str, right: str, pairs: DataFrame) -> None:
        if {(left, right), (right, left)} & self.relations.keys():
            raise HierarchyError(f"relation {left} - {right} exists")
        lost = pairs.join(self.graphs[left].nodes, F.col("left") == F.col("node_id"), "left_anti").unionByName(pairs.join(self.graphs[right].nodes, F.col("right") == F.col("node_id"), "left_anti"))
        if not lost.isEmpty():
            raise HierarchyError(f"relation {left} - {right} names nodes that aren't there")
        self.relations[left, right] = pairs.select("left", "right").distinct()

    def get_relation(self, left: str, right: str) -> DataFrame:
        if (left, right) in self.relations:
            return self.relations[left, right]
        return self.relations[self._relation(left, right)].select(F.col("right").alias("left"), F.col("left").alias("right"))

    def set_node_relation(self, left: str, right: str, left_node: str, right_node: str) -> None:
        """One more related pair; the relation is made if there is none."""
        spark = self.graphs[left].nodes.sparkSession
        pair = spark.createDataFrame([(left_node, right_node)], "left string, right string")
        if (left, right) in self.relations or (right, left) in self.relations:
            pair = self.get_relation(left, right).unionByName(pair)
            self.remove_relation(left, right)
        self.add_relation(left, right, pair)

    def adjacent_relations(self, graph: str) -> list[str]:
        return [b if a == graph else a for a, b in self.relations if graph in (a, b)]

    def remove_typing(self, source: str, target: str) -> None:
        if (source, target) not in self.typings:
            raise HierarchyError(f"no typing {source} -> {target}")
        del self.typings[source, target]
        self.typing_attrs.pop((source, target), None)

    def remove_relation(self, left: str, right: str) -> None:
        key = self._relation(left, right)
        del self.relations[key]
        self.relation_attrs.pop(key, None)

    def remove_graph(self, name: str, reconnect: bool = False) -> None:
        """With reconnect, graphs typed by it are typed by its types."""
        self._known(name)
        if reconnect:
            for s in self.predecessors(name):
                for t in self.successors(name):
                    self.typings.setdefault((s, t), category.compose(self.typings[s, name], self.typings[name, t]))
        self.graphs.pop(name)
        self.attrs.pop(name, None)
        out = lambda held: {k: v for k, v in held.items() if name not in k}
        self.typing_attrs, self.relation_attrs, self.rule_typings = out(self.typing_attrs), out(self.relation_attrs), out(self.rule_typings)
        self.typings = {k: v for k, v in self.typings.items() if name not in k}
        self.relations = {k: v for k, v in self.relations.items() if name not in k}

    def copy_graph(self, name: str, new: str, attach: list[str] | None = None) -> None:
        self.add_graph(new, self.graphs[name], dict(self.attrs[name]))
        for t in self.successors(name) if attach is None else attach:
            self.typings[new, t] = self.get_typing(name, t)

    def relabel_graph(self, name: str, new: str) -> None:
        if new in self.graphs:
            raise HierarchyError(f"graph {new} exists")
        to = lambda k: tuple(new if x == name else x for x in k)
        self.graphs = {new if k == name else k: v for k, v in self.graphs.items()}
        self.attrs = {new if k == name else k: v for k, v in self.attrs.items()}
        for held in ("typings", "relations", "typing_attrs", "relation_attrs", "rule_typings"):
            setattr(self, held, {to(k): v for k, v in getattr(self, held).items()})

    def relabel_nodes(self, name: str, moved: DataFrame) -> None:
        """moved (old, new), one to one; typings and relations follow."""
        self._follow({name: moved.select("old", F.lit(None).cast("string").alias("p"), "new")}, {})
        self.graphs[name] = self.graphs[name].rename(moved)

    def node_type(self, graph: str, node: str) -> dict[str, str]:
        """The node's type in each graph that types its graph directly."""
        rows = {t: self.typings[graph, t].filter(F.col("old") == node).first() for t in self.successors(graph)}
        return {t: r.new for t, r in rows.items() if r}

    def graphs_typed_by_node(self, graph: str, node: str) -> list[str]:
        return [s for s in self.predecessors(graph) if not self.typings[s, graph].filter(F.col("new") == node).isEmpty()]

    def find_matching(self, graph: str, pattern: Pattern, typing: dict[str, dict[str, str]] | None = None, product: bool = False) -> DataFrame:
        """Matches whose nodes have the given types: typing graph -> pattern node -> type."""
        out = match(self.graphs[graph], pattern, product=product)
        for t, types in (typing or {}).items():
            m = self.get_typing(graph, t)
            for n, wanted in types.items():
                out = out.join(m.filter(F.col("new") == wanted).select(F.col("old").alias(n)), n, "left_semi")
        return out.select(*pattern.nodes)

    def relation_to_span(self, left: str, right: str) -> tuple[DataFrame, DataFrame]:
        return category.relation_to_span(self.graphs[left], self.graphs[right], self.get_relation(left, right))

    # -- rewriting -----------------------------------------------------------------------------------------------------------
    def _follow(self, fans: dict[str, DataFrame], gone: dict[str, DataFrame]) -> None:
        """Sends typings and relations along the fans; rows of nodes that are gone go. Copies of both ends meet only under the same p."""

        def end(df: DataFrame, side: str, graph: str) -> DataFrame:
            if graph in gone:
                df = df.join(gone[graph].select(F.col("node_id").alias(side)), side, "left_anti")
            if graph not in fans:
                return df.withColumn(f"p_{side}", F.lit(None).cast("string"))
            fan = fans[graph].select(F.col("old").alias(side), F.col("p").alias(f"p_{side}"), F.col("new").alias(f"to_{side}"))
            return df.join(fan, side, "left").withColumn(side, F.coalesce(f"to_{side}", side)).drop(f"to_{side}")

        for kind, (a, b) in ((self.typings, ("old", "new")), (self.relations, ("left", "right"))):
            for s, t in list(kind):
                if {s, t} & (fans.keys() | gone.keys()):
                    df = end(end(kind[s, t], a, s), b, t)
                    agree = F.col(f"p_{a}").isNull() | F.col(f"p_{b}").isNull() | (F.col(f"p_{a}") == F.col(f"p_{b}"))
                    kind[s, t] = df.filter(agree).select(a, b).distinct()

    def _types(self, graph: str, rule: Rule, instance: dict[str, str], rhs_typing: dict) -> tuple[list[str], dict[str, dict[str, set[str]]]]:
        """The graphs above, each after those that it types, and what R's nodes are typed by in each; rule-sized."""
        spark = self.graphs[graph].nodes.sparkSession
        above = self.above(graph)
        order = sorted(above, key=lambda g: len(self._reach(g, self.predecessors)))
        types: dict[str, dict[str, set[str]]] = {graph: {r: {instance[rule.p_l[p]] for p, x in rule.p_r.items() if x == r} for r in rule.r_nodes}}
        for t in order:
            types[t] = {r: set(map(str, _listed(rhs_typing.get(t, {}).get(r, ())))) for r in rule.r_nodes}
            for s in [x for x in self.predecessors(t) if x in types]:
                ids = {n for ns in types[s].values() for n in ns}
                asked = F.broadcast(spark.createDataFrame([(i,) for i in ids], "old string"))
                up = {x.old: x.new for x in self.typings[s, t].join(asked, "old").collect()} if ids else {}
                for r in rule.r_nodes:
                    types[t][r] |= {up[n] for n in types[s][r] if n in up}
        return order, types

    def _check_typing(self, graph: str, rule: Rule, instance: dict[str, str], p_typing: dict, rhs_typing: dict) -> None:
        """Raises RewritingError for a typing by P or of R that retypes nodes or that neighbouring typings contradict."""
        copies = {l: {p for p, x in rule.p_l.items() if x == l} for l in rule.l_nodes}
        given = {h: {n: set(_listed(ps)) for n, ps in own.items()} for h, own in p_typing.items()}
        spark = self.graphs[graph].nodes.sparkSession
        up = lambda s, t, ids: {x.old: x.new for x in self.get_typing(s, t).join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "old string")), "old").collect()} if ids else {}
        for h, own in given.items():
            if h not in self.below(graph):
                raise RewritingError(f"{h} isn't typed by {graph}")
            typed = up(h, graph, own)
            for n, ps in own.items():
                for p in ps:
                    if p not in rule.p_l:
                        raise RewritingError(f"{p} is no node of P")
                    if typed.get(n) != instance[rule.p_l[p]]:
                        raise RewritingError(f"node {n} of {h} is typed by {typed.get(n)}, {p} by {instance[rule.p_l[p]]}")
            for pred in self.predecessors(h):
                if pred not in given and any(ps != copies[rule.p_l[min(ps)]] for ps in own.values() if ps):
                    raise RewritingError(f"{pred} is cloned without control, {h}, which types it, isn't")
            for suc in [x for x in self.successors(h) if x in given]:
                types = up(h, suc, own)
                for n, ps in own.items():
                    if types.get(n) in given[suc] and not ps <= given[suc][types[n]]:
                        raise RewritingError(f"node {n} of {h} keeps more copies than its type in {suc}")
        own = {r: {instance[rule.p_l[p]] for p, x in rule.p_r.items() if x == r} for r in rule.r_nodes}
        for t, types in rhs_typing.items():
            if t not in self.above(graph):
                raise RewritingError(f"{t} doesn't type {graph}")
            wanted = {r: set(_listed(x)) for r, x in types.items()}
            if unknown := wanted.keys() - set(rule.r_nodes):
                raise RewritingError(f"{min(unknown)} is no node of R")
            known = up(graph, t, {n for r in wanted for n in own[r]})
            for r, ts in wanted.items():
                if own[r] and {known[n] for n in own[r] if n in known} != ts:
                    raise RewritingError(f"node {r} of R isn't typed by {sorted(ts)} in {t}")
            bad = lacking(self.graphs[t], {"nodes": [(x,) for ts in wanted.values() for x in ts]}).first()
            if bad is not None:
                raise RewritingError(f"{t} has no node {bad.at}")
            for higher in [x for x in self.above(t) if x in rhs_typing]:
                types_up = up(t, higher, {x for ts in wanted.values() for x in ts})
                for r, ts in wanted.items():
                    stated = set(_listed(rhs_typing[higher].get(r, ())))
                    if stated and not {types_up[x] for x in ts if x in types_up} <= stated:
                        raise RewritingError(f"types of {r} in {t} aren't typed by {sorted(stated)} in {higher}")

    def rewrite(self, graph: str, rule: Rule, instance: dict[str, str] | None = None, p_typing: dict | None = None, rhs_typing: dict | None = None, strict: bool = False) -> dict[str, str]:
        """Rewrites a graph; what it loses or clones is lost and cloned in graphs below, what it merges or gains is merged and gained above.

        p_typing: graph below -> node -> nodes of P that it keeps (copies it gets); other nodes get all. rhs_typing: graph above -> node of R ->
        its types (one: that; several: they are merged); an added node without one gets a new type. strict: raises if another graph would change.
        -> where R's nodes are in the graph. Nothing is changed if it raises: an instance or typing that doesn't fit is a RewritingError."""
        self._known(graph)
        p_typing, rhs_typing = p_typing or {}, rhs_typing or {}
        instance = {x: x for x in rule.l_nodes} if instance is None else instance
        check_instance(self.graphs[graph], rule, instance)
        self._check_typing(graph, rule, instance, p_typing, rhs_typing)
        spark = self.graphs[graph].nodes.sparkSession
        small = lambda rows, schema: F.broadcast(spark.createDataFrame(list(rows), schema))
        copies = {l: sorted(p for p, x in rule.p_l.items() if x == l) for l in rule.l_nodes}
        cloned = {l: ps for l, ps in copies.items() if len(ps) > 1}
        removed = [instance[l] for l, ps in copies.items() if not ps]
        below = self.below(graph)
        at, to = places(self.graphs[graph], rule, instance)
        typing = {h: self.get_typing(h, graph) for h in below}
        order, types = self._types(graph, rule, instance, rhs_typing)
        grown = {t: [r for r in rule.r_nodes if not types[t][r]] for t in order}
        if strict:
            bad = self.strict_violations(graph, rule, instance, p_typing, rhs_typing).first()
            if bad is not None:
                raise HierarchyError(f"strict: {bad.graph} would change: {bad.problem} {bad.at}")
        # below: copies, losses
        fans: dict[str, DataFrame] = {}
        gone: dict[str, DataFrame] = {}
        changed: dict[str, Graph] = {}
        fan_rows = [(instance[l], p, at[p]) for l, ps in cloned.items() for p in ps]
        fans[graph] = small(fan_rows, FAN)
        if removed:
            gone[graph] = small([(n,) for n in removed], "node_id string")
        for h in below:
            g = self.graphs[h]
            if removed:
                gone[h] = category.inverse_image(typing[h], gone[graph])
                g = g.remove_nodes(gone[h])
            if cloned:
                first = small([(instance[l], p, k == 0) for l, ps in cloned.items() for k, p in enumerate(ps)], "new string, p string, first boolean")
                spread = typing[h].join(first, "new")
                control = [(n, p) for n, ps in p_typing.get(h, {}).items() for p in _listed(ps)]
                if control:
                    c = small(control, "old string, p string")
                    ruled = F.broadcast(c.select("old").distinct())
                    spread = spread.join(c, ["old", "p"], "left_semi").unionByName(spread.join(ruled, "old", "left_anti").select("old", "p", "new", "first"))
                    single = small([(n,) for n, ps in p_typing[h].items() if len(_listed(ps)) == 1], "old string").withColumn("single", F.lit(True))
                    spread = spread.join(single, "old", "left").withColumn("first", F.col("first") | F.coalesce("single", F.lit(False))).drop("single")
                fans[h] = spread.select("old", "p", F.when(F.col("first"), F.col("old")).otherwise(F.concat("old", F.lit("#"), "p")).alias("new"))
                g = g.rename(fans[h].select("old", "new"))
            changed[h] = g
        saved = dict(self.typings), dict(self.relations)
        try:
            self._follow(fans, gone)
            base, _ = rewrite(self.graphs[graph], _restrictive(rule), instance, check=False, named=(at, at))
            for h in below:
                m = self.get_typing(h, graph)
                g = changed[h]
                if cloned or rule.removed_edges:
                    bad = category.homomorphism_violations(g, base, m)
                    g = g.remove_edges(bad)
                if rule.removed_attrs:
                    lost = small([(at[p], k, v) for p, k, v in rule.removed_attrs], "new string, key string, value string")
                    g = g.remove_node_attrs(m.join(lost, "new").select(F.col("old").alias("node_id"), "key", "value"))
                if rule.removed_edge_attrs:
                    lost = small([(at[a], at[b], k, v) for a, b, k, v in rule.removed_edge_attrs], "s string, d string, key string, value string")
                    end = lambda c, x: m.select(F.col("old").alias(c), F.col("new").alias(x))  # noqa: B023, E731
                    g = g.with_(edge_attrs=g.edge_attrs.join(g.edge_attrs.join(end("src", "s"), "src").join(end("dst", "d"), "dst").join(lost, ["s", "d", "key", "value"], "left_semi").select("src", "dst", "key", "value"), ["src", "dst", "key", "value"], "left_anti"))
                changed[h] = g
            # the graph itself, then above: merges, gains
            out, to = rewrite(self.graphs[graph], rule, instance, check=False, named=(at, to))
            put = {graph: to}
            up_fans = {graph: small([(at[p], None, to[r]) for p, r in rule.p_r.items() if at[p] != to[r]], FAN)}
            for t in order:
                leader = _leaders(types[t].values())
                new = free_ids(self.graphs[t], [f"new:{rule.name}:{r}" for r in grown[t]])
                put[t] = {r: leader[min(types[t][r])] if types[t][r] else new[f"new:{rule.name}:{r}"] for r in rule.r_nodes}
                up_fans[t] = small([(n, None, m) for n, m in leader.items() if n != m], FAN)
                g = self.graphs[t]
                if any(n != m for n, m in leader.items()):
                    g = g.rename(small(leader.items(), "old string, new string"), closed=True)
                changed[t] = expand(g, rule, put[t], grown[t])
            self._follow(up_fans, {})
            added = [r for r in rule.r_nodes if r not in rule.p_r.values()]
            for s, t in list(self.typings):
                if s in put and t in put:
                    fresh = [(put[s][r], put[t][r]) for r in rule.r_nodes if (r in added if s == graph else r in grown[s])]
                    if fresh:
                        self.typings[s, t] = self.typings[s, t].unionByName(small(fresh, "old string, new string")).distinct()
        except Exception:
            self.typings, self.relations = saved
            raise
        self.graphs[graph] = out
        self.graphs.update(changed)
        return to

    def strict_violations(self, graph: str, rule: Rule, instance: dict[str, str], p_typing: dict | None = None, rhs_typing: dict | None = None) -> DataFrame:
        """(graph, problem, at): what rewriting would change in other graphs. Below: instances of removed and cloned nodes (but for those that keep one copy by p_typing), and of removed
        edges and attributes. Above: types that would be merged, and nodes, edges and attributes that are added and not there."""
        p_typing, rhs_typing = p_typing or {}, rhs_typing or {}
        spark = self.graphs[graph].nodes.sparkSession
        small = lambda rows, schema: F.broadcast(spark.createDataFrame(sorted(set(rows)), schema))
        copies = {l: [p for p, x in rule.p_l.items() if x == l] for l in rule.l_nodes}
        of = lambda p: instance[rule.p_l[p]]
        parts = []
        for h, m in self.get_ancestors(graph).items():
            told = lambda df, problem, *cols: df.select(F.lit(h).alias("graph"), F.lit(problem).alias("problem"), F.concat_ws(" ", *cols).alias("at"))  # noqa: B023, E731
            g, ends = self.graphs[h], lambda df: df.join(m.select(F.col("old").alias("src"), F.col("new").alias("s")), "src").join(m.select(F.col("old").alias("dst"), F.col("new").alias("d")), "dst")  # noqa: B023, E731
            parts.append(told(m.join(small([(instance[l],) for l, ps in copies.items() if not ps], "new string"), "new", "left_semi"), "removed node", "old"))
            held = small([(n,) for n, ps in p_typing.get(h, {}).items() if len(_listed(ps)) == 1], "old string")
            parts.append(told(m.join(small([(instance[l],) for l, ps in copies.items() if len(ps) > 1], "new string"), "new", "left_semi").join(held, "old", "left_anti"), "cloned node", "old"))
            if rule.removed_edges:
                parts.append(told(ends(g.edges).join(small([(of(a), of(b)) for a, b in rule.removed_edges], "s string, d string"), ["s", "d"], "left_semi"), "removed edge", "src", "dst"))
            if rule.removed_attrs:
                parts.append(told(g.node_attrs.join(m.select(F.col("old").alias("node_id"), "new"), "node_id").join(small([(of(p), k, v) for p, k, v in rule.removed_attrs], "new string, key string, value string"), ["new", "key", "value"], "left_semi"), "removed attribute", "node_id", "key", "value"))
            if rule.removed_edge_attrs:
                parts.append(told(ends(g.edge_attrs).join(small([(of(a), of(b), k, v) for a, b, k, v in rule.removed_edge_attrs], "s string, d string, key string, value string"), ["s", "d", "key", "value"], "left_semi"), "removed edge attribute", "src", "dst", "key", "value"))
        order, types = self._types(graph, rule, instance, rhs_typing)
        for t in order:
            rows = [(t, "merged types", r) for r, ts in types[t].items() if len(ts) > 1] + [(t, "added node", r) for r, ts in types[t].items() if not ts]
            parts.append(spark.createDataFrame(rows, "graph string, problem string, at string"))
            one = {r: min(ts) for r, ts in types[t].items() if ts}
            wanted = {
                "edges": [(one[a], one[b]) for a, b in rule.added_edges if a in one and b in one],
                "node_attrs": [(one[r], k, v) for r, k, v in rule.added_attrs if r in one],
                "edge_attrs": [(one[a], one[b], k, v) for a, b, k, v in rule.added_edge_attrs if a in one and b in one],
            }
            parts.append(lacking(self.graphs[t], wanted).select(F.lit(t).alias("graph"), F.concat(F.lit("added "), "problem").alias("problem"), "at"))
        none = spark.createDataFrame([], "graph string, problem string, at string")
        return reduce(DataFrame.unionByName, parts, none)


def _listed(x) -> list:
    return [x] if isinstance(x, str) else list(x)


def _leaders(groups) -> dict[str, str]:
    """Each member's least fellow over groups that may overlap; rule-sized."""
    top: dict[str, str] = {}

    def find(x: str) -> str:
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for g in groups:
        for x in g:
            a, b = find(x), find(min(g))
            top[max(a, b)] = min(a, b)
    return {x: find(x) for x in top}


def _restrictive(rule: Rule) -> Rule:
    """The rule without what it adds and merges."""
    ps = tuple(rule.p_l)
    return Rule(rule.l_nodes, rule.p_l, {p: p for p in ps}, ps, rule.removed_edges, (), rule.removed_attrs, (), rule.name, rule.removed_edge_attrs)
