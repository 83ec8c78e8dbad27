"""Attributed directed graphs as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GraphError(ValueError):
    """A change that the graph as it is doesn't allow."""


def _first(df: DataFrame, said) -> None:
    """Raises GraphError if df has a row."""
    row = df.first()
    if row is not None:
        raise GraphError(said(row))


@dataclass(frozen=True)
class Graph:
    """A simple directed graph; attributes are sets of values, one row for each value, and stay out of joins that don't ask for them.

    nodes (node_id), edges (src, dst), node_attrs (node_id, key, value), edge_attrs (src, dst, key, value); rows are distinct, all are strings."""

    nodes: DataFrame
    edges: DataFrame
    node_attrs: DataFrame
    edge_attrs: DataFrame

    def with_(self, **parts: DataFrame) -> Graph:
        return replace(self, **parts)

    # -- filters ---------------------------------------------------------------------------------------------------------
    def subgraph(self, chosen: DataFrame) -> Graph:
        """The graph induced on chosen (node_id)."""
        nodes = self.nodes.join(chosen.select("node_id"), "node_id", "left_semi")
        return self._on(nodes)

    def _on(self, nodes: DataFrame) -> Graph:
        def both(edges: DataFrame) -> DataFrame:
            return edges.join(nodes.select(F.col("node_id").alias("src")), "src", "left_semi").join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(*edges.columns)

        return Graph(nodes, both(self.edges), self.node_attrs.join(nodes, "node_id", "left_semi"), both(self.edge_attrs))

    def nodes_with(self, attrs: dict[str, list[str]]) -> DataFrame:
        """Nodes whose sets contain all the given values."""
        wanted = [(k, v) for k, vs in attrs.items() for v in vs]
        if not wanted:
            return self.nodes
        test = F.lit(False)
        for k, v in wanted:
            test = test | ((F.col("key") == k) & (F.col("value") == v))
        return self.node_attrs.filter(test).groupBy("node_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(set(wanted))).select("node_id")

    def edges_with(self, attrs: dict[str, list[str]]) -> DataFrame:
        wanted = [(k, v) for k, vs in attrs.items() for v in vs]
        if not wanted:
            return self.edges
        test = F.lit(False)
        for k, v in wanted:
            test = test | ((F.col("key") == k) & (F.col("value") == v))
        return self.edge_attrs.filter(test).groupBy("src", "dst").agg(F.count("*").alias("n")).filter(F.col("n") == len(set(wanted))).select("src", "dst")

    def filter_edges(self, key: str, condition) -> Graph:
        """Drops edges without the attribute or whose sorted array of its values fails the condition, a function of a column. Attributes are of edges that are there, so those that pass are the edges."""
        ok = self.edge_attrs.filter(F.col("key") == key).groupBy("src", "dst").agg(F.sort_array(F.collect_set("value")).alias("values")).filter(condition(F.col("values"))).select("src", "dst")
        return self.with_(edges=ok, edge_attrs=self.edge_attrs.join(ok, ["src", "dst"], "left_semi"))

    def filter_edges_holding(self, key: str, value: str) -> Graph:
        """Keeps the edges whose set has the value: one aggregation without gathering sets."""
        ok = self.edge_attrs.filter(F.col("key") == key).groupBy("src", "dst").agg(F.bool_or(F.col("value") == value).alias("ok")).filter("ok").select("src", "dst")
        return self.with_(edges=ok, edge_attrs=self.edge_attrs.join(ok, ["src", "dst"], "left_semi"))

    # -- lookups ---------------------------------------------------------------------------------------------------------
    def get_node(self, node: str) -> DataFrame:
        """(key, values) of one node, values sorted."""
        return _sets(self.node_attrs.filter(F.col("node_id") == node))

    def get_edge(self, src: str, dst: str) -> DataFrame:
        return _sets(self.edge_attrs.filter((F.col("src") == src) & (F.col("dst") == dst)))

    def exists_edge(self, src: str, dst: str) -> bool:
        return not self.edges.filter((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()

    def number_of_edges(self, src: str, dst: str) -> int:
        return int(self.exists_edge(src, dst))

    def out_edges(self, node: str) -> DataFrame:
        return self.edges.filter(F.col("src") == node)

    def in_edges(self, node: str) -> DataFrame:
        return self.edges.filter(F.col("dst") == node)

    # -- traversal -------------------------------------------------------------------------------------------------------
    def successors(self, node: str) -> DataFrame:
        return self.edges.filter(F.col("src") == node).select(F.col("dst").alias("node_id"))

    def predecessors(self, node: str) -> DataFrame:
        return self.edges.filter(F.col("dst") == node).select(F.col("src").alias("node_id"))

    def descendants(self, start: DataFrame, most: int | None = None) -> DataFrame:
        """Nodes reachable from start (node_id) by one edge or more; semi-naive rounds, each joined with new nodes only, until there are none.

        With `most`, an error if nodes are still new after so many rounds."""
        found = front = start.select("node_id").join(self.edges, F.col("node_id") == F.col("src")).select(F.col("dst").alias("node_id")).distinct()
        for i in count():
            front = front.join(self.edges, F.col("node_id") == F.col("src")).select(F.col("dst").alias("node_id")).distinct().join(found, "node_id", "left_anti").checkpoint()
            if front.isEmpty():
                return found
            if most is not None and i + 1 >= most:
                raise ValueError(f"nodes are still new after {most} rounds")
            found = found.unionByName(front)
            if i % 16 == 15:  # so that plans don't grow with the rounds
                found = found.checkpoint()

    def reverse(self) -> Graph:
        turned = [F.col("dst").alias("src"), F.col("src").alias("dst")]
        return self.with_(edges=self.edges.select(*turned), edge_attrs=self.edge_attrs.select(*turned, "key", "value"))

    def ancestors(self, start: DataFrame, most: int | None = None) -> DataFrame:
        return self.reverse().descendants(start, most)

    def disconnected_from(self, node: str, most: int | None = None) -> DataFrame:
        """Nodes that no path of edges, followed either way, links with the node."""
        one = self.nodes.filter(F.col("node_id") == node)
        both = self.edges.unionByName(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        near = self.with_(edges=both).descendants(one, most)
        return self.nodes.join(near, "node_id", "left_anti").join(one, "node_id", "left_anti")

    # -- changes ---------------------------------------------------------------------------------------------------------
    def add_nodes(self, rows: DataFrame, check: bool = False) -> Graph:
        """check: an error if one is there already."""
        if check:
            _first(rows.join(self.nodes, "node_id", "left_semi"), lambda r: f"node {r.node_id} exists")
        return self.with_(nodes=self.nodes.unionByName(rows.select("node_id")).distinct())

    def add_edges(self, rows: DataFrame, check: bool = False) -> Graph:
        """Adds edges between nodes of the graph; an edge that is there stays as it is. check: an error if one is there or lacks an end."""
        ends = rows.select("src", "dst").join(self.nodes.select(F.col("node_id").alias("src")), "src", "left_semi").join(self.nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst")
        if check:
            _first(rows.join(self.edges, ["src", "dst"], "left_semi"), lambda r: f"edge {r.src} -> {r.dst} exists")
            _first(rows.select("src", "dst").exceptAll(ends), lambda r: f"edge {r.src} -> {r.dst} lacks an end")
        return self.with_(edges=self.edges.unionByName(ends).distinct())

    def remove_nodes(self, rows: DataFrame, check: bool = False) -> Graph:
        """Removes nodes with their edges and attributes. check: an error if one isn't there."""
        if check:
            _first(rows.join(self.nodes, "node_id", "left_anti"), lambda r: f"no node {r.node_id}")
        return self._on(self.nodes.join(rows.select("node_id"), "node_id", "left_anti"))

    def remove_edges(self, rows: DataFrame, check: bool = False) -> Graph:
        gone = rows.select("src", "dst")
        if check:
            _first(gone.join(self.edges, ["src", "dst"], "left_anti"), lambda r: f"no edge {r.src} -> {r.dst}")
        return self.with_(edges=self.edges.join(gone, ["src", "dst"], "left_anti"), edge_attrs=self.edge_attrs.join(gone, ["src", "dst"], "left_anti"))

    def add_node_attrs(self, rows: DataFrame) -> Graph:
        return self.with_(node_attrs=self.node_attrs.unionByName(rows.select("node_id", "key", "value")).distinct())

    def remove_node_attrs(self, rows: DataFrame) -> Graph:
        return self.with_(node_attrs=self.node_attrs.join(rows, ["node_id", "key", "value"], "left_anti"))

    def set_node_attrs(self, rows: DataFrame) -> Graph:
        """The given sets take the place of those of the same nodes and keys."""
        kept = self.node_attrs.join(rows.select("node_id", "key"), ["node_id", "key"], "left_anti")
        return self.with_(node_attrs=kept.unionByName(rows.select("node_id", "key", "value")).distinct())

    def update_node_attrs(self, rows: DataFrame) -> Graph:
        """The given sets take the place of all that the same nodes have."""
        kept = self.node_attrs.join(rows.select("node_id"), "node_id", "left_anti")
        return self.with_(node_attrs=kept.unionByName(rows.select("node_id", "key", "value")).distinct())

    def add_edge_attrs(self, rows: DataFrame) -> Graph:
        """Rows of edges that aren't there are left out."""
        own = rows.select("src", "dst", "key", "value").join(self.edges, ["src", "dst"], "left_semi")
        return self.with_(edge_attrs=self.edge_attrs.unionByName(own).distinct())

    def remove_edge_attrs(self, rows: DataFrame) -> Graph:
        return self.with_(edge_attrs=self.edge_attrs.join(rows, ["src", "dst", "key", "value"], "left_anti"))

    def set_edge_attrs(self, rows: DataFrame) -> Graph:
        """The given sets take the place of those of the same edges and keys."""
        return self.with_(edge_attrs=self.edge_attrs.join(rows.select("src", "dst", "key"), ["src", "dst", "key"], "left_anti")).add_edge_attrs(rows)

    def update_edge_attrs(self, rows: DataFrame) -> Graph:
        return self.with_(edge_attrs=self.edge_attrs.join(rows.select("src", "dst"), ["src", "dst"], "left_anti")).add_edge_attrs(rows)

    def copy_node(self, node: str, copy: str) -> Graph:
        """A node with the same attributes and no edges."""
        own = self.node_attrs.filter(F.col("node_id") == node).withColumn("node_id", F.lit(copy))
        return self.with_(nodes=self.nodes.unionByName(self.nodes.filter(F.col("node_id") == node).select(F.lit(copy).alias("node_id"))).distinct(), node_attrs=self.node_attrs.unionByName(own).distinct())

    def rename(self, moved: DataFrame, closed: bool = False) -> Graph:
        """Sends each node along moved (old, new); nodes that aren't in it stay, one in it more than once is cloned, several with one new id are merged.

        Edges and attributes follow: clones get all of them, merged nodes the union; a clone's self-loop becomes all loops between the clones.
        Only the rows of moved nodes are deduplicated. closed: a new id that is a node's is an old one too; else such nodes are counted in."""
        if not closed:
            stay = moved.select(F.col("new").alias("old")).distinct().join(moved.select("old"), "old", "left_anti")
            moved = moved.select("old", "new").unionByName(stay.select("old", F.col("old").alias("new")))

        def sent(df: DataFrame, *ends: str) -> DataFrame:
            out, hit, new = df, F.lit(False), {}
            for c in ends:
                out = out.join(moved.select(F.col("old").alias(c), F.col("new").alias(f"__{c}")), c, "left")
                hit = hit | F.col(f"__{c}").isNotNull()
                new[c] = F.coalesce(f"__{c}", c).alias(c)
            touched = out.filter(hit).select(*[new.get(c, F.col(c)) for c in df.columns]).distinct()
            return out.filter(~hit).select(*df.columns).unionByName(touched)

        return Graph(sent(self.nodes, "node_id"), sent(self.edges, "src", "dst"), sent(self.node_attrs, "node_id"), sent(self.edge_attrs, "src", "dst"))

    def relabelled(self, moved: DataFrame) -> Graph:
        """A graph of the nodes in moved (old, new) alone, under their new ids."""
        return self.subgraph(moved.select(F.col("old").alias("node_id")).distinct()).rename(moved)

    def merge(self, moved: DataFrame, method: str = "union", edge_method: str = "union") -> Graph:
        """Nodes of moved (old, new) with one new id become one. Attributes: the union, or the values that all of the merged nodes (edge_method: all the edges that become one) have."""
        if {method, edge_method} - {"union", "intersection"}:
            raise GraphError("attributes are merged by union or intersection")
        moved = moved.select("old", "new").distinct()
        out = self.rename(moved)
        if method == "intersection":
            size = moved.join(self.nodes.withColumnRenamed("node_id", "old"), "old", "left_semi").groupBy("new").agg(F.count("*").alias("n"))
            own = self.node_attrs.withColumnRenamed("node_id", "old").join(moved, "old").groupBy("new", "key", "value").agg(F.count("*").alias("k")).join(size, "new").filter("k = n")
            kept = out.node_attrs.join(moved.select(F.col("new").alias("node_id")).distinct(), "node_id", "left_anti")
            out = out.with_(node_attrs=kept.unionByName(own.select(F.col("new").alias("node_id"), "key", "value")))
        if edge_method == "intersection":
            to = lambda df: df.join(moved.select(F.col("old").alias("src"), F.col("new").alias("s")), "src", "left").join(moved.select(F.col("old").alias("dst"), F.col("new").alias("d")), "dst", "left").withColumns({"s": F.coalesce("s", "src"), "d": F.coalesce("d", "dst")})
            size = to(self.edges).groupBy("s", "d").agg(F.count("*").alias("n"))
            own = to(self.edge_attrs).groupBy("s", "d", "key", "value").agg(F.count("*").alias("k")).join(size, ["s", "d"]).filter("k = n")
            out = out.with_(edge_attrs=own.select(F.col("s").alias("src"), F.col("d").alias("dst"), "key", "value"))
        return out

    def equal(self, other: Graph) -> DataFrame:
        """One row (equal): whether the graphs have the same rows."""
        diffs = None
        for a, b in zip((self.nodes, self.edges, self.node_attrs, self.edge_attrs), (other.nodes, other.edges, other.node_attrs, other.edge_attrs), strict=True):
            d = a.exceptAll(b).select(F.lit(1)).unionAll(b.exceptAll(a).select(F.lit(1)))
            diffs = d if diffs is None else diffs.unionAll(d)
        return diffs.agg((F.count("*") == 0).alias("equal"))

    def without_image(self, mapping: DataFrame) -> Graph:
        """The part of the graph on nodes that no node of another graph is mapped to by mapping (old, new)."""
        return self._on(self.nodes.join(mapping.select(F.col("new").alias("node_id")), "node_id", "left_anti"))

    def subtract(self, other: Graph) -> Graph:
        """Without the other's edges, and without its nodes that no edge needs any more."""
        edges = self.edges.join(other.edges, ["src", "dst"], "left_anti")
        needed = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id"))).distinct()
        nodes = self.nodes.join(other.nodes, "node_id", "left_anti").unionByName(needed).distinct()
        return Graph(nodes, edges, self.node_attrs.join(nodes, "node_id", "left_semi"), self.edge_attrs.join(edges, ["src", "dst"], "left_semi"))


def _sets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.sort_array(F.collect_set("value")).alias("values"))
