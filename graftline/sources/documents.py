"""Hierarchies, rules and graphs with symbolic sets as JSON, both ways."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.graph import Graph
from graftline.operators.hierarchies import Hierarchy, HierarchyError
from graftline.operators.rewrite import Rule
from graftline.operators.rule_algebra import Span
from graftline.sources.tables import ATTRS, graph_of, json_rows

GRAPH = f"struct<nodes: array<struct<id: string, attrs: {ATTRS}>>, edges: array<struct<`from`: string, `to`: string, attrs: {ATTRS}>>>"
HIERARCHY = (
    f"graphs array<struct<id: string, graph: {GRAPH}, attrs: string>>, "
    "typing array<struct<`from`: string, `to`: string, mapping: map<string, string>, attrs: string>>, "
    "relations array<struct<`from`: string, `to`: string, rel: map<string, array<string>>, attrs: string>>"
)


def load_hierarchy(spark: SparkSession, path: str, ignore: dict | None = None, check: bool = True) -> Hierarchy:
    """One document {graphs, typing, relations}. ignore: "graphs" -> names, "typing" and "relations" -> pairs of names that are left out; so is what needs a graph that is."""
    ignore = ignore or {}
    doc = spark.read.schema(HIERARCHY).json(path, multiLine=True)
    graphs = doc.select(F.explode("graphs").alias("x")).select("x.id", "x.graph", "x.attrs")
    typing = doc.select(F.explode("typing").alias("x")).select(F.col("x.from").alias("s"), F.col("x.to").alias("t"), "x.mapping", "x.attrs")
    relations = doc.select(F.explode("relations").alias("x")).select(F.col("x.from").alias("s"), F.col("x.to").alias("t"), "x.rel", "x.attrs")
    attrs = lambda x: json.loads(x) if x else {}
    out = Hierarchy()
    for r in graphs.select("id", "attrs").collect():
        if r.id is None:
            raise HierarchyError("a graph has no id")
        if r.id not in ignore.get("graphs", ()):
            own = graphs.filter(F.col("id") == r.id).select("graph.*")
            out.add_graph(r.id, graph_of(own.select(F.explode("nodes").alias("x")).select("x.*"), own.select(F.explode("edges").alias("x")).select("x.*")), attrs(r.attrs))
    pairs = lambda df, kind: [r for r in df.select("s", "t", "attrs").collect() if (r.s, r.t) not in ignore.get(kind, ()) and {r.s, r.t} <= out.graphs.keys()]
    for r in pairs(typing, "typing"):
        out.add_typing(r.s, r.t, typing.filter((F.col("s") == r.s) & (F.col("t") == r.t)).select(F.explode("mapping").alias("old", "new")), check)
        out.set_typing_attrs(r.s, r.t, attrs(r.attrs))
    for r in pairs(relations, "relations"):
        if (r.t, r.s) not in out.relations:
            own = relations.filter((F.col("s") == r.s) & (F.col("t") == r.t)).select(F.explode("rel").alias("left", "rights"))
            out.add_relation(r.s, r.t, own.select("left", F.explode("rights").alias("right")))
            out.set_relation_attrs(r.s, r.t, attrs(r.attrs))
    return out


def hierarchy_rows(h: Hierarchy, names: dict[str, str] | None = None) -> DataFrame:
    """(part, a, b, kind, doc), a JSON document a row, so that a large hierarchy is written in parallel: nodes and edges of graphs, pairs of typings and relations, and an `entry` with the attributes of each of them. names: graph -> name that it's written under."""
    to = lambda x: (names or {}).get(x, x)
    spark = SparkSession.getActiveSession()
    entries = [("graph", to(g), "", "entry", json.dumps(a or {})) for g, a in h.attrs.items()]
    entries += [("typing", to(s), to(t), "entry", json.dumps(h.get_typing_attrs(s, t))) for s, t in h.typings] + [("relation", to(a), to(b), "entry", json.dumps(h.get_relation_attrs(a, b))) for a, b in h.relations]
    out = spark.createDataFrame(entries, "part string, a string, b string, kind string, doc string")
    label = lambda df, part, a, b: df.select(F.lit(part).alias("part"), F.lit(to(a)).alias("a"), F.lit(to(b)).alias("b"), "kind", "doc")
    for g, graph in h.graphs.items():
        out = out.unionByName(label(json_rows(graph), "graph", g, ""))
    for part, maps in (("typing", h.typings), ("relation", h.relations)):
        for (a, b), m in maps.items():
            out = out.unionByName(label(m.select(F.lit("pair").alias("kind"), F.to_json(F.struct(*m.columns)).alias("doc")), part, a, b))
    return out


def hierarchy_from_rows(rows: DataFrame) -> Hierarchy:
    """What hierarchy_rows() gave; rows should be stored, as each part is read on its own."""
    out = Hierarchy()
    docs = lambda part, a, b, kind: rows.filter((F.col("part") == part) & (F.col("a") == a) & (F.col("b") == b) & (F.col("kind") == kind))
    read = lambda df, schema: df.select(F.from_json("doc", schema).alias("x")).select("x.*")
    entries = rows.filter("kind = 'entry'").orderBy("part", "a", "b").collect()  # one for each graph and map
    for r in entries:
        if r.part == "graph":
            nodes, edges = docs("graph", r.a, "", "node"), docs("graph", r.a, "", "edge")
            out.add_graph(r.a, graph_of(read(nodes, f"id string, attrs {ATTRS}"), read(edges, f"`from` string, `to` string, attrs {ATTRS}")), json.loads(r.doc))
    for r in entries:
        if r.part == "typing":
            out.typings[r.a, r.b] = read(docs("typing", r.a, r.b, "pair"), "old string, new string")
        elif r.part == "relation":
            out.relations[r.a, r.b] = read(docs("relation", r.a, r.b, "pair"), "left string, right string")
        if r.part != "graph" and json.loads(r.doc):
            (out.typing_attrs if r.part == "typing" else out.relation_attrs)[r.a, r.b] = json.loads(r.doc)
    return out


def hierarchy_document(h: Hierarchy, names: dict[str, str] | None = None) -> dict:
    """The whole hierarchy as one document on the driver: for small ones."""
    to = lambda x: (names or {}).get(x, x)

    def graph(g: Graph) -> dict:
        rows = json_rows(g).collect()
        return {"nodes": [json.loads(r.doc) for r in rows if r.kind == "node"], "edges": [json.loads(r.doc) for r in rows if r.kind == "edge"]}

    def lists(pairs: DataFrame) -> dict:
        return {r.left: r.rights for r in pairs.groupBy("left").agg(F.sort_array(F.collect_set("right")).alias("rights")).collect()}

    return {
        "graphs": [{"id": to(n), "graph": graph(g), "attrs": h.attrs.get(n) or {}} for n, g in h.graphs.items()],
        "typing": [{"from": to(s), "to": to(t), "mapping": {r.old: r.new for r in m.collect()}, "attrs": h.get_typing_attrs(s, t)} for (s, t), m in h.typings.items()],
        "relations": [{"from": to(a), "to": to(b), "rel": lists(m), "attrs": h.get_relation_attrs(a, b)} for (a, b), m in h.relations.items()],
    }


def rule_document(rule: Rule) -> dict:
    return Span.of(rule).to_json()


def rule_from_document(doc: dict, name: str = "") -> Rule:
    return Span.from_json(doc, name).rule()
