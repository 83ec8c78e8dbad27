"""Graphs over relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.graph import Graph


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def node(prefix: str, key: str):
    return F.concat(F.lit(prefix + ":"), F.col(key).cast("string"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# Table, prefix, key, the key and prefix it points to, and scalar columns that become attributes.
TABLES = {
    "region": ("r", "r_regionkey", None, {"name": "r_name"}),
    "nation": ("n", "n_nationkey", ("r", "n_regionkey"), {"name": "n_name"}),
    "customer": ("c", "c_custkey", ("n", "c_nationkey"), {"segment": "c_mktsegment"}),
    "supplier": ("s", "s_suppkey", ("n", "s_nationkey"), {"name": "s_name"}),
    "part": ("p", "p_partkey", None, {"brand": "p_brand", "type": "p_type"}),
    "orders": ("o", "o_orderkey", ("c", "o_custkey"), {"status": "o_orderstatus"}),
}


def tpch_graph(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = tuple(TABLES), supplies: bool = False) -> Graph:
    """Nodes `prefix:key` of the chosen tables, an edge for each foreign key between them, and with `supplies` an edge from supplier to
    part for each pair in lineitem with the set of its return flags. Nothing is read before it is asked for."""
    nodes, edges, attrs = [], [], []
    prefixes = {TABLES[t][0] for t in tables}
    for t in tables:
        prefix, key, to, columns = TABLES[t]
        df = read(spark, sf_dir, t)
        nodes.append(df.select(node(prefix, key).alias("node_id")))
        if to and to[0] in prefixes:
            edges.append(df.select(node(prefix, key).alias("src"), node(*to).alias("dst")))
        attrs += [df.select(node(prefix, key).alias("node_id"), F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in columns.items()]
    flags = spark.createDataFrame([], "src string, dst string, key string, value string")
    if supplies:
        # shuffled as integers; ids are made of what is left
        lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
        ends = [node("s", "l_suppkey").alias("src"), node("p", "l_partkey").alias("dst")]
        edges.append(lines.select("l_suppkey", "l_partkey").distinct().select(*ends))
        flags = lines.distinct().select(*ends, F.lit("returnflag").alias("key"), F.col("l_returnflag").alias("value"))
    none = spark.createDataFrame([], "src string, dst string")
    return Graph(union(nodes), union(edges) if edges else none, union(attrs), flags)


#: Attributes as JSON has them: a map of sets, each {"type", "data"}, or in the old form {"strSet" or "numSet": {"pos_list"}}.
ATTRS = "map<string, string>"


def _values(doc: Column) -> Column:
    """Values of one set: those of a finite one; a set of another kind is one value, its own JSON."""
    old = F.concat(*[F.coalesce(F.from_json(doc, f"{k} struct<pos_list: array<string>>")[k]["pos_list"], F.array().cast("array<string>")) for k in ("strSet", "numSet")])
    kind = F.get_json_object(doc, "$.type")
    return F.when(kind.isNull(), old).when(kind == "FiniteSet", F.from_json(doc, "data array<string>")["data"]).otherwise(F.array(doc))


def graph_of(nodes: DataFrame, edges: DataFrame) -> Graph:
    """nodes (id, attrs), edges (from, to, attrs) as read from JSON. An id or end that lacks is an error."""
    need = lambda c, what: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"{what} is not said")).cast("string"))
    n = nodes.select(need("id", "a node's id").alias("node_id"), "attrs")
    e = edges.select(need("from", "an edge's source").alias("src"), need("to", "an edge's target").alias("dst"), "attrs")

    def long(df: DataFrame, *keys: str) -> DataFrame:
        return df.select(*keys, F.explode("attrs").alias("key", "doc")).select(*keys, "key", F.explode(_values(F.col("doc"))).alias("value")).distinct()

    return Graph(n.select("node_id").distinct(), e.select("src", "dst").distinct(), long(n, "node_id"), long(e, "src", "dst"))


def from_json(spark: SparkSession, path: str) -> Graph:
    """One document {"nodes": [{"id", "attrs": {key: {"type", "data"}}}], "edges": [{"from", "to", "attrs"}]}; attrs may lack."""
    doc = spark.read.schema(f"nodes array<struct<id: string, attrs: {ATTRS}>>, edges array<struct<`from`: string, `to`: string, attrs: {ATTRS}>>").json(path, multiLine=True)
    return graph_of(doc.select(F.explode("nodes").alias("x")).select("x.*"), doc.select(F.explode("edges").alias("x")).select("x.*"))


def from_json_rows(rows: DataFrame) -> Graph:
    """What json_rows() gave: (kind, doc)."""
    read = lambda kind, schema: rows.filter(F.col("kind") == kind).select(F.from_json("doc", schema).alias("x")).select("x.*")
    return graph_of(read("node", f"id string, attrs {ATTRS}"), read("edge", f"`from` string, `to` string, attrs {ATTRS}"))


def json_rows(graph: Graph) -> DataFrame:
    """One JSON document a row (kind, doc): nodes and edges with their attributes, so that a large graph is written in parallel. A set whose one value is the JSON of a set of another kind is written as that."""
    values = F.sort_array(F.collect_set("value"))
    plain = F.to_json(F.struct(F.lit("FiniteSet").alias("type"), values.alias("data")))
    other = (F.size(values) == 1) & F.get(values, F.lit(0)).rlike(r'^\{"type":"(?:IntegerSet|RegexSet|EmptySet|UniversalSet)"')
    q = lambda c: F.substr(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)  # noqa: E731  a text is quoted as the one item of an array is
    entry = F.concat(q("key"), F.lit(":"), F.when(other, F.get(values, F.lit(0))).otherwise(plain))

    def with_attrs(df: DataFrame, attrs: DataFrame, keys: list[str]) -> DataFrame:
        sets = attrs.groupBy(*keys, "key").agg(entry.alias("entry")).groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("entry")), ",").alias("attrs"))
        return df.join(sets, keys, "left")

    doc = lambda *ends: F.concat(F.lit("{"), *[y for name, c in ends for y in (F.lit(f'"{name}":'), q(c), F.lit(","))], F.lit('"attrs":{'), F.coalesce("attrs", F.lit("")), F.lit("}}")).alias("doc")
    n = with_attrs(graph.nodes, graph.node_attrs, ["node_id"]).select(F.lit("node").alias("kind"), doc(("id", "node_id")))
    e = with_attrs(graph.edges, graph.edge_attrs, ["src", "dst"]).select(F.lit("edge").alias("kind"), doc(("from", "src"), ("to", "dst")))
    return n.unionByName(e)
