"""Maps between graphs, and what is built from them: pullback, pushout, pullback complement, image."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.graph import Graph
from graftline.operators.closure import classes


class MapError(ValueError):
    """A map that isn't there or isn't the only one."""


#: Parts into which pullback() deals each side's nodes.
GRID = 8


# A map is (old, new): each old node once, for a homomorphism defined on all nodes.


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.withColumnRenamed("new", "mid").join(second.withColumnRenamed("old", "mid"), "mid").select("old", "new")


def compose_chain(maps: list[DataFrame]) -> DataFrame:
    return reduce(compose, maps)


def identity(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("old"), F.col("node_id").alias("new"))


def is_monic(mapping: DataFrame) -> bool:
    """Whether no two nodes have one image."""
    return mapping.groupBy("new").agg(F.countDistinct("old").alias("n")).filter("n > 1").isEmpty()


def is_total(nodes: DataFrame, mapping: DataFrame) -> bool:
    """Whether the map is defined on the nodes, all of them and no others."""
    there = mapping.select(F.col("old").alias("node_id"))
    return nodes.join(there, "node_id", "left_anti").isEmpty() and there.join(nodes, "node_id", "left_anti").isEmpty()


def restrict(mapping: DataFrame, nodes: DataFrame) -> DataFrame:
    return mapping.join(nodes.select(F.col("node_id").alias("old")), "old", "left_semi").select("old", "new")


def union_maps(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both; an error if they differ on a node."""
    out = first.select("old", "new").unionByName(second.select("old", "new")).distinct()
    bad = out.groupBy("old").agg(F.count("*").alias("n")).filter("n > 1").first()
    if bad is not None:
        raise MapError(f"the maps differ at {bad.old}")
    return out


def replace_source(mapping: DataFrame, old: str, new: str) -> DataFrame:
    return mapping.withColumn("old", F.when(F.col("old") == old, new).otherwise(F.col("old")))


def replace_target(mapping: DataFrame, old: str, new: str) -> DataFrame:
    return mapping.withColumn("new", F.when(F.col("new") == old, new).otherwise(F.col("new")))


def inverse_image(mapping: DataFrame, targets: DataFrame) -> DataFrame:
    return mapping.join(targets.select(F.col("node_id").alias("new")), "new", "left_semi").select(F.col("old").alias("node_id"))


def relation_compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """(left, right) pairs that share a middle node."""
    return first.withColumnRenamed("right", "mid").join(second.withColumnRenamed("left", "mid"), "mid").select("left", "right").distinct()


def homomorphism_violations(g: Graph, to: Graph, mapping: DataFrame) -> DataFrame:
    """Edges of g whose image is no edge of `to`."""
    image = g.edges.join(mapping.select(F.col("old").alias("src"), F.col("new").alias("s")), "src").join(mapping.select(F.col("old").alias("dst"), F.col("new").alias("d")), "dst")
    return image.join(to.edges.select(F.col("src").alias("s"), F.col("dst").alias("d")), ["s", "d"], "left_anti").select("src", "dst")


def attribute_violations(g: Graph, to: Graph, mapping: DataFrame) -> DataFrame:
    """Attribute values of g's nodes that their images don't have."""
    image = g.node_attrs.join(mapping.withColumnsRenamed({"old": "node_id", "new": "image"}), "node_id")
    return image.join(to.node_attrs.withColumnRenamed("node_id", "image"), ["image", "key", "value"], "left_anti").select("node_id", "key", "value")


def pullback(b: Graph, c: Graph, b_d: DataFrame, c_d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (b, c) over a common node, and edges (src_b, src_c, dst_b, dst_c) between them that both graphs have.

    Few nodes may have many over them, and there are as many pairs as the product: each side is dealt into GRID parts by its own node and repeated for the other's
    parts, so that one node's pairs are made by many tasks. The tables are small beside the pairs, so their exchange is by number, which Spark doesn't coalesce."""
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(GRID)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)))
    left = b_d.select(F.col("old").alias("b"), "new", part("old").alias("i"), every.alias("j"))
    right = c_d.select(F.col("old").alias("c"), "new", every.alias("i"), part("old").alias("j"))
    keys, tasks = ["new", "i", "j"], max(int(b_d.sparkSession.conf.get("spark.sql.shuffle.partitions")), GRID * GRID)
    nodes = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys).hint("merge"), keys).select("b", "c")
    over = lambda g, m: g.edges.join(m.withColumnsRenamed({"old": "src", "new": "s"}), "src").join(m.withColumnsRenamed({"old": "dst", "new": "d"}), "dst")
    left, right = over(b, b_d).select("s", "d", F.col("src").alias("src_b"), F.col("dst").alias("dst_b")), over(c, c_d).select("s", "d", F.col("src").alias("src_c"), F.col("dst").alias("dst_c"))
    return nodes, left.join(right, ["s", "d"]).select("src_b", "src_c", "dst_b", "dst_c")


def pullback_graph(b: Graph, c: Graph, b_d: DataFrame, c_d: DataFrame) -> tuple[Graph, DataFrame, DataFrame]:
    """The pullback as a graph with ids `b|c`, and its maps (old, new) to b and c. Attributes are values that both sides have."""
    nodes, edges = pullback(b, c, b_d, c_d)
    pair = lambda x, y: F.concat_ws("|", x, y)
    named = nodes.withColumn("node_id", pair("b", "c"))
    attrs = named.join(b.node_attrs.withColumnRenamed("node_id", "b"), "b").join(c.node_attrs.withColumnRenamed("node_id", "c"), ["c", "key", "value"]).select("node_id", "key", "value")
    left, right = b.edge_attrs.withColumnsRenamed({"src": "src_b", "dst": "dst_b"}), c.edge_attrs.withColumnsRenamed({"src": "src_c", "dst": "dst_c"})
    ends = [pair("src_b", "src_c").alias("src"), pair("dst_b", "dst_c").alias("dst")]
    values = edges.join(left, ["src_b", "dst_b"]).join(right, ["src_c", "dst_c", "key", "value"]).select(*ends, "key", "value")
    to = lambda side: named.select(F.col("node_id").alias("old"), F.col(side).alias("new"))
    return Graph(named.select("node_id"), edges.select(*ends), attrs, values), to("b"), to("c")


def pushout_maps(b: Graph, c: Graph, a_b: DataFrame, a_c: DataFrame) -> tuple[Graph, DataFrame, DataFrame]:
    """b and c glued along a, and the maps (old, new) of b and c into it. Nodes that a's maps link, through any number of steps, become one, named by the least of c's ids among
    them; ids of b's other nodes are prefixed where they clash."""
    side = lambda x, c: F.concat(F.lit(x), F.col(c))
    glue = a_b.select("old", side("1", "new").alias("v")).join(a_c.select("old", side("0", "new").alias("u")), "old").select("u", "v")
    of = classes(glue)
    b_own = b.nodes.select("node_id", side("1", "node_id").alias("old")).join(of, "old", "left")
    taken = c.nodes.select("node_id", F.lit(True).alias("taken"))
    fresh = F.when(F.col("taken"), F.concat(F.lit("b:"), F.col("node_id"))).otherwise(F.col("node_id"))
    b_p = b_own.join(taken, "node_id", "left").select(F.col("node_id").alias("old"), F.coalesce(F.expr("substr(new, 2)"), fresh).alias("new"))
    c_p = c.nodes.select("node_id", side("0", "node_id").alias("old")).join(of, "old", "left").select(F.col("node_id").alias("old"), F.coalesce(F.expr("substr(new, 2)"), "node_id").alias("new"))
    moved_b, moved_c = b.rename(b_p), c.rename(c_p)
    both = lambda x, y: x.unionByName(y).distinct()
    return Graph(*[both(getattr(moved_b, t), getattr(moved_c, t)) for t in ("nodes", "edges", "node_attrs", "edge_attrs")]), b_p, c_p


def pushout(b: Graph, c: Graph, a_b: DataFrame, a_c: DataFrame) -> Graph:
    return pushout_maps(b, c, a_b, a_c)[0]


def pushout_from_relation(left: Graph, right: Graph, relation: DataFrame) -> tuple[Graph, DataFrame, DataFrame]:
    """left and right glued along related pairs (left, right), and their maps into it."""
    pairs = relation.select("left", "right").distinct().withColumn("old", F.concat_ws("|", "left", "right"))
    return pushout_maps(left, right, pairs.select("old", F.col("left").alias("new")), pairs.select("old", F.col("right").alias("new")))


def image(g: Graph, mapping: DataFrame) -> Graph:
    """The image of g under a map."""
    return g.rename(mapping, closed=True)


def image_maps(g: Graph, mapping: DataFrame) -> tuple[Graph, DataFrame, DataFrame]:
    """The image, the map of g onto it and the image's inclusion."""
    own = image(g, mapping)
    return own, mapping.select("old", "new"), identity(own.nodes)


def map_violations(g: Graph, to: Graph, mapping: DataFrame) -> DataFrame:
    """(problem, at): nodes without one image, images that aren't there, edges and attribute values that images lack. No rows: a homomorphism."""
    m = mapping.select("old", "new").distinct()
    per = g.nodes.join(m, F.col("node_id") == F.col("old"), "left").groupBy("node_id").agg(F.count("new").alias("n")).filter("n != 1").select(F.lit("image").alias("problem"), F.col("node_id").alias("at"))
    lost = m.join(to.nodes, F.col("new") == F.col("node_id"), "left_anti").select(F.lit("target").alias("problem"), F.col("old").alias("at"))
    arrow = F.concat_ws("->", "src", "dst").alias("at")
    edges = homomorphism_violations(g, to, m).select(F.lit("edge").alias("problem"), arrow)
    attrs = attribute_violations(g, to, m).select(F.lit("attribute").alias("problem"), F.col("node_id").alias("at"))
    values = g.edge_attrs.join(m.select(F.col("old").alias("src"), F.col("new").alias("s")), "src").join(m.select(F.col("old").alias("dst"), F.col("new").alias("d")), "dst")
    more = values.join(to.edge_attrs.withColumnsRenamed({"src": "s", "dst": "d"}), ["s", "d", "key", "value"], "left_anti").select(F.lit("edge attribute").alias("problem"), arrow)
    return per.unionByName(lost).unionByName(edges).unionByName(attrs).unionByName(more)


def pullback_complement(a: Graph, b: Graph, d: Graph, a_b: DataFrame, b_d: DataFrame) -> tuple[Graph, DataFrame]:
    """The final pullback complement of a -> b -> d, b -> d injective: d with nodes of b that a doesn't reach removed, those it reaches more than once
    cloned, and b's edges and attributes that a lacks dropped. -> the graph, and (old, new) from it to d. The first of copies, by name, keeps d's id."""
    over = a_b.withColumnsRenamed({"old": "a", "new": "b"}).join(b_d.withColumnsRenamed({"old": "b", "new": "d"}), "b").select("a", "d")
    first = over.groupBy("d").agg(F.min("a").alias("first"))
    fan = over.join(first, "d").select("a", F.col("d").alias("old"), F.when(F.col("a") == F.col("first"), F.col("d")).otherwise(F.concat("d", F.lit("#"), "a")).alias("new"))
    gone = b_d.join(over, F.col("new") == F.col("d"), "left_anti").select(F.col("new").alias("node_id"))
    c = d.remove_nodes(gone).rename(fan.select("old", "new"))
    back = fan.select("new", "old", "a")
    touched = b.edges.join(b_d.withColumnsRenamed({"old": "src", "new": "s"}), "src").join(b_d.withColumnsRenamed({"old": "dst", "new": "t"}), "dst").select("s", "t")
    ends = lambda df, cols: df.join(back.withColumnsRenamed({"new": "src", "old": "s", "a": "sa"}), "src").join(back.withColumnsRenamed({"new": "dst", "old": "t", "a": "ta"}), "dst").select(*cols)
    own = ends(c.edges, ["src", "dst", "s", "t", "sa", "ta"]).join(touched, ["s", "t"], "left_semi")
    c = c.remove_edges(own.join(a.edges.select(F.col("src").alias("sa"), F.col("dst").alias("ta")), ["sa", "ta"], "left_anti").select("src", "dst"))
    held = b.node_attrs.join(b_d.withColumnRenamed("old", "node_id"), "node_id").select(F.col("new").alias("old"), "key", "value")
    lost = back.join(held, "old").join(a.node_attrs.withColumnRenamed("node_id", "a"), ["a", "key", "value"], "left_anti").select(F.col("new").alias("node_id"), "key", "value")
    c = c.remove_node_attrs(lost)
    all_of = c.nodes.join(back, F.col("node_id") == F.col("new"), "left").select(F.col("node_id").alias("old"), F.coalesce("old", "node_id").alias("new"))
    return c, all_of


def relation_to_span(left: Graph, right: Graph, relation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(left, right) nodes, one for each related pair, and edges (src_left, src_right, dst_left, dst_right) that both graphs have."""
    nodes = relation.select("left", "right").distinct()
    at = lambda x: nodes.select(F.col("left").alias(f"{x}_left"), F.col("right").alias(f"{x}_right"))
    one = left.edges.select(F.col("src").alias("src_left"), F.col("dst").alias("dst_left"))
    two = right.edges.select(F.col("src").alias("src_right"), F.col("dst").alias("dst_right"))
    return nodes, one.join(at("src"), "src_left").join(at("dst"), "dst_left").join(two, ["src_right", "dst_right"]).select("src_left", "src_right", "dst_left", "dst_right")


def map_to_pullback(p_b: DataFrame, p_c: DataFrame, z_b: DataFrame, z_c: DataFrame) -> DataFrame:
    """(old, new) from z to the pullback p: the node whose images in b and c are those of z's."""
    legs = lambda x, y: x.withColumnRenamed("new", "b").join(y.withColumnRenamed("new", "c"), "old")
    return legs(z_b, z_c).join(legs(p_b, p_c).withColumnRenamed("old", "new"), ["b", "c"]).select("old", "new")


def map_from_pushout(b_p: DataFrame, c_p: DataFrame, b_z: DataFrame, c_z: DataFrame) -> DataFrame:
    """(old, new) from the pushout p to z; an error where b and c disagree."""
    via = lambda x, y: x.withColumnRenamed("new", "p").join(y, "old").select(F.col("p").alias("old"), "new")
    return union_maps(via(b_p, b_z), via(c_p, c_z))


def map_to_pullback_complement(p_c: DataFrame, a_p: DataFrame, a_prime_a: DataFrame, a_prime_z: DataFrame, z_c: DataFrame) -> DataFrame:
    """(old, new) from z to the pullback complement p: over z's image in c, and where that has several nodes of p, the one that a' -> a -> p names; an error if none or several are left."""
    over = z_c.withColumnsRenamed({"old": "z", "new": "c"}).join(p_c.withColumnsRenamed({"old": "p", "new": "c"}), "c").select("z", "p")
    told = a_prime_z.withColumnRenamed("new", "z").join(compose(a_prime_a, a_p).withColumnRenamed("new", "p"), "old").select("z", "p").distinct()
    ruled = over.join(told, ["z", "p"], "left_semi").unionByName(over.join(told, "z", "left_anti"))
    bad = z_c.join(ruled, F.col("old") == F.col("z"), "left").groupBy("old").agg(F.count("p").alias("n")).filter("n != 1").first()
    if bad is not None:
        raise MapError(f"{bad.old} has {bad.n} images")
    return ruled.select(F.col("z").alias("old"), F.col("p").alias("new"))


def left_relation(relation: DataFrame) -> DataFrame:
    """(left, rights): related nodes of each left node, sorted."""
    return relation.groupBy("left").agg(F.sort_array(F.collect_set("right")).alias("rights"))


def right_relation(relation: DataFrame) -> DataFrame:
    """(right, lefts)."""
    return relation.groupBy("right").agg(F.sort_array(F.collect_set("left")).alias("lefts"))


def relation_rows(lefts: DataFrame) -> DataFrame:
    """(left, rights) -> (left, right), one row for each pair."""
    return lefts.select("left", F.explode("rights").alias("right")).distinct()
