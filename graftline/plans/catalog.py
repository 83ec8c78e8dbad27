"""The queries over the driver's tables as a graph, each with the SQL of what it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.functions import attribute_sets as A
from graftline.functions import regular
from graftline.functions import typed_sets as T
from graftline.graph import Graph
from graftline.operators import category, rule_building
from graftline.operators.hierarchies import Hierarchy
from graftline.operators.hierarchy import Typed
from graftline.operators.pattern import Pattern, match
from graftline.operators.rewrite import Rule, rewrite
from graftline.operators.rule_algebra import Span, compose
from graftline.operators.versioning import VersionedGraph
from graftline.sources.documents import hierarchy_from_rows, hierarchy_rows
from graftline.sources.exports import d3_rows, shared_dir, written
from graftline.sources.tables import from_json_rows, json_rows, node, read, tpch_graph

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


GEO = ("region", "nation", "customer", "supplier")

# SQL of the parts of the graph
N = {"r": "select 'r:'||r_regionkey id from region", "n": "select 'n:'||n_nationkey id from nation", "c": "select 'c:'||c_custkey id from customer", "s": "select 's:'||s_suppkey id from supplier", "p": "select 'p:'||p_partkey id from part", "o": "select 'o:'||o_orderkey id from orders"}
E = {"nr": "select 'n:'||n_nationkey src, 'r:'||n_regionkey dst from nation", "cn": "select 'c:'||c_custkey src, 'n:'||c_nationkey dst from customer", "sn": "select 's:'||s_suppkey src, 'n:'||s_nationkey dst from supplier", "oc": "select 'o:'||o_orderkey src, 'c:'||o_custkey dst from orders", "sp": "select distinct 's:'||l_suppkey src, 'p:'||l_partkey dst from lineitem"}
GEO_N = " union all ".join(N[x] for x in "rncs")
GEO_E = " union all ".join(E[x] for x in ("nr", "cn", "sn"))


@query(" union all ".join(f"select id node_id from ({x})" for x in N.values()))
def node_scan(spark, sf):
    return tpch_graph(spark, sf).nodes


@query(" union all ".join(f"select src, dst from ({x})" for x in E.values()))
def edge_scan(spark, sf):
    return tpch_graph(spark, sf, supplies=True).edges


@query("select 'r:'||r_regionkey node_id, 'name' key, r_name value from region union all select 'n:'||n_nationkey, 'name', n_name from nation union all select 'c:'||c_custkey, 'segment', c_mktsegment from customer union all select 's:'||s_suppkey, 'name', s_name from supplier")
def node_attr_rows(spark, sf):
    return tpch_graph(spark, sf, GEO).node_attrs


@query(f"select src, dst from ({GEO_E})")
def json_roundtrip(spark, sf):
    return from_json_rows(json_rows(tpch_graph(spark, sf, GEO))).edges


@query("select 'n:'||n_nationkey node_id, 'name' key, n_name value from nation union all select 'r:'||r_regionkey, 'name', r_name from region")
def json_roundtrip_attrs(spark, sf):
    return from_json_rows(json_rows(tpch_graph(spark, sf, ("region", "nation")))).node_attrs


@query("select 's:'||l_suppkey src, 'p:'||l_partkey dst from lineitem group by all having bool_or(l_returnflag = 'R')")
def filter_edges_by_attr(spark, sf):
    return tpch_graph(spark, sf, ("supplier", "part"), supplies=True).filter_edges_holding("returnflag", "R").edges


@query("select 's:'||l_suppkey src, 'p:'||l_partkey dst from lineitem group by all having count(distinct l_returnflag) = 2")
def filter_edges_by_set(spark, sf):
    return tpch_graph(spark, sf, ("supplier", "part"), supplies=True).filter_edges("returnflag", lambda v: F.size(v) == 2).edges


@query("select 's:'||l_suppkey src, 'p:'||l_partkey dst from lineitem where l_returnflag in ('R', 'N') group by all having count(distinct l_returnflag) = 2")
def attr_inclusion(spark, sf):
    return tpch_graph(spark, sf, ("supplier", "part"), supplies=True).edges_with({"returnflag": ["R", "N"]})


@query("select 'c:'||c_custkey src, 'n:'||c_nationkey dst from customer where c_mktsegment = 'BUILDING'")
def induced_subgraph(spark, sf):
    g = tpch_graph(spark, sf, ("nation", "customer"))
    chosen = g.nodes_with({"segment": ["BUILDING"]}).unionByName(g.nodes.filter("node_id like 'n:%'"))
    return g.subgraph(chosen).edges


@query("select 'shuffled' what, true as equal union all select 'without nation 3', (select count(*) from nation where n_nationkey = 3) = 0")
def graph_equal(spark, sf):
    g = tpch_graph(spark, sf, GEO)
    same = g.equal(Graph(g.nodes.orderBy(F.desc("node_id")), g.edges.repartition(5), g.node_attrs, g.edge_attrs))
    other = g.equal(g.remove_nodes(frame(spark, [("n:3",)], "node_id string")))
    return same.select(F.lit("shuffled").alias("what"), "equal").unionByName(other.select(F.lit("without nation 3").alias("what"), "equal"))


@query("select 'c:'||c_custkey c, 'n:'||c_nationkey n from customer where c_mktsegment = 'BUILDING'")
def match_edge(spark, sf):
    return match(tpch_graph(spark, sf, ("nation", "customer")), Pattern({"c": {"segment": ["BUILDING"]}, "n": {}}, {("c", "n"): {}}))


def _typing(g: Graph) -> DataFrame:
    return g.nodes.select("node_id", F.substring_index("node_id", ":", 1).alias("type"))


@query("with sp as (select distinct l_suppkey s, l_partkey p from lineitem) select 's:'||a.s s1, 's:'||b.s s2, 'p:'||a.p p, 'n:'||x.s_nationkey n from sp a join sp b on a.p = b.p and a.s <> b.s join supplier x on x.s_suppkey = a.s join supplier y on y.s_suppkey = b.s and x.s_nationkey = y.s_nationkey")
def match_coshipment(spark, sf):
    g = tpch_graph(spark, sf, ("nation", "supplier", "part"), supplies=True)
    p = Pattern({"s1": {}, "s2": {}, "p": {}, "n": {}}, {("s1", "p"): {}, ("s2", "p"): {}, ("s1", "n"): {}, ("s2", "n"): {}}, {"p": "p", "n": "n"})
    return match(g, p, _typing(g))


@query("select 'c:'||o_custkey c, 'o:'||o_orderkey o, 'n:'||c_nationkey n, 'r:'||n_regionkey r from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def match_path_typed(spark, sf):
    g = tpch_graph(spark, sf, ("region", "nation", "customer", "orders"))
    p = Pattern({"o": {}, "c": {}, "n": {}, "r": {}}, {("o", "c"): {}, ("c", "n"): {}, ("n", "r"): {}}, {"o": "o", "c": "c", "n": "n", "r": "r"})
    return match(g, p, _typing(g))


@query("select 'c:'||c_custkey c, 'o:'||o_orderkey o, 'n:'||c_nationkey n from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING' and o_orderstatus = 'F'")
def match_customer_order_part(spark, sf):
    """The flagship: orders of one status by customers of one segment, and their nations."""
    g = tpch_graph(spark, sf, ("nation", "customer", "orders"))
    p = Pattern({"o": {"status": ["F"]}, "c": {"segment": ["BUILDING"]}, "n": {}}, {("o", "c"): {}, ("c", "n"): {}})
    return match(g, p)


@query("select 'n:'||n_nationkey a, 'r:'||n_regionkey b from nation union all select 'r:'||n_regionkey, 'n:'||n_nationkey from nation")
def match_undirected(spark, sf):
    return match(tpch_graph(spark, sf, ("region", "nation")), Pattern({"a": {}, "b": {}}, {("a", "b"): {}}, directed=False))


@query("select 'n:'||n_nationkey n, 'r:'||n_regionkey r, 'r:'||r_regionkey x from nation, region where n_regionkey <> r_regionkey")
def match_isolated(spark, sf):
    g = tpch_graph(spark, sf, ("region", "nation"))
    return match(g, Pattern({"n": {}, "r": {}, "x": {}}, {("n", "r"): {}}, {"x": "r"}), _typing(g), product=True)


@query("select 's:'||l_suppkey s, 'p:'||l_partkey p from lineitem where l_returnflag in ('A', 'N') group by all having count(distinct l_returnflag) = 2")
def match_set_attr(spark, sf):
    g = tpch_graph(spark, sf, ("supplier", "part"), supplies=True)
    return match(g, Pattern({"s": {}, "p": {}}, {("s", "p"): {"returnflag": ["A", "N"]}}))


@query("select 'c:'||c_custkey c, 'n:'||c_nationkey n from customer where c_nationkey < 5")
def match_restricted_nodes(spark, sf):
    g = tpch_graph(spark, sf, ("nation", "customer"))
    within = g.nodes.filter("node_id like 'c:%'").unionByName(spark.range(5).select(node("n", "id").alias("node_id")))
    return match(g, Pattern({"c": {}, "n": {}}, {("c", "n"): {}}), within=within)


def _over(spark, sf, table: str, key: str, prefix: str) -> DataFrame:
    return read(spark, sf, table).select(node(prefix, key).alias("old"), node("n", f"{prefix}_nationkey").alias("new"))


@query("select 'c:'||c_custkey b, 's:'||s_suppkey c from customer join supplier on c_nationkey = s_nationkey")
def pullback_nodes(spark, sf):
    b, c = tpch_graph(spark, sf, ("customer",)), tpch_graph(spark, sf, ("supplier",))
    return category.pullback(b, c, _over(spark, sf, "customer", "c_custkey", "c"), _over(spark, sf, "supplier", "s_suppkey", "s"))[0]


@query(f"select distinct id node_id from ({N['n']} union all {N['c']} union all {N['s']})")
def pushout_glue(spark, sf):
    b, c = tpch_graph(spark, sf, ("nation", "customer")), tpch_graph(spark, sf, ("nation", "supplier"))
    same = read(spark, sf, "nation").select(node("n", "n_nationkey").alias("old"), node("n", "n_nationkey").alias("new"))
    return category.pushout(b, c, same, same).nodes


@query("select distinct 'n:'||c_nationkey node_id from customer")
def image_factorization(spark, sf):
    return category.image(tpch_graph(spark, sf, ("customer",)), _over(spark, sf, "customer", "c_custkey", "c")).nodes


@query("select 'c:'||c_custkey old, 'r:'||n_regionkey as new from customer join nation on c_nationkey = n_nationkey")
def map_compose(spark, sf):
    up = read(spark, sf, "nation").select(node("n", "n_nationkey").alias("old"), node("r", "n_regionkey").alias("new"))
    return category.compose(_over(spark, sf, "customer", "c_custkey", "c"), up)


@query("select 'c:'||c_custkey node_id from customer where c_nationkey = 7")
def inverse_image(spark, sf):
    return category.inverse_image(_over(spark, sf, "customer", "c_custkey", "c"), frame(spark, [("n:7",)], "node_id string"))


@query("select distinct 's:'||l_suppkey \"left\", 'o:'||o_orderkey \"right\" from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'P'")
def relation_compose(spark, sf):
    lines = read(spark, sf, "lineitem").select(node("s", "l_suppkey").alias("left"), F.col("l_orderkey").alias("right"))
    orders = read(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("left"), node("o", "o_orderkey").alias("right"))
    return category.relation_compose(lines, orders)


@query(f"select src, dst from ({E['sn']})")
def homomorphism_violations(spark, sf):
    g = tpch_graph(spark, sf, GEO)
    schema = g.with_(nodes=frame(spark, [(x,) for x in "rncs"], "node_id string"), edges=frame(spark, [("n", "r"), ("c", "n")], "src string, dst string"))
    return category.homomorphism_violations(g, schema, _typing(g).withColumnsRenamed({"node_id": "old", "type": "new"}))


@query(f"select src, dst from ({GEO_E}) where src not like 's:%'")
def subtract_graph(spark, sf):
    return tpch_graph(spark, sf, GEO).subtract(tpch_graph(spark, sf, ("nation", "supplier"))).edges


@query(f"select src, dst from ({GEO_E}) where src like 'c:%'")
def subtract_image(spark, sf):
    """Without what suppliers and regions are mapped to."""
    g = tpch_graph(spark, sf, GEO)
    return g.without_image(g.nodes.filter("node_id like 's:%' or node_id like 'r:%'").select(F.col("node_id").alias("old"), F.col("node_id").alias("new"))).edges


def _by_region(spark, sf) -> DataFrame:
    return read(spark, sf, "nation").select(node("n", "n_nationkey").alias("old"), F.concat(F.lit("m:"), F.col("n_regionkey").cast("string")).alias("new"))


@query("select distinct 'c:'||c_custkey src, 'm:'||n_regionkey dst from customer join nation on c_nationkey = n_nationkey union all select distinct 'm:'||n_regionkey, 'r:'||n_regionkey from nation")
def merge_nodes_union(spark, sf):
    return tpch_graph(spark, sf, ("region", "nation", "customer")).rename(_by_region(spark, sf)).edges


@query("select 'm:'||n_regionkey node_id, 'name' key, n_name value from nation union all select 'r:'||r_regionkey, 'name', r_name from region")
def merge_attrs_union(spark, sf):
    return tpch_graph(spark, sf, ("region", "nation")).rename(_by_region(spark, sf)).node_attrs


@query("select 'm:'||n_regionkey node_id, count(*) degree from customer join nation on c_nationkey = n_nationkey group by 1")
def degree_after_merge(spark, sf):
    g = tpch_graph(spark, sf, ("nation", "customer")).rename(_by_region(spark, sf))
    return g.edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("degree"))


SETS = "with b as (select p_brand, coalesce(list(distinct p_size) filter (p_size % 2 = 0), []) x, coalesce(list(distinct p_size) filter (p_size % 3 = 0), []) y from part group by 1) select p_brand, array_to_string(list_sort({}), ',') elems from b"


def _sizes(spark, sf) -> DataFrame:
    return read(spark, sf, "part").groupBy("p_brand").agg(F.expr("collect_set(p_size) filter (where p_size % 2 = 0)").alias("x"), F.expr("collect_set(p_size) filter (where p_size % 3 = 0)").alias("y"))


def _elems(spark, sf, f) -> DataFrame:
    return _sizes(spark, sf).select("p_brand", F.array_join(f(F.col("x"), F.col("y")), ",").alias("elems"))


@query(SETS.format("list_distinct(list_concat(x, y))"))
def finite_union(spark, sf):
    return _elems(spark, sf, A.finite_union)


@query(SETS.format("list_intersect(x, y)"))
def finite_intersection(spark, sf):
    return _elems(spark, sf, A.finite_intersection)


@query(SETS.format("list_filter(x, lambda e: not list_contains(y, e))"))
def finite_difference(spark, sf):
    return _elems(spark, sf, A.finite_difference)


@query("with b as (select p_brand, coalesce(list(distinct p_size) filter (p_size % 6 = 0), []) x, coalesce(list(distinct p_size) filter (p_size % 3 = 0), []) y from part group by 1) select p_brand, len(list_filter(x, lambda e: not list_contains(y, e))) = 0 inside from b")
def finite_subset(spark, sf):
    s = read(spark, sf, "part").groupBy("p_brand").agg(F.expr("collect_set(p_size) filter (where p_size % 6 = 0)").alias("x"), F.expr("collect_set(p_size) filter (where p_size % 3 = 0)").alias("y"))
    return s.select("p_brand", A.finite_subset(F.col("x"), F.col("y")).alias("inside"))


def _ivals(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders").select("o_custkey", F.struct((F.col("o_orderkey") - 100).alias("lo"), (F.col("o_orderkey") + 100).alias("hi")).alias("i"))
    return o.groupBy("o_custkey").agg(F.collect_list("i").alias("ivals"))


IVALS = "with i as (select o_custkey, o_orderkey - 100 lo, o_orderkey + 100 hi from orders), m as (select *, max(hi) over (partition by o_custkey order by lo, hi rows between unbounded preceding and 1 preceding) before from i), g as (select *, sum(case when before is null or lo > before + 1 then 1 else 0 end) over (partition by o_custkey order by lo, hi rows unbounded preceding) part from m), s as (select o_custkey, part, min(lo) lo, max(hi) hi from g group by all) "


@query(IVALS + "select o_custkey, string_agg(lo||'..'||hi, ',' order by lo) ivals from s group by 1")
def int_normalise(spark, sf):
    """Large groups are normalised as rows before they are gathered."""
    rows = read(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") - 100).alias("lo"), (F.col("o_orderkey") + 100).alias("hi"))
    own = A.normalised_rows(rows, "o_custkey").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ivals"))
    return own.select("o_custkey", A.text(F.col("ivals")).alias("ivals"))


@query(IVALS.replace("from orders)", "from orders union all select distinct o_custkey, 1000, 20000 from orders)", 1) + "select o_custkey, string_agg(lo||'..'||hi, ',' order by lo) ivals from s group by 1")
def int_union(spark, sf):
    more = F.array(F.struct(F.lit(1000).cast("long").alias("lo"), F.lit(20000).cast("long").alias("hi")))
    return _ivals(spark, sf).select("o_custkey", A.text(A.int_union(F.col("ivals"), more)).alias("ivals"))


@query(IVALS + "select o_custkey, bool_and(hi <= 40000) inside from s group by 1")
def int_subset(spark, sf):
    below = F.array(F.struct(F.lit(None).cast("long").alias("lo"), F.lit(40000).cast("long").alias("hi")))
    return _ivals(spark, sf).select("o_custkey", A.int_subset(A.int_normalise(F.col("ivals")), below).alias("inside"))


@query(IVALS + "select o_custkey, coalesce(string_agg(greatest(lo, 1000)||'..'||least(hi, 20000), ',' order by lo) filter (hi >= 1000 and lo <= 20000), '') ivals from s group by 1")
def int_intersection(spark, sf):
    cut = F.array(F.struct(F.lit(1000).cast("long").alias("lo"), F.lit(20000).cast("long").alias("hi")))
    return _ivals(spark, sf).select("o_custkey", A.text(A.int_intersection(F.col("ivals"), cut)).alias("ivals"))


@query(IVALS + ", d as (select o_custkey, lo, least(hi, 999) hi from s where lo <= 999 union all select o_custkey, greatest(lo, 20001), hi from s where hi >= 20001) select c.o_custkey, coalesce(string_agg(lo||'..'||hi, ',' order by lo) filter (lo is not null), '') ivals from (select distinct o_custkey from orders) c left join d on c.o_custkey = d.o_custkey group by 1")
def int_difference(spark, sf):
    cut = F.array(F.struct(F.lit(1000).cast("long").alias("lo"), F.lit(20000).cast("long").alias("hi")))
    return _ivals(spark, sf).select("o_custkey", A.text(A.int_difference(F.col("ivals"), cut)).alias("ivals"))


@query("select o_custkey, bool_or(5000 between o_orderkey - 100 and o_orderkey + 100) inside from orders group by 1")
def int_contains(spark, sf):
    return _ivals(spark, sf).select("o_custkey", A.int_contains(F.col("ivals"), F.lit(5000).cast("long")).alias("inside"))


@query("select p_partkey from part where regexp_full_match(p_type, '(STANDARD|SMALL) .*')")
def regex_member(spark, sf):
    return read(spark, sf, "part").filter(F.col("p_type").rlike(r"^(?:(STANDARD|SMALL) .*)$")).select("p_partkey")


@query("select 'n:'||n_nationkey node_id, 'name' key, n_name value from nation union all select 'n:'||n_nationkey, 'area', case when n_regionkey = 1 then 'west' else 'east' end from nation")
def add_attrs(spark, sf):
    rows = read(spark, sf, "nation").select(node("n", "n_nationkey").alias("node_id"), F.lit("area").alias("key"), F.when(F.col("n_regionkey") == 1, "west").otherwise("east").alias("value"))
    return tpch_graph(spark, sf, ("nation",)).add_node_attrs(rows).node_attrs


@query("select 'n:'||n_nationkey node_id, 'name' key, n_name value from nation where n_nationkey % 2 = 1")
def remove_attrs(spark, sf):
    rows = read(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(node("n", "n_nationkey").alias("node_id"), F.lit("name").alias("key"), F.col("n_name").alias("value"))
    return tpch_graph(spark, sf, ("nation",)).remove_node_attrs(rows).node_attrs


@query("select 'n:'||n_nationkey node_id, 'name' key, case when n_nationkey < 3 then 'x' else n_name end value from nation")
def set_attrs(spark, sf):
    rows = spark.range(3).select(node("n", "id").alias("node_id"), F.lit("name").alias("key"), F.lit("x").alias("value"))
    return tpch_graph(spark, sf, ("nation",)).set_node_attrs(rows).node_attrs


@query(f"select src, dst from ({E['nr']}) union all select 'x:1', 'r:0' union all select 'x:1', 'r:1'")
def add_nodes_edges(spark, sf):
    g = tpch_graph(spark, sf, ("region", "nation")).add_nodes(frame(spark, [("x:1",)], "node_id string"))
    return g.add_edges(frame(spark, [("x:1", "r:0"), ("x:1", "r:1"), ("x:1", "no:1")], "src string, dst string")).edges


@query(f"select src, dst from ({GEO_E}) where 'n:3' not in (src, dst)")
def remove_node_cascade(spark, sf):
    return tpch_graph(spark, sf, GEO).remove_nodes(frame(spark, [("n:3",)], "node_id string")).edges


@query(f"with e as ({GEO_E}) select src, dst from e union all select 'n:3#2', dst from e where src = 'n:3' union all select src, 'n:3#2' from e where dst = 'n:3'")
def clone_node(spark, sf):
    return tpch_graph(spark, sf, GEO).rename(frame(spark, [("n:3", "n:3"), ("n:3", "n:3#2")], "old string, new string")).edges


@query(f"select case src when 'n:3' then 'n:x' else src end src, case dst when 'n:3' then 'n:x' else dst end dst from ({GEO_E})")
def relabel_nodes(spark, sf):
    return tpch_graph(spark, sf, GEO).rename(frame(spark, [("n:3", "n:x")], "old string, new string")).edges


@query("select 'n:'||n_nationkey node_id from nation where n_regionkey = 1")
def predecessors(spark, sf):
    return tpch_graph(spark, sf, ("region", "nation")).predecessors("r:1")


@query("select 'n:'||c_nationkey node_id from customer where c_custkey = 1")
def successors(spark, sf):
    return tpch_graph(spark, sf, ("nation", "customer")).successors("c:1")


@query("select 'n:'||n_nationkey node_id from nation where n_regionkey = 2 union all select 'c:'||c_custkey from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2 union all select 's:'||s_suppkey from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 2")
def ancestors(spark, sf):
    return _checkpointed(spark, tpch_graph(spark, sf, GEO)).ancestors(frame(spark, [("r:2",)], "node_id string"))


@query("select 'n:'||c_nationkey node_id from customer where c_custkey in (1, 2) union select 'r:'||n_regionkey from customer join nation on c_nationkey = n_nationkey where c_custkey in (1, 2)")
def descendants(spark, sf):
    return _checkpointed(spark, tpch_graph(spark, sf, GEO)).descendants(frame(spark, [("c:1",), ("c:2",)], "node_id string"))


def _checkpointed(spark, g: Graph) -> Graph:
    """Rounds cut lineage in the shared folder; one is set only where none is."""
    shared_dir(spark)
    return g


RULE = Rule(l_nodes=("n", "m"), p_l={"n1": "n", "n2": "n"}, p_r={"n1": "a", "n2": "b"}, r_nodes=("a", "b", "x"), removed_edges=(("n2", "n2"),), added_edges=(("a", "x"), ("x", "b")), added_attrs=(("x", "name", "NEW"),), name="t")
REWRITTEN = f"with e as (select * from ({GEO_E}) where 'n:4' not in (src, dst)) select src, dst from e union all select 'n:3#n2', dst from e where src = 'n:3' union all select src, 'n:3#n2' from e where dst = 'n:3' union all select 'n:3', 'new:t:x' union all select 'new:t:x', 'n:3#n2'"


@query(REWRITTEN)
def rewrite_full(spark, sf):
    """Clones nation 3, removes nation 4, adds a node between the clones."""
    return rewrite(tpch_graph(spark, sf, GEO), RULE, {"n": "n:3", "m": "n:4"})[0].edges


@query(f"select src, dst from ({GEO_E}) where 'n:4' not in (src, dst)")
def rewrite_restrictive(spark, sf):
    return rewrite(tpch_graph(spark, sf, GEO), Rule(("n",), {}, {}, ()), {"n": "n:4"})[0].edges


@query(f"select distinct case src when 'n:4' then 'n:3' else src end src, case dst when 'n:4' then 'n:3' else dst end dst from ({GEO_E})")
def rewrite_expansive(spark, sf):
    return rewrite(tpch_graph(spark, sf, GEO), Rule(("a", "b"), {"a": "a", "b": "b"}, {"a": "m", "b": "m"}, ("m",)), {"a": "n:3", "b": "n:4"})[0].edges


def _typed(spark, sf) -> Typed:
    g = tpch_graph(spark, sf, GEO)
    schema = g.with_(nodes=spark.createDataFrame([(x,) for x in "rncs"], "node_id string"), edges=spark.createDataFrame([("n", "r"), ("c", "n"), ("s", "n")], "src string, dst string"), node_attrs=g.node_attrs.limit(0), edge_attrs=g.edge_attrs)
    return Typed(g, schema, _typing(g))


@query(f"select id node_id, substr(id, 1, 1) as type from ({N['r']} union all {N['n']} union all {N['c']})")
def propagate_remove(spark, sf):
    return _typed(spark, sf).remove_type(frame(spark, [("s",)], "node_id string")).typing


@query(f"select id node_id, substr(id, 1, 1) as type from ({N['r']} union all {N['n']} union all {N['s']}) union all select id||'#'||k, k from ({N['c']}), (values ('c1'), ('c2')) v(k)")
def propagate_clone(spark, sf):
    return _typed(spark, sf).clone_type("c", ["c1", "c2"]).typing


@query(f"select id node_id, substr(id, 1, 1) as type from ({N['r']} union all {N['n']} union all {N['s']}) union all select 'c:'||c_custkey, case c_mktsegment when 'BUILDING' then 'c1' else 'c2' end from customer")
def propagate_clone_controlled(spark, sf):
    control = read(spark, sf, "customer").select(node("c", "c_custkey").alias("node_id"), F.when(F.col("c_mktsegment") == "BUILDING", "c1").otherwise("c2").alias("type"))
    return _typed(spark, sf).clone_type("c", ["c1", "c2"], control).typing


@query("select * from (values ('n', 'r'), ('c', 'n')) v(src, dst)")
def propagate_merge(spark, sf):
    return _typed(spark, sf).merge_data(frame(spark, [("c:1", "c:1"), ("s:1", "c:1")], "old string, new string")).schema.edges


@query("select 'c:'||c_custkey src, 's:'||s_suppkey dst from customer join supplier on c_custkey = s_suppkey")
def schema_check_insert(spark, sf):
    c, s = read(spark, sf, "customer"), read(spark, sf, "supplier")
    wrong = c.join(s, c.c_custkey == s.s_suppkey).select(node("c", "c_custkey").alias("src"), node("s", "s_suppkey").alias("dst"))
    right = c.select(node("c", "c_custkey").alias("src"), node("n", "c_nationkey").alias("dst"))
    return _typed(spark, sf).rejected_edges(wrong.unionByName(right))




# -- languages, spans, complements, levels, versions ------------------------------------------------------------------------


@query("select p_partkey, p_type from part where regexp_full_match(p_type, '.*[A-M]+') and not regexp_full_match(p_type, 'S.*')")
def regex_difference(spark, sf):
    return read(spark, sf, "part").filter(regular.in_difference(F.col("p_type"), F.lit(".*[A-M]+"), F.lit("S.*"))).select("p_partkey", "p_type")


@query("select distinct p_brand, regexp_full_match(p_brand, '\\w*#[13][0-9]*') inside from part")
def regex_subset(spark, sf):
    """A brand as a pattern of one word: is its language part of the other's?"""
    brands = read(spark, sf, "part").select("p_brand").distinct()
    return brands.select("p_brand", regular.pattern_subset(F.col("p_brand"), F.lit(r"\w*#[13][0-9]*")).alias("inside"))


@query("select 'c:'||c_custkey src_left, 's:'||s_suppkey src_right, 'n:'||c_nationkey dst_left, 'n:'||s_nationkey dst_right from customer join supplier on c_custkey = s_suppkey and c_nationkey = s_nationkey")
def relation_span_edges(spark, sf):
    c, s, n = (read(spark, sf, x) for x in ("customer", "supplier", "nation"))
    pairs = c.join(s, c.c_custkey == s.s_suppkey).select(node("c", "c_custkey").alias("left"), node("s", "s_suppkey").alias("right"))
    same = n.select(node("n", "n_nationkey").alias("left"), node("n", "n_nationkey").alias("right"))
    return category.relation_to_span(tpch_graph(spark, sf, ("nation", "customer")), tpch_graph(spark, sf, ("nation", "supplier")), pairs.unionByName(same))[1]


@query(f"with e as (select * from ({GEO_E}) where 'n:4' not in (src, dst)) select src, dst from e union all select 'n:3#u2', dst from e where src = 'n:3' union all select src, 'n:3#u2' from e where dst = 'n:3'")
def pullback_complement(spark, sf):
    """Nation 3 comes from two nodes, nation 4 from none."""
    g = tpch_graph(spark, sf, GEO)
    part = lambda nodes: Graph(frame(spark, [(n,) for n in nodes], "node_id string"), frame(spark, [], "src string, dst string"), frame(spark, [], "node_id string, key string, value string"), frame(spark, [], "src string, dst string, key string, value string"))
    a_b, b_d = frame(spark, [("u1", "x"), ("u2", "x")], "old string, new string"), frame(spark, [("x", "n:3"), ("y", "n:4")], "old string, new string")
    return category.pullback_complement(part(["u1", "u2"]), part(["x", "y"]), g, a_b, b_d)[0].edges


@query("select 'edge' problem, 'n:'||n_nationkey||'->r:'||n_regionkey as at from nation")
def map_violations(spark, sf):
    """The typing with regions taken for nations: edges between the two have no image."""
    t = _typed(spark, sf)
    m = t.typing.select(F.col("node_id").alias("old"), F.when(F.col("type") == "r", "n").otherwise(F.col("type")).alias("new"))
    bare = t.data.with_(node_attrs=t.data.node_attrs.limit(0))
    return category.map_violations(bare, t.schema, m)


def _levels(spark, sf) -> Hierarchy:
    """Data, their types, and one type of types."""
    t = _typed(spark, sf)
    top = Graph(frame(spark, [("x",)], "node_id string"), frame(spark, [("x", "x")], "src string, dst string"), t.schema.node_attrs, t.schema.edge_attrs)
    h = Hierarchy({"low": t.data, "mid": t.schema, "top": top}, attrs={"low": {}, "mid": {}, "top": {}})
    h.add_typing("low", "mid", t.typing.select(F.col("node_id").alias("old"), F.col("type").alias("new")), check=False)
    h.add_typing("mid", "top", frame(spark, [(x, "x") for x in "rncs"], "old string, new string"), check=False)
    return h


@query(f"select id node_id, substr(id, 1, 1) as type from ({GEO_N}) union all select id||'#q', substr(id, 1, 1)||'#q' from ({GEO_N})")
def propagate_clone_two_levels(spark, sf):
    """Cloning the type of types clones types and data, and typings follow."""
    h = _levels(spark, sf)
    h.rewrite("top", Rule(("l",), {"p": "l", "q": "l"}, {"p": "p", "q": "q"}, ("p", "q")), {"l": "x"})
    return h.get_typing("low", "mid").select(F.col("old").alias("node_id"), F.col("new").alias("type"))


@query(f"select id node_id, case when id like 'r:%' then 'y' else 'x' end as type from ({GEO_N})")
def typing_compose(spark, sf):
    """Through the types into a graph of two: regions, and all else."""
    h = _levels(spark, sf)
    top = Graph(frame(spark, [("x",), ("y",)], "node_id string"), frame(spark, [("x", "x"), ("x", "y")], "src string, dst string"), h.graphs["top"].node_attrs, h.graphs["top"].edge_attrs)
    h.add_graph("two", top)
    h.add_typing("mid", "two", frame(spark, [(x, "y" if x == "r" else "x") for x in "rncs"], "old string, new string"), check=False)
    return h.get_typing("low", "two").select(F.col("old").alias("node_id"), F.col("new").alias("type"))


@query("select 'r:'||r_regionkey node_id from region where r_regionkey <> 1 union all select 'n:'||n_nationkey from nation where n_regionkey <> 1")
def disconnected_nodes(spark, sf):
    return _checkpointed(spark, tpch_graph(spark, sf, ("region", "nation"))).disconnected_from("r:1")


@query(f"select src, dst from ({GEO_E})")
def version_rollback(spark, sf):
    """A rewrite is committed and taken back."""
    v = VersionedGraph(tpch_graph(spark, sf, GEO))
    first = v.heads[v.current]
    v.rewrite(RULE, {"n": "n:3", "m": "n:4"})
    v.rollback(first)
    return v.graph.edges


@query(f"{REWRITTEN} union all select 'c:1', 'n:3#n2' from customer where c_custkey = 1 and c_nationkey <> 3")
def version_merge(spark, sf):
    """One branch rewrites, the other adds an edge; both are in the merge."""
    v = VersionedGraph(tpch_graph(spark, sf, GEO))
    v.branch("other")
    v.rewrite(RULE, {"n": "n:3", "m": "n:4"})
    rewritten = v.heads["other"]
    v.branch("more")
    v.graph = v.graph.add_edges(frame(spark, [("c:1", "n:3#n2")], "src string, dst string"))
    v.commit("an edge")
    v.switch_branch("master")
    v.merge_with("more")
    assert rewritten in v.commits
    return v.graph.edges


@query(f"select 'link' kind, src source, dst target from ({GEO_E})")
def d3_links(spark, sf):
    rows = d3_rows(tpch_graph(spark, sf, GEO)).filter("kind = 'link'")
    return rows.select("kind", F.from_json("doc", "source string, target string").alias("x")).select("kind", "x.source", "x.target")


@query("select 'link' kind, 'c:'||c_custkey source, 'n:'||c_nationkey target from customer where c_nationkey < 3")
def d3_export_links(spark, sf):
    g = tpch_graph(spark, sf, ("nation", "customer"))
    chosen = spark.range(3).select(node("n", "id").alias("node_id")).unionByName(g.nodes.filter("node_id like 'c:%'"))
    rows = d3_rows(g, chosen, node_keys=[]).filter("kind = 'link'")
    return rows.select("kind", F.from_json("doc", "source string, target string").alias("x")).select("kind", "x.source", "x.target")


# -- edge attributes, merging, maps, sets of several kinds ------------------------------------------------------------------


def _supplies(spark, sf) -> Graph:
    return tpch_graph(spark, sf, ("supplier", "part"), supplies=True)


FLAGS = "select distinct 's:'||l_suppkey src, 'p:'||l_partkey dst, 'returnflag' key, l_returnflag as value, l_suppkey, l_partkey from lineitem"


@query(f"select src, dst, key, value from ({FLAGS}) where l_partkey >= 10 union all select distinct src, dst, 'returnflag', 'X' from ({FLAGS}) where l_partkey < 10")
def set_edge_attrs(spark, sf):
    rows = read(spark, sf, "lineitem").filter("l_partkey < 10").select(node("s", "l_suppkey").alias("src"), node("p", "l_partkey").alias("dst"), F.lit("returnflag").alias("key"), F.lit("X").alias("value")).distinct()
    return _supplies(spark, sf).set_edge_attrs(rows).edge_attrs


@query("select 'n:3' src, 'r:3' dst, 'since' as key, '1815' as value union all select 'n:3#n2', 'r:3', 'since', '1815' union all select 'n:3', 'r:3', 'kind', 'new'")
def rewrite_edge_attrs(spark, sf):
    """An edge's values: cloned with their edge, one removed, one added."""
    g = tpch_graph(spark, sf, GEO)
    g = g.add_edge_attrs(frame(spark, [("n:3", "r:3", "since", "1815"), ("n:3", "r:3", "kind", "old")], "src string, dst string, key string, value string"))
    rule = Rule(("n", "r"), {"n1": "n", "n2": "n", "r": "r"}, {"n1": "n1", "n2": "n2", "r": "r"}, ("n1", "n2", "r"), removed_edge_attrs=(("n1", "r", "kind", "old"), ("n2", "r", "kind", "old")), added_edge_attrs=(("n1", "r", "kind", "new"),), l_edges=(("n", "r"),), l_edge_attrs=(("n", "r", "kind", "old"),))
    return rewrite(g, rule, {"n": "n:3", "r": "r:3"})[0].edge_attrs


@query("select 'm:'||n_regionkey node_id, 'kind' as key, 'nation' as value from nation group by n_regionkey")
def merge_nodes_intersection(spark, sf):
    """Nations of a region have different names and one kind."""
    g = tpch_graph(spark, sf, ("nation",))
    g = g.add_node_attrs(g.nodes.select("node_id", F.lit("kind").alias("key"), F.lit("nation").alias("value")))
    return g.merge(_by_region(spark, sf), method="intersection").node_attrs


@query(f"select id node_id from ({N['n']}) union all select 'n:3copy'")
def copy_node(spark, sf):
    return tpch_graph(spark, sf, ("region", "nation")).copy_node("n:3", "n:3copy").nodes.filter("node_id like 'n:%'")


@query("select 'c:'||c_custkey||'|s:'||s_suppkey src, 'n:'||n_nationkey||'|n:'||n_nationkey dst from customer join supplier on c_nationkey = s_nationkey join nation on n_nationkey = c_nationkey")
def pullback_edges(spark, sf):
    """Customers and suppliers with their nations, over nations with a loop each."""
    over = lambda table, key, p: _over(spark, sf, table, key, p).unionByName(read(spark, sf, "nation").select(node("n", "n_nationkey").alias("old"), node("n", "n_nationkey").alias("new")))
    return category.pullback_graph(tpch_graph(spark, sf, ("nation", "customer")), tpch_graph(spark, sf, ("nation", "supplier")), over("customer", "c_custkey", "c"), over("supplier", "s_suppkey", "s"))[0].edges


@query("select 'n:'||min(n_nationkey) over (partition by n_regionkey) node_id from nation qualify row_number() over (partition by n_regionkey order by n_nationkey) = 1")
def pushout_merges(spark, sf):
    """Regions' nations, each mapped to its region: gluing nations along regions that both sides know makes one node of a region's nations."""
    n = read(spark, sf, "nation")
    b, c = tpch_graph(spark, sf, ("region",)), tpch_graph(spark, sf, ("nation",))
    to_b = n.select(F.col("n_nationkey").cast("string").alias("old"), node("r", "n_regionkey").alias("new"))
    to_c = n.select(F.col("n_nationkey").cast("string").alias("old"), node("n", "n_nationkey").alias("new"))
    names = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k"), F.min(node("n", "n_nationkey")).alias("least"))
    nodes = category.pushout(b, c, to_b, to_c).nodes
    return nodes.join(names, F.col("node_id") == F.col("least")).select(node("n", "k").alias("node_id"))


@query(f"select id old, case when id = 'n:3' then 'a' else id end as new from ({N['n']})")
def map_utilities(spark, sf):
    own = category.identity(tpch_graph(spark, sf, ("nation",)).nodes)
    return category.compose_chain([own, category.replace_target(own, "n:3", "a")])


@query("select p_partkey, regexp_full_match(p_type, 'S.*') in_regex, p_size between 10 and 20 in_ints, p_size between 10 and 20 or p_size = 3 in_union, regexp_full_match(p_type, 'S.*') and not regexp_full_match(p_type, '.*S') in_difference from part")
def mixed_sets(spark, sf):
    """Finite sets against patterns and intervals, unions of finite sets with intervals, differences of patterns."""
    p = read(spark, sf, "part")
    ints = T.integers(F.array(F.struct(F.lit(10).cast("long").alias("lo"), F.lit(20).cast("long").alias("hi"))))
    size, kind = T.finite(F.array(F.col("p_size").cast("string"))), T.finite(F.array("p_type"))
    s = T.regex(F.lit("S.*"))
    return p.select("p_partkey", T.subset(kind, s).alias("in_regex"), T.subset(size, ints).alias("in_ints"), T.subset(size, T.union(ints, T.finite(F.array(F.lit("3"))))).alias("in_union"), T.contains(T.difference(s, T.regex(F.lit(".*S"))), F.col("p_type")).alias("in_difference"))


@query("select * from (values ('a*', 'a*b*', true), ('[ab]+', 'a+|b+', false), ('a{2,3}', 'aa|aaa', true), ('(?:ab)*', '(ab)*', true), ('a+', 'b+', false)) v(a, b, inside)")
def regex_inclusion(spark, sf):
    pairs = spark.createDataFrame([("a*", "a*b*"), ("[ab]+", "a+|b+"), ("a{2,3}", "aa|aaa"), ("(?:ab)*", "(ab)*"), ("a+", "b+")], "a string, b string")
    return pairs.select("a", "b", T.subset(T.regex(F.col("a")), T.regex(F.col("b"))).alias("inside"))


# -- levels: additions, attributes, strictness, lookups; rules; documents -----------------------------------------------------


@query("select * from (values ('n', 'r'), ('c', 'n'), ('s', 'n'), ('c', 'new:t:x')) v(src, dst)")
def propagate_add(spark, sf):
    """A new node without a type gets one, and its edge is in the types too."""
    h = _levels(spark, sf)
    h.rewrite("low", Rule(("c",), {"c": "c"}, {"c": "c"}, ("c", "x"), added_edges=(("c", "x"),), name="t"), {"c": "c:1"})
    return h.graphs["mid"].edges


@query("select * from (values ('n', 'r', 'w', '1')) v(src, dst, key, value)")
def propagate_attrs(spark, sf):
    """An edge's new value is its type's too."""
    h = _levels(spark, sf)
    rule = Rule(("n", "r"), {"n": "n", "r": "r"}, {"n": "n", "r": "r"}, ("n", "r"), added_edge_attrs=(("n", "r", "w", "1"),), l_edges=(("n", "r"),))
    h.rewrite("low", rule, {"n": "n:3", "r": "r:3"})
    return h.graphs["mid"].edge_attrs


@query("select 'low' graph, 'removed node' problem, 's:'||s_suppkey as at from supplier")
def strict_violations(spark, sf):
    return _levels(spark, sf).strict_violations("mid", Rule(("s",), {}, {}, ()), {"s": "s"})


@query("select 'mid' graph, 'n' as type")
def node_type(spark, sf):
    return spark.createDataFrame(sorted(_levels(spark, sf).node_type("low", "n:3").items()), "graph string, type string")


@query("select 'low' graph")
def graphs_typed_by_node(spark, sf):
    return spark.createDataFrame([(x,) for x in _levels(spark, sf).graphs_typed_by_node("mid", "c")], "graph string")


@query(f"select id old, 'x' as new from ({GEO_N})")
def typing_commutes(spark, sf):
    """A direct typing that says what the path says is accepted."""
    h = _levels(spark, sf)
    h.graphs["low"] = h.graphs["low"].with_(node_attrs=h.graphs["low"].node_attrs.limit(0))
    direct = h.graphs["low"].nodes.select(F.col("node_id").alias("old"), F.lit("x").alias("new"))
    h.add_typing("low", "top", direct)
    return h.typings["low", "top"]


def _two_rules():
    first = Span.of(Rule(("n", "m"), {"n": "n", "m": "m"}, {"n": "nm", "m": "nm"}, ("nm",), name="a"))
    second = Span.of(Rule(("x", "c"), {"x1": "x", "c": "c"}, {"x1": "x1", "c": "c"}, ("x1", "c", "new"), added_edges=(("new", "x1"), ("c", "new")), name="b"))
    return first, second


@query(f"select distinct case src when 'n:4' then 'n:3' else src end src, case dst when 'n:4' then 'n:3' else dst end dst from ({GEO_E}) union all select 'new:ab:new', 'n:3' union all select 'c:1', 'new:ab:new'")
def compose_equals_sequence(spark, sf):
    """Two nations merged, and then a node between a customer and them, as one rule."""
    g = tpch_graph(spark, sf, GEO)
    first, second = _two_rules()
    at1 = {"n": "n:3", "m": "n:4"}
    one, at = first.refined(g, at1)
    between, to1 = rewrite(g, one.rule(), at)
    rule2 = second.rule()
    at2 = {"x": to1[one.p_r["n"]], "c": "c:1"}
    _, to2 = rewrite(between, rule2, at2)
    rule, left, _ = compose(one, at, to1, second, at2, to2)
    return rewrite(g, rule.rule(), left)[0].edges


@query("select * from (values ('added edge', 'new x1'), ('added edge', 'c new'), ('added node', 'new')) v(part, what)")
def rule_components(spark, sf):
    r = _two_rules()[1].rule()
    return spark.createDataFrame([("added node", x) for x in rule_building.added_nodes(r)] + [("added edge", f"{a} {b}") for a, b in r.added_edges], "part string, what string")


@query(f"select id old, substr(id, 1, 1) as new from ({GEO_N})")
def hierarchy_json_roundtrip(spark, sf):
    h = _levels(spark, sf)
    return hierarchy_from_rows(written(hierarchy_rows(h), "hierarchy")).typings["low", "mid"]
