import pytest
from pyspark.sql import functions as F

from graftline.graph import Graph
from graftline.operators import category
from graftline.operators.hierarchies import Hierarchy, HierarchyError
from graftline.operators.pattern import Pattern
from graftline.operators.rewrite import Rule


def graph(spark, nodes, edges=(), attrs=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return Graph(make([(n,) for n in nodes], "node_id string"), make(edges, "src string, dst string"), make(attrs, "node_id string, key string, value string"), make([], "src string, dst string, key string, value string"))


def pairs(spark, d, cols=("old", "new")):
    return spark.createDataFrame(list(d.items() if isinstance(d, dict) else d), " string, ".join(cols) + " string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def three_levels(spark):
    h = Hierarchy()
    h.add_graph("top", graph(spark, ["T", "S"], [("T", "T"), ("T", "S")], [("T", "k", "1")]))
    h.add_graph("mid", graph(spark, ["a", "b"], [("a", "b")], [("a", "k", "1")]))
    h.add_graph("low", graph(spark, ["x", "y", "z"], [("x", "z"), ("y", "z")], [("x", "k", "1")]))
    h.add_typing("mid", "top", pairs(spark, {"a": "T", "b": "T"}))
    h.add_typing("low", "mid", pairs(spark, {"x": "a", "y": "a", "z": "b"}))
    return h


def test_catalogue(spark):
    h = three_levels(spark)
    assert rows(h.get_typing("low", "top")) == [("x", "T"), ("y", "T"), ("z", "T")]
    assert h.above("low") == ["mid", "top"] and h.below("top") == ["mid", "low"] and h.node_type("low", "x") == {"mid": "a"}
    with pytest.raises(HierarchyError, match="cycle"):
        h.add_typing("top", "low", pairs(spark, {"T": "x", "S": "x"}))
    with pytest.raises(HierarchyError, match="commute"):
        h.add_typing("low", "top", pairs(spark, {"x": "T", "y": "T", "z": "S"}))
    assert rows(h.find_matching("low", Pattern({"m": {}, "n": {}}, {("m", "n"): {}}), {"mid": {"n": "b"}})) == [("x", "z"), ("y", "z")]
    h.add_relation("low", "top", pairs(spark, [("x", "S")], ("left", "right")))
    assert rows(h.get_relation("top", "low")) == [("S", "x")] and h.adjacent_relations("top") == ["low"]
    h.remove_graph("mid", reconnect=True)
    assert rows(h.get_typing("low", "top")) == [("x", "T"), ("y", "T"), ("z", "T")]


def test_clone_goes_down_under_control(spark):
    h = three_levels(spark)
    rule = Rule(("l",), {"p": "l", "q": "l"}, {"p": "p", "q": "q"}, ("p", "q"))
    h.rewrite("mid", rule, {"l": "a"}, p_typing={"low": {"x": "p"}})
    assert rows(h.graphs["mid"].nodes) == [("a",), ("a#q",), ("b",)]
    assert rows(h.graphs["low"].nodes) == [("x",), ("y",), ("y#q",), ("z",)]
    assert rows(h.get_typing("low", "mid")) == [("x", "a"), ("y", "a"), ("y#q", "a#q"), ("z", "b")]
    assert rows(h.get_typing("mid", "top")) == [("a", "T"), ("a#q", "T"), ("b", "T")]
    assert category.map_violations(h.graphs["low"], h.graphs["mid"], h.get_typing("low", "mid")).isEmpty()


def test_clone_at_the_top_reaches_two_levels(spark):
    h = three_levels(spark)
    h.rewrite("top", Rule(("l",), {"p": "l", "q": "l"}, {"p": "p", "q": "q"}, ("p", "q"), removed_edges=(("p", "p"), ("q", "q"), ("q", "p"))), {"l": "T"})
    assert h.graphs["mid"].nodes.count() == 4 and h.graphs["low"].nodes.count() == 6
    assert rows(h.graphs["mid"].edges) == [("a", "b#q")]
    for s, t in (("low", "mid"), ("mid", "top"), ("low", "top")):
        assert category.map_violations(h.graphs[s], h.graphs[t], h.get_typing(s, t)).isEmpty()


def test_removal_goes_down_and_gains_go_up(spark):
    h = three_levels(spark)
    h.rewrite("mid", Rule(("l",), {}, {}, ()), {"l": "a"})
    assert rows(h.graphs["low"].nodes) == [("z",)] and rows(h.graphs["top"].nodes) == [("S",), ("T",)]
    h = three_levels(spark)
    add = Rule(("l",), {"l": "l"}, {"l": "l"}, ("l", "n", "m"), added_edges=(("l", "n"),), added_attrs=(("n", "k", "2"),), name="r")
    with pytest.raises(HierarchyError, match="strict"):
        h.rewrite("low", add, {"l": "x"}, strict=True)
    h.rewrite("low", add, {"l": "x"}, rhs_typing={"mid": {"n": "b"}})
    assert rows(h.graphs["mid"].nodes) == [("a",), ("b",), ("new:r:m",)] and rows(h.graphs["top"].nodes) == [("S",), ("T",), ("new:r:m",)]
    assert ("b", "k", "2") in rows(h.graphs["mid"].node_attrs) and ("T", "k", "2") in rows(h.graphs["top"].node_attrs)
    assert rows(h.get_typing("low", "top"))[0] == ("new:r:m", "new:r:m")


def test_merge_goes_up(spark):
    h = three_levels(spark)
    h.rewrite("low", Rule(("l", "r"), {"l": "l", "r": "r"}, {"l": "m", "r": "m"}, ("m",)), {"l": "x", "r": "z"})
    assert rows(h.graphs["mid"].nodes) == [("a",)] and rows(h.graphs["mid"].edges) == [("a", "a")]
    assert rows(h.get_typing("low", "mid")) == [("x", "a"), ("y", "a")]


def test_pullback_complement_and_universal_maps(spark):
    a = graph(spark, ["2", "3"], [("2", "3")])
    b = graph(spark, ["1", "2", "3"], [("1", "2"), ("2", "3")])
    d = graph(spark, ["square", "circle", "dark_square", "dark_circle"], [("square", "circle"), ("circle", "dark_circle"), ("circle", "dark_square"), ("circle", "circle")])
    c, c_d = category.pullback_complement(a, b, d, pairs(spark, {"2": "2", "3": "3"}), pairs(spark, {"1": "square", "2": "circle", "3": "dark_circle"}))
    assert rows(c.nodes) == [("circle",), ("dark_circle",), ("dark_square",)]
    assert rows(c.edges) == [("circle", "circle"), ("circle", "dark_circle"), ("circle", "dark_square")]
    assert rows(c_d)[0] == ("circle", "circle")
    ident = pairs(spark, {"2": "2"})
    assert rows(category.map_to_pullback(ident, ident, ident, ident)) == [("2", "2")]
    assert rows(category.map_from_pushout(ident, ident, pairs(spark, {"2": "z"}), pairs(spark, {"2": "w"}))) == [("2", "w"), ("2", "z")]
    span = category.relation_to_span(a, b, pairs(spark, [("2", "1"), ("3", "2"), ("3", "3")], ("left", "right")))
    assert rows(span[1]) == [("2", "1", "3", "2")]


def test_pullback_over_one_node(spark):
    """The pairs over a node with many over it are made by many tasks."""
    over = lambda prefix, n: pairs(spark, {f"{prefix}{i}": "x" for i in range(n)} | {f"{prefix}y": f"{prefix}y"})
    nodes = category.pullback(graph(spark, ["x"], []), graph(spark, ["x"], []), over("b", 300), over("c", 200))[0]
    by_task = [r["count"] for r in nodes.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(by_task) == nodes.distinct().count() == 300 * 200
    assert max(by_task) <= sum(by_task) / 8
