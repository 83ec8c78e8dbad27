import pytest

from graftline.operators.pattern import Pattern
from graftline.operators.rewrite import Rule
from graftline.operators.rule_building import RuleBuilder, added_nodes, cloned_nodes, from_commands, is_restrictive, merged_nodes, removed_nodes, to_commands
from graftline.operators.versioning import VersionedGraph
from test_hierarchies import graph, rows

PATTERN = Pattern({"a": {"k": ["1"]}, "b": {}, "c": {}}, {("a", "b"): {}, ("b", "c"): {}})


def test_commands_and_steps_give_the_same_rule():
    script = "clone a as a1. DELETE_EDGE a1 b. delete_node c. ADD_NODE x {'k': ['1.5', '2'], j: 3}. ADD_EDGE x b. MERGE [a, b] AS m. UPDATE_NODE_ATTRS a1 {k: 7}."
    built = RuleBuilder(PATTERN).clone("a", "a1").remove_edge("a1", "b").remove_node("c").add_node("x", {"k": ["1.5", "2"], "j": ["3"]}).add_edge("x", "b").merge(["a", "b"], "m").update_node_attrs("a1", {"k": ["7"]}).build()
    rule = from_commands(PATTERN, script)
    assert rule == built and from_commands(PATTERN, to_commands(rule)).p_l == rule.p_l
    assert removed_nodes(rule) == ["c"] and cloned_nodes(rule) == {"a": ["a", "a1"]} and merged_nodes(rule) == {"m": ["a", "b"]} and added_nodes(rule) == ["x"]
    assert rule.added_edges == (("x", "m"),) and rule.removed_attrs == (("a1", "k", "1"),) and is_restrictive(rule)
    for bad in ("DELETE_NODE z.", "FLY a.", "CLONE a AS b.", "DELETE_EDGE c a.", "ADD_NODE q"):
        with pytest.raises(ValueError):
            from_commands(PATTERN, bad)


def test_branch_merge_rollback(spark):
    g = graph(spark, ["circle", "square"], [("circle", "square")], [("circle", "k", "1")])
    v = VersionedGraph(g)
    first = v.heads["master"]
    v.branch("test")
    clone = Rule(("l",), {"p": "l", "q": "l"}, {"p": "p", "q": "q"}, ("p", "q"))
    v.rewrite(clone, {"l": "square"}, "clone square")
    assert rows(v.graph.edges) == [("circle", "square"), ("circle", "square#q")]
    v.switch_branch("master")
    assert rows(v.graph.edges) == [("circle", "square")]
    _, second = v.rewrite(Rule(("l",), {"l": "l"}, {"l": "l"}, ("l", "n"), added_edges=(("l", "n"),), added_attrs=(("l", "k", "2"),), name="add"), {"l": "circle"}, "add")
    v.merge_with("test")
    assert rows(v.graph.edges) == [("circle", "new:add:n"), ("circle", "square"), ("circle", "square#q")] and v.branches() == ["master"]
    v.rollback(second)
    assert rows(v.graph.nodes) == [("circle",), ("new:add:n",), ("square",)] and rows(v.graph.node_attrs) == [("circle", "k", "1"), ("circle", "k", "2")]
    v.rollback(first)
    assert rows(v.graph.nodes) == [("circle",), ("square",)] and rows(v.graph.node_attrs) == [("circle", "k", "1")]
    assert [x.message for x in v.history(spark).collect()] == ["initial commit"]
    v.branch("other")
    v.rewrite(Rule(("l",), {}, {}, ()), {"l": "square"}, "remove")
    v.switch_branch("master")
    v.rewrite(Rule(("l",), {"l": "l"}, {"l": "l"}, ("l", "n"), added_edges=(("l", "n"),), name="grow"), {"l": "square"})
    v.merge_with("other")
    assert rows(v.graph.nodes) == [("circle",), ("new:grow:n",)] and rows(v.graph.edges) == []
