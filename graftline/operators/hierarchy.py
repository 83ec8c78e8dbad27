"""Typed graphs: propagation of changes along a typing (node_id, type)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.graph import Graph
from graftline.operators.category import attribute_violations
from graftline.operators.hierarchies import Hierarchy, HierarchyError
from graftline.operators.pattern import Pattern, match
from graftline.operators.rewrite import Rule


def _refuse(rows: DataFrame, why: str) -> None:
    row = rows.first()
    if row is not None:
        raise HierarchyError(f"{why} {' '.join(map(str, row))}")


@dataclass(frozen=True)
class Typed:
    data: Graph
    schema: Graph
    typing: DataFrame

    # -- lookups -----------------------------------------------------------------------------------------------------------
    def instances(self, name: str) -> DataFrame:
        return self.typing.filter(F.col("type") == name).select("node_id")

    def type_of(self, node: str) -> str | None:
        row = self.typing.filter(F.col("node_id") == node).first()
        return row.type if row else None

    def find_data_matching(self, pattern: Pattern) -> DataFrame:
        """Matches in the data; the pattern's types are of the schema."""
        return match(self.data, pattern, self.typing)

    def find_schema_matching(self, pattern: Pattern) -> DataFrame:
        return match(self.schema, pattern)

    # -- rewriting ---------------------------------------------------------------------------------------------------------
    def hierarchy(self) -> Hierarchy:
        h = Hierarchy({"data": self.data, "schema": self.schema}, attrs={"data": {}, "schema": {}})
        h.typings["data", "schema"] = self.typing.select(F.col("node_id").alias("old"), F.col("type").alias("new"))
        return h

    @staticmethod
    def of(h: Hierarchy) -> Typed:
        return Typed(h.graphs["data"], h.graphs["schema"], h.typings["data", "schema"].select(F.col("old").alias("node_id"), F.col("new").alias("type")))

    def rewrite_data(self, rule: Rule, instance: dict[str, str], rhs_typing: dict | None = None, strict: bool = False) -> Typed:
        """What the data gain or merge is gained or merged in the schema; rhs_typing: node of R -> its type."""
        h = self.hierarchy()
        h.rewrite("data", rule, instance, rhs_typing={"schema": rhs_typing} if rhs_typing else None, strict=strict)
        return Typed.of(h)

    def rewrite_schema(self, rule: Rule, instance: dict[str, str] | None = None, data_typing: dict | None = None, strict: bool = False) -> Typed:
        """What the schema loses or clones is lost or cloned in the data; data_typing: node -> nodes of P whose copies it keeps."""
        h = self.hierarchy()
        h.rewrite("schema", rule, instance, p_typing={"data": data_typing} if data_typing else None, strict=strict)
        return Typed.of(h)

    # -- changes of the data, as the schema allows ----------------------------------------------------------------------------
    def add_data_nodes(self, rows: DataFrame) -> Typed:
        """rows (node_id, type); types must be there, ids mustn't."""
        _refuse(rows.join(self.schema.nodes.withColumnRenamed("node_id", "type"), "type", "left_anti"), "the schema has no type of")
        return Typed(self.data.add_nodes(rows, check=True), self.schema, self.typing.unionByName(rows.select("node_id", "type")))

    def add_data_edges(self, rows: DataFrame) -> Typed:
        _refuse(self.rejected_edges(rows), "the schema has no edge for")
        return Typed(self.data.add_edges(rows, check=True), self.schema, self.typing)

    def add_data_node_attrs(self, rows: DataFrame) -> Typed:
        new = self.data.with_(node_attrs=rows.select("node_id", "key", "value"))
        _refuse(attribute_violations(new, self.schema, self.typing.withColumnsRenamed({"node_id": "old", "type": "new"})), "the schema doesn't allow")
        return Typed(self.data.add_node_attrs(rows), self.schema, self.typing)

    def add_data_edge_attrs(self, rows: DataFrame) -> Typed:
        typed = rows.join(self.typing.select(F.col("node_id").alias("src"), F.col("type").alias("s")), "src").join(self.typing.select(F.col("node_id").alias("dst"), F.col("type").alias("d")), "dst")
        _refuse(typed.join(self.schema.edge_attrs.withColumnsRenamed({"src": "s", "dst": "d"}), ["s", "d", "key", "value"], "left_anti").select("src", "dst", "key", "value"), "the schema doesn't allow")
        return Typed(self.data.add_edge_attrs(rows), self.schema, self.typing)

    def merge_data_nodes(self, moved: DataFrame) -> Typed:
        """moved (old, new): only nodes of one type are merged."""
        mixed = moved.join(self.typing.withColumnRenamed("node_id", "old"), "old").groupBy("new").agg(F.countDistinct("type").alias("n")).filter("n > 1").select("new")
        _refuse(mixed, "different types would be merged into")
        typing = self.typing.join(moved.withColumnRenamed("old", "node_id"), "node_id", "left").select(F.coalesce("new", "node_id").alias("node_id"), "type").distinct()
        return Typed(self.data.rename(moved), self.schema, typing)

    def remove_data_nodes(self, rows: DataFrame) -> Typed:
        return Typed(self.data.remove_nodes(rows, check=True), self.schema, self.typing.join(rows.select("node_id"), "node_id", "left_anti"))

    def remove_data_edges(self, rows: DataFrame) -> Typed:
        return Typed(self.data.remove_edges(rows, check=True), self.schema, self.typing)

    def remove_data_node_attrs(self, rows: DataFrame) -> Typed:
        return Typed(self.data.remove_node_attrs(rows), self.schema, self.typing)

    def relabel_data_nodes(self, moved: DataFrame) -> Typed:
        typing = self.typing.join(moved.withColumnRenamed("old", "node_id"), "node_id", "left").select(F.coalesce("new", "node_id").alias("node_id"), "type")
        return Typed(self.data.rename(moved), self.schema, typing)

    # -- changes of the schema: removals are refused while the data use what goes ------------------------------------------------
    def add_schema_nodes(self, rows: DataFrame) -> Typed:
        return Typed(self.data, self.schema.add_nodes(rows, check=True), self.typing)

    def add_schema_edges(self, rows: DataFrame) -> Typed:
        return Typed(self.data, self.schema.add_edges(rows, check=True), self.typing)

    def add_schema_node_attrs(self, rows: DataFrame) -> Typed:
        return Typed(self.data, self.schema.add_node_attrs(rows), self.typing)

    def relabel_schema_nodes(self, moved: DataFrame) -> Typed:
        typing = self.typing.join(moved.withColumnRenamed("old", "type"), "type", "left").select("node_id", F.coalesce("new", "type").alias("type"))
        return Typed(self.data, self.schema.rename(moved), typing)

    def remove_schema_nodes(self, rows: DataFrame) -> Typed:
        _refuse(self.typing.join(rows.select(F.col("node_id").alias("type")), "type", "left_semi"), "there are instances:")
        return Typed(self.data, self.schema.remove_nodes(rows, check=True), self.typing)

    def _over(self, table: DataFrame) -> DataFrame:
        """The data's edges or their attributes with types s and d."""
        return table.join(self.typing.select(F.col("node_id").alias("src"), F.col("type").alias("s")), "src").join(self.typing.select(F.col("node_id").alias("dst"), F.col("type").alias("d")), "dst")

    def remove_schema_edges(self, rows: DataFrame) -> Typed:
        _refuse(self._over(self.data.edges).join(rows.select(F.col("src").alias("s"), F.col("dst").alias("d")), ["s", "d"], "left_semi").select("src", "dst"), "there are instances:")
        return Typed(self.data, self.schema.remove_edges(rows, check=True), self.typing)

    def remove_schema_node_attrs(self, rows: DataFrame) -> Typed:
        used = self.data.node_attrs.join(self.typing, "node_id").join(rows.withColumnRenamed("node_id", "type"), ["type", "key", "value"], "left_semi")
        _refuse(used.select("node_id", "key", "value"), "there are instances:")
        return Typed(self.data, self.schema.remove_node_attrs(rows), self.typing)

    def remove_schema_edge_attrs(self, rows: DataFrame) -> Typed:
        used = self._over(self.data.edge_attrs).join(rows.withColumnsRenamed({"src": "s", "dst": "d"}), ["s", "d", "key", "value"], "left_semi")
        _refuse(used.select("src", "dst", "key", "value"), "there are instances:")
        return Typed(self.data, self.schema.remove_edge_attrs(rows), self.typing)

    def remove_type(self, types: DataFrame) -> Typed:
        """Removing types removes their instances."""
        kept = self.typing.join(types.select(F.col("node_id").alias("type")), "type", "left_anti").select("node_id", "type")
        gone = self.typing.join(types.select(F.col("node_id").alias("type")), "type", "left_semi").select("node_id")
        return Typed(self.data.remove_nodes(gone), self.schema.remove_nodes(types), kept)

    def clone_type(self, name: str, copies: list[str], control: DataFrame | None = None) -> Typed:
        """Cloning a type clones its instances, one for each copy; control (node_id, type) says which copies an instance keeps."""
        spark = self.typing.sparkSession
        made = F.broadcast(spark.createDataFrame([(name, c) for c in copies], "type string, copy string"))
        fan = self.typing.join(made, "type").select("node_id", "copy")
        if control is not None:
            named = control.select("node_id", F.col("type").alias("copy"))
            fan = fan.join(named, ["node_id", "copy"], "left_semi").unionByName(fan.join(named.select("node_id"), "node_id", "left_anti"))
            single = fan.join(named, ["node_id", "copy"], "left_semi").select(F.col("node_id").alias("old"), F.col("node_id").alias("new"), "copy")
            both = fan.join(named.select("node_id"), "node_id", "left_anti").select(F.col("node_id").alias("old"), F.concat("node_id", F.lit("#"), "copy").alias("new"), "copy")
            moved = single.unionByName(both)
        else:
            moved = fan.select(F.col("node_id").alias("old"), F.concat("node_id", F.lit("#"), "copy").alias("new"), "copy")
        typing = self.typing.filter(F.col("type") != name).select("node_id", "type").unionByName(moved.select(F.col("new").alias("node_id"), F.col("copy").alias("type")))
        schema = self.schema.rename(made.select(F.col("type").alias("old"), F.col("copy").alias("new")))
        return Typed(self.data.rename(moved.select("old", "new")), schema, typing)

    def merge_data(self, moved: DataFrame) -> Typed:
        """Merging instances merges their types; moved (old, new)."""
        typed = moved.join(self.typing.withColumnsRenamed({"node_id": "old", "type": "t"}), "old").groupBy("new").agg(F.min("t").alias("to"), F.collect_set("t").alias("ts"))
        types = typed.select(F.explode("ts").alias("old"), F.col("to").alias("new")).distinct()
        typing = self.typing.join(moved.withColumnRenamed("old", "node_id"), "node_id", "left").select(F.coalesce("new", "node_id").alias("node_id"), "type")
        typing = typing.join(types.withColumnsRenamed({"old": "type", "new": "to"}), "type", "left").select("node_id", F.coalesce("to", "type").alias("type")).distinct()
        return Typed(self.data.rename(moved), self.schema.rename(types), typing)

    def rejected_edges(self, proposed: DataFrame) -> DataFrame:
        """Proposed edges that the schema doesn't allow."""
        typed = proposed.join(self.typing.select(F.col("node_id").alias("src"), F.col("type").alias("s")), "src").join(self.typing.select(F.col("node_id").alias("dst"), F.col("type").alias("d")), "dst")
        return typed.join(self.schema.edges.select(F.col("src").alias("s"), F.col("dst").alias("d")), ["s", "d"], "left_anti").select("src", "dst")
