"""Graphs and hierarchies as JSON and as data for force layouts; rows in shared folders."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.graph import Graph


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, one of our own in local mode; elsewhere executors couldn't see that, so it's an error."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        held = "file://" + tempfile.mkdtemp(prefix="graphs-")
        spark.sparkContext.setCheckpointDir(held)
        atexit.register(shutil.rmtree, held[len("file://") :], True)
    return held


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut, and the rows outlive any executor."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_graph(g: Graph, tag: str) -> Graph:
    return Graph(*[written(df, f"{tag}-{part}") for df, part in zip((g.nodes, g.edges, g.node_attrs, g.edge_attrs), ("nodes", "edges", "node_attrs", "edge_attrs"))])


def d3_rows(g: Graph, nodes: DataFrame | None = None, node_keys: list[str] | None = None, edge_keys: list[str] | None = None) -> DataFrame:
    """(kind, doc): {"id", "attrs"} for nodes and {"source", "target", "attrs"} for links, one document a row; of chosen nodes (node_id) and keys only, if given."""
    if nodes is not None:
        g = g.subgraph(nodes)
    only = lambda df, keys: df if keys is None else df.filter(F.col("key").isin(keys))
    g = g.with_(node_attrs=only(g.node_attrs, node_keys), edge_attrs=only(g.edge_attrs, edge_keys))

    def sets(df: DataFrame, attrs: DataFrame, keys: list[str]) -> DataFrame:
        own = attrs.groupBy(*keys, "key").agg(F.sort_array(F.collect_set("value")).alias("vs")).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "vs")))).alias("attrs"))
        return df.join(own, keys, "left")

    nodes = sets(g.nodes, g.node_attrs, ["node_id"]).select(F.lit("node").alias("kind"), F.to_json(F.struct(F.col("node_id").alias("id"), "attrs")).alias("doc"))
    links = sets(g.edges, g.edge_attrs, ["src", "dst"]).select(F.lit("link").alias("kind"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "attrs")).alias("doc"))
    return nodes.unionByName(links)
