"""Traversal of paths longer than any fixed number of rounds."""

import pytest

from graftline.graph import Graph


def test_long_paths(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    n = 70
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1)
    g = Graph(frame([(f"n{i}",) for i in range(n)] + [("far",)], "node_id string"), frame([(f"n{i}", f"n{i + 1}") for i in range(n - 1)], "src string, dst string"), frame([], "node_id string, key string, value string"), frame([], "src string, dst string, key string, value string"))
    first = frame([("n0",)], "node_id string")
    assert {r.node_id for r in g.descendants(first).collect()} == {f"n{i}" for i in range(1, n)}
    assert [r.node_id for r in g.disconnected_from("n0").collect()] == ["far"]
    with pytest.raises(ValueError):
        g.descendants(first, 3)
