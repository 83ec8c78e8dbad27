"""Least members of classes, by iteration over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.sources.exports import written


def classes(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) -> (old, new): each node of a pair and the least node that pairs, followed either way, link it with.

    Rounds pass the least known name on to neighbours and then to what that name knows by now, so names travel twice as far each round; each round is
    aggregations with map-side combining, written to the shared folder."""
    both = written(pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "pairs")
    names = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("name")), "names")
    while True:
        heard = both.join(names.select(F.col("u").alias("v"), "name"), "v").groupBy("u").agg(F.min("name").alias("heard"))
        near = names.join(heard, "u").select("u", F.least("name", "heard").alias("name"))
        far = near.join(names.select(F.col("u").alias("name"), F.col("name").alias("further")), "name").select("u", F.least("name", "further").alias("name"))
        new = written(far, "names")
        if new.join(names, ["u", "name"], "left_anti").isEmpty():
            return new.select(F.col("u").alias("old"), F.col("name").alias("new"))
        names = new
