"""What the operators share: word splitting, tables in the shared folder, gapless numbering."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space: the space and these.
SPACES = "\t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Words of a text; null and blank texts have none. Splitting at one plain character avoids the regular expression."""
    text = F.coalesce(text, F.lit(""))
    for x in SPACES:
        text = F.replace(text, F.lit(x), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one in local mode; elsewhere executors couldn't see that, so it's an error."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        held = "file://" + tempfile.mkdtemp(prefix="graftline-")
        spark.sparkContext.setCheckpointDir(held)
        atexit.register(shutil.rmtree, held[len("file://") :], True)
    return held


#: With it Spark removes a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: its rows stay as they are, whatever executor is lost. Shuffle files go when it's written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    held = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if held is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, held)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that store() wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Groups times buckets in gapless(): what it broadcasts has at most so many rows.
MOST_BUCKETS = 65_536


def gapless(df: DataFrame, group: str, groups: int, uid: str, name: str) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, in no given order.

    df must be stored (it is read twice), with a distinct `uid` in each row; `groups` bounds the distinct groups. A group
    is dealt over many buckets by uid, so that no task holds a whole group; what is broadcast has MOST_BUCKETS rows at most."""
    buckets = max(1, min(partitions(df.sparkSession), MOST_BUCKETS // groups))
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(uid), F.lit(buckets)))
    order = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(group, "__bucket").agg(F.count("*").alias("__n")).select(group, "__bucket", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__base"))
    at = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(uid))
    return df.withColumn("__at", at).join(F.broadcast(base), [group, "__bucket"]).withColumn(name, F.col("__base") + F.col("__at") - 1).drop("__bucket", "__at", "__base")
