"""What the operators of this subpackage share: scratch tables, word rules, bounded broadcasts, union-find."""

from __future__ import annotations

import gc
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: A key counts as hot when it holds more than this share of all rows, so at most 1 / share keys are hot.
HOT_SHARE = 1 / 1000


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names. Where that is unset, a local master gets a local folder; a cluster is
    refused, as each executor would write to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/corpusloom-checkpoints"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/corpusloom/{tag}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes, so that a run of very long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def written(df: DataFrame, tag: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts the lineage of ``df`` with a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    schema = df.schema
    return spark.read.schema(schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that no one holds any more. It does so when the driver's garbage is collected, which between two steps of
    a job may be long after the first has ended. What Python held is let go in the background, hence the pause and
    the second collection."""
    gc.collect()
    for _ in range(2):
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def nested(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one struct, so that no name of the caller's meets one of an operator's."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias(name)


def unnested(names: list[str], name: str = "row") -> list[Column]:
    """The fields ``names`` of the struct as columns again."""
    return [F.col(name).getField(c).alias(c) for c in names]


def hot_split(rows: DataFrame, counted: DataFrame, keys: list[str], total: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Splits a join of ``rows`` with ``counted`` (one row per key, ``n`` rows of it in ``rows``) at its hot keys.

    Returns (rows of hot keys joined, the other rows, the other keys). A hot key has over ``HOT_SHARE`` of ``total`` rows, so there are at
    most 1000 of them at any input size: that is the proven bound on what is broadcast.
    """
    limit = max(int(total * HOT_SHARE), 1000)
    hot = counted.where(F.col("n") > limit)
    cold = counted.where(F.col("n") <= limit)
    joined = rows.join(F.broadcast(hot), keys, "inner")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return joined, rest, cold


def find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def components(edges: DataFrame, tag: str, max_rounds: int = 60) -> DataFrame:
    """Connected components: (a, b) edges of longs to (node, component), the component being its smallest node.

    Alternates large-star and small-star rounds; each is one grouped minimum and one equi-join, so no neighbourhood is gathered in a task and
    a hub is split by the skew join. Rounds end when the edge set no longer changes; each is written to the shared folder.
    Empty input gives an empty result. Null ends are dropped.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, before = written(e, tag), None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), tag)
        mark = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = step
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component"))), tag)
