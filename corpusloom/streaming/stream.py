"""Structured Streaming forms: windows over events, late data, dedupe, incremental upserts, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events as a stream; ``ts`` as a timestamp."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def clamp_future(df: DataFrame, ts: str, collected: str) -> DataFrame:
    """Times after collection are set to it, before a watermark sees them."""
    return df.withColumn(ts, F.least(ts, collected))


def tumbling(df: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    return df.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")) if df.isStreaming else df.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(df: DataFrame, size: str = "2 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    src = df.withWatermark("ts", late) if df.isStreaming else df
    return src.groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"))


def sessions(df: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    src = df.withWatermark("ts", late) if df.isStreaming else df
    return src.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def first_seen(df: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """One row per key within the watermark."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Works off what there is and stops; a second run goes on from the checkpoint."""
    df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A row per key: the last in ``order``, ties broken by all columns."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order]))
    return rows.groupBy(*keys).agg(last.alias("__last")).select(*keys, "__last.*").select(*rows.columns)


def upsert_batches(df: DataFrame, table: str, keys: list[str], checkpoint: str, *, order: tuple[str, ...] = ()) -> None:
    """Each micro-batch is written as a version of its own, with the last row of each key in ``order``; no version before it is touched, and a batch
    that is run again writes the same version again. ``read_upserted`` has the table."""

    def merge(batch: DataFrame, number: int) -> None:
        newest(batch, keys, list(order)).write.mode("overwrite").parquet(f"{table}/version={number}")

    df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_upserted(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """The table of ``upsert_batches``: of each key the row of its last version."""
    return newest(spark.read.option("basePath", table).parquet(f"{table}/version=*"), keys, ["version"]).drop("version")


def compact(spark: SparkSession, table: str, keys: list[str], into: str) -> None:
    """All versions as one, in another folder."""
    read_upserted(spark, table, keys).write.mode("overwrite").parquet(f"{into}/version=0")
