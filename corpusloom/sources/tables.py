"""Readers and writers: raw records, manual imports, product aggregates, scores, manifests, and tables in the shared folder."""

from __future__ import annotations

import json
import re
import uuid
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW = "source string, source_native_id string, url string, author_raw string, created_utc timestamp, text string, meta string, collected_at timestamp, collector_version string, _corrupt_record string"
AGGREGATE = "product_id string, product_title string, url string, extracted_at string, average_rating double, rating_count int, rating_distribution map<string,int>, opinions array<struct<question string, options map<string,int>>>"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where that is unset, a local master gets a local folder; a cluster is refused, as each
    executor would write to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/corpusloom-checkpoints"
    return f"{root.rstrip('/')}/corpusloom/{tag}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = scratch(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table of fewer bytes (by the plan's estimate) is dealt out, to so many tasks at most: a bound that does not grow with a cluster.
SPREAD_BYTES, SPREAD_TASKS = 256 << 20, 64


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to more tasks where it is so small that its splits do not do that (one row group is one task). Anything larger stays as it is
    read, whatever the cores."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(min(df.sparkSession.sparkContext.defaultParallelism, SPREAD_TASKS)) if size < SPREAD_BYTES else df


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes, so that texts of any length cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Parts ``<source>/<date>/part-*.json`` (or jsonl) with a column ``rejected`` (bad JSON, blank text, over 2 % replacement characters)."""
    from corpusloom.functions.text import mojibake_share

    raw = spark.read.schema(RAW).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("lineSep", "\n").json(f"{folder}/*/*/part-*.json*")
    raw = raw.withColumn("file", F.input_file_name()).where(~F.col("file").contains("/_compliance/")).withColumn("line", F.monotonically_increasing_id())
    bad = F.col("_corrupt_record").isNotNull() | (F.trim(F.coalesce("text", F.lit(""))) == "") | (mojibake_share(F.col("text")) > 0.02)
    clamped = F.least("created_utc", "collected_at")
    return raw.withColumn("rejected", F.coalesce(bad, F.lit(True))).withColumn("created_utc", clamped)


def latest_raw(raw: DataFrame) -> DataFrame:
    """Of accepted records the last written per (source, native id): later files, then later lines."""
    w = Window.partitionBy("source", "source_native_id").orderBy(F.desc("file"), F.desc("line"))
    return raw.where(~F.col("rejected")).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "_corrupt_record", "rejected")


def write_raw(df: DataFrame, folder: str) -> None:
    """Appends records by source and date, one of each native id, a record a line."""
    rows = df.dropDuplicates(["source", "source_native_id"]).withColumn("by_source", F.col("source")).withColumn("run_date", F.to_date("collected_at"))
    rows.write.mode("append").partitionBy("by_source", "run_date").option("lineSep", "\n").json(folder)


_ITEM = "struct<id:string,native_id:string,source:string,url:string,text:string,body:string,author:string,timestamp:string,created:string,date:string,meta:map<string,string>>"


def _manual(spark: SparkSession, folder: str, files: str) -> DataFrame:
    found = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", files).text(folder).withColumn("file", F.input_file_name())
    found = found.where(~F.col("file").rlike(r"(?i)/(?:readme[^/]*|[._][^/]*)$"))
    whole = F.from_json("value", f"struct<documents:array<{_ITEM}>>")["documents"]
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    each = F.transform(lines, lambda x: F.from_json(x, _ITEM))
    is_lines = (F.size(lines) > 1) & F.forall(lines, lambda x: F.trim(x).startswith("{") & F.trim(x).endswith("}"))
    return found.select("file", F.when(is_lines, each).otherwise(F.coalesce(whole, F.from_json("value", f"array<{_ITEM}>"), F.array(F.from_json("value", _ITEM)))).alias("items"))


def read_manual(spark: SparkSession, folder: str, files: str = "*.json*") -> DataFrame:
    """Hand-made JSON: an object with ``documents``, an array, an object, or an object a line; aliases of id, text and date are accepted. Items without
    text go; ``bad_manual`` names files that give none."""
    rows = _manual(spark, folder, files).select("file", F.explode("items").alias("d")).withColumn("text", F.coalesce("d.text", "d.body"))
    return rows.where("trim(coalesce(text, '')) <> ''").select("file", F.coalesce("d.native_id", "d.id").alias("native_id"), "d.source", "d.url", "text", "d.author", F.coalesce("d.timestamp", "d.created", "d.date").alias("created"), "d.meta")


def bad_manual(spark: SparkSession, folder: str, files: str = "*.json*") -> DataFrame:
    """(file) of which no item with text can be read."""
    return _manual(spark, folder, files).select("file").join(read_manual(spark, folder, files).select("file"), "file", "left_anti")


def read_aggregates(spark: SparkSession, folder: str, files: str = "*.json") -> DataFrame:
    """A JSON file per product, in any folder below; unreadable files are skipped, of several the newest extraction stands (ties: the later file)."""
    found = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", files).text(folder).withColumn("file", F.input_file_name())
    rows = found.withColumn("a", F.from_json("value", AGGREGATE)).where("a.product_id is not null").select("file", "a.*")
    w = Window.partitionBy("product_id").orderBy(F.desc("extracted_at"), F.desc("file"))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """The scores file, sorted by score alone; columns under older names are taken, bad numbers are null, shares over 1 are percent."""
    raw = spark.read.option("header", True).csv(path)
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in raw.columns], F.lit(None).cast("string"))
    share = first("prevalence", "share").try_cast("double")
    return raw.withColumn("score", first("score", "opportunity_score").try_cast("double")).withColumn("prevalence", F.when(share > 1, share / 100).otherwise(share)).orderBy(F.desc_nulls_last("score"))


def write_csv(df: DataFrame, path: str) -> None:
    """A report of few rows as one file, in the order of ``df``."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


@contextmanager
def run_log(spark: SparkSession, path: str, stage: str, config_hash: str = ""):
    """An audit row per stage, also when it fails; fill ``entry`` inside."""
    entry = {"run_id": uuid.uuid4().hex, "stage": stage, "config_hash": config_hash, "started_at": datetime.now(timezone.utc), "records_in": 0, "records_out": 0, "notes": ""}
    try:
        yield entry
    except Exception as error:
        entry["notes"] = f"failed: {type(error).__name__}"
        raise
    finally:
        row = [(entry["run_id"], stage, config_hash, entry["started_at"], datetime.now(timezone.utc), entry["records_in"], entry["records_out"], entry["notes"])]
        spark.createDataFrame(row, "run_id string, stage string, config_hash string, started_at timestamp, finished_at timestamp, records_in long, records_out long, notes string").coalesce(1).write.mode("append").parquet(path)


def config_hash(config: dict) -> str:
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def manifest_exists(manifests: DataFrame, source: str, run_date) -> bool:
    """Whether a source has a finished manifest of that day: then its collection is skipped."""
    return not manifests.where((F.col("source") == source) & (F.col("run_date") == F.lit(run_date).cast("date")) & (F.col("status") == "ok")).isEmpty()


def manifest_of(records: DataFrame, *, status: str = "ok", notes: str = "") -> DataFrame:
    """(source, run_date, status, records, first, last, notes): a manifest row per source and day of what was collected."""
    return records.groupBy("source", F.to_date("collected_at").alias("run_date")).agg(F.count("*").alias("records"), F.min("created_utc").alias("first"), F.max("created_utc").alias("last")).select("source", "run_date", F.lit(status).alias("status"), "records", "first", "last", F.lit(notes).alias("notes"))


def read_terms(spark: SparkSession, path: str) -> list[str]:
    """A vocabulary file of a term a line, lower-cased; empty lines and comments go, an empty vocabulary is an error. A file of the configuration."""
    line = F.lower(F.trim(F.regexp_replace("value", r"\s*#.*$", "")))
    found = sorted(r[0] for r in spark.read.text(path).select(line.alias("t")).where("t <> ''").distinct().collect())
    if not found:
        raise ValueError(f"no terms in {path}")
    return found


def scan_counts(raw: DataFrame) -> DataFrame:
    """Per source: records, rejected ones, distinct accepted documents. ``raw`` as ``read_raw`` gives it."""
    return raw.groupBy("source").agg(F.count("*").alias("records"), F.count_if("rejected").alias("rejected"), F.countDistinct(F.when(~F.col("rejected"), F.col("source_native_id"))).alias("documents"))


def write_worksheet(df: DataFrame, path: str, meta: dict, *, order: str = "doc_id") -> None:
    """A sample of few rows as JSON lines in one file, after a line that says how it was drawn; verdict columns are written as nulls."""
    head = df.sparkSession.createDataFrame([(json.dumps({"_meta": meta}, sort_keys=True), 0, "")], "value string, __first int, __key string")
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"), F.lit(1).alias("__first"), F.col(order).cast("string").alias("__key"))
    head.unionByName(rows).coalesce(1).sortWithinPartitions("__first", "__key").select("value").write.mode("overwrite").text(path, lineSep="\n")
