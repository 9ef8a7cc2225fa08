"""The tables of a corpus as Parquet folders: layout, rules that rows must keep, replacing, read-only views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import checkpointed

# The tables with their columns, which of these are never null, the key, further unique columns, and references.
LAYOUT = {
    "documents": "doc_id string, source string, source_native_id string, url string, author_hash string, created_utc string, text string, lang string, char_len long, meta_json string, "
    "text_fingerprint string, is_duplicate_of string, word_count long, exclusion_reason string, relevance_score double, is_relevant boolean, ingested_at string",
    "doc_tags": "doc_id string, taxonomy_version string, prompt_version string, model string, tags_json string, tagged_at string",
    "llm_cache": "cache_key string, response_json string, prompt_tokens long, completion_tokens long, reasoning_tokens long, created_at string",
    "run_log": "run_id string, stage string, config_hash string, started_at string, finished_at string, records_in long, records_out long, notes string",
    "triage_cache": "doc_id string, model string, prompt_version string, is_relevant boolean, decided_at string",
}
KEYS = {"documents": ["doc_id"], "doc_tags": ["doc_id", "taxonomy_version", "prompt_version", "model"], "llm_cache": ["cache_key"], "run_log": [], "triage_cache": ["doc_id", "model", "prompt_version"]}
UNIQUE = {"documents": [["source", "source_native_id"]]}
REQUIRED = {"documents": ["doc_id", "source", "source_native_id", "text"], "doc_tags": ["doc_id", "taxonomy_version", "prompt_version", "model", "tags_json"], "llm_cache": ["cache_key", "response_json"], "triage_cache": ["doc_id", "model", "prompt_version", "is_relevant"]}
REFERENCES = {"documents": [("is_duplicate_of", "documents", "doc_id")], "doc_tags": [("doc_id", "documents", "doc_id")]}


def table_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def init_store(spark: SparkSession, folder: str, layout: dict[str, str] | None = None) -> None:
    """Creates each table that is not there as an empty one; those that are there stay as they are."""
    for name, columns in (layout or LAYOUT).items():
        if not table_exists(spark, f"{folder}/{name}"):
            spark.createDataFrame([], columns).write.parquet(f"{folder}/{name}")


def open_table(spark: SparkSession, folder: str, name: str, layout: dict[str, str] | None = None) -> DataFrame:
    """A read-only view of a table; one that is not there has no rows."""
    columns = (layout or LAYOUT)[name]
    path = f"{folder}/{name}"
    return spark.read.schema(columns).parquet(path) if table_exists(spark, path) else spark.createDataFrame([], columns)


def violations(df: DataFrame, name: str, parents: dict[str, DataFrame] | None = None, *, keys=None, unique=None, required=None, references=None) -> DataFrame:
    """(rule, n): the rules of a table that rows break, and how many rows, keys or references do; rules that hold have no row.

    Keys and unique columns are counted by group, references by an anti-join with the table they name in ``parents`` (null ones hold).
    """
    keys, unique = keys if keys is not None else KEYS.get(name, []), unique if unique is not None else UNIQUE.get(name, [])
    required, references = required if required is not None else REQUIRED.get(name, []), references if references is not None else REFERENCES.get(name, [])
    said = []
    if required:
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
        said.append(nulls.select(F.inline(F.array(*[F.struct(F.lit(f"{c} is null").alias("rule"), F.col(c).alias("n")) for c in required]))))
    for columns in [keys, *unique] if keys else unique:
        again = df.groupBy(*columns).agg(F.count("*").alias("rows")).where("rows > 1")
        said.append(again.agg(F.count("*").alias("n")).select(F.lit(f"{', '.join(columns)} repeats").alias("rule"), "n"))
    for column, parent, key in references:
        known = (parents or {}).get(parent, df if parent == name else None)
        if known is not None:
            lost = df.where(F.col(column).isNotNull()).select(F.col(column).alias("__k")).join(known.select(F.col(key).alias("__k")), "__k", "left_anti")
            said.append(lost.agg(F.count("*").alias("n")).select(F.lit(f"{column} is not in {parent}").alias("rule"), "n"))
    return reduce(DataFrame.unionByName, said).where("n > 0")


def replace_rows(df: DataFrame, folder: str, name: str) -> None:
    """A table's rows are replaced whole. The new ones are written aside first, so that they may come from the table itself."""
    checkpointed(df).write.mode("overwrite").parquet(f"{folder}/{name}")


def write_clustered(df: DataFrame, path: str, key: str, *, row_group_bytes: int = 16 << 20, mode: str = "overwrite") -> None:
    """``df`` in files sorted by ``key``, with row groups of bounded size and a Bloom filter of the key in each, so that a look-up of one key reads the row
    groups whose range and filter may hold it, and joins with few keys do so, too. Hashed keys fill every range: the filter is what skips."""
    sorted_ = df.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    writer = sorted_.write.mode(mode).option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(64 << 10))
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{key}", "true").parquet(path)


def rows_scanned(df: DataFrame) -> int:
    """Runs ``df`` and tells how many rows its file scans gave: those of row groups and pages that statistics and Bloom filters did not skip."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves() if not plan.nodeName().startswith("AdaptiveSparkPlan") else plan.executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numOutputRows"))


def cleared(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``columns`` null."""
    return df.select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) if c in columns else F.col(c) for c in df.columns])


def point(df: DataFrame, **where) -> DataFrame:
    """The rows of one key; the filter reaches the scan."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in where.items()]))


def tagged_already(tags: DataFrame, **version) -> tuple[bool, int]:
    """Whether a version has tags, and how many."""
    n = point(tags, **version).count()
    return n > 0, n


def save_sample(sample: DataFrame, folder: str, *, name: str = "tag_sample", force: bool = False) -> int:
    """Writes a drawn sample; one that is there is replaced only with ``force``. Returns its rows."""
    path = f"{folder}/{name}"
    if table_exists(sample.sparkSession, path) and not force:
        raise FileExistsError(f"{path} holds a sample already")
    sample.write.mode("overwrite").parquet(path)
    return sample.sparkSession.read.parquet(path).count()


def read_cues(spark: SparkSession, path: str) -> dict[str, dict[str, list[str]]]:
    """dimension -> label -> cues of a lexicon file (YAML of that shape: two levels of keys, cues as ``- items`` or ``[a, b]``); no file: no cues.
    A file of the configuration, a few lines."""
    if not table_exists(spark, path):
        return {}
    out: dict[str, dict[str, list[str]]] = {}
    dimension = label = ""
    bare = lambda x: x.strip().strip("\"'")
    for (line,) in spark.read.option("wholetext", True).text(path).select(F.explode(F.split("value", "\r?\n"))).collect():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        indent, text = len(body) - len(body.lstrip()), body.strip()
        if text.startswith("- "):
            out[dimension][label].append(bare(text[2:]))
        elif not indent:
            dimension = bare(text.split(":")[0])
            out[dimension] = {}
        else:
            label, _, rest = text.partition(":")
            label = bare(label)
            out[dimension][label] = [bare(x) for x in rest.strip().strip("[]").split(",") if bare(x)]
    return out


def read_segment_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The matrix file with its numbers as numbers; what is none is null."""
    raw = spark.read.option("header", True).csv(path)
    number = {"n_docs": "long", "lift": "double"}
    return raw.select(*[F.col(c).try_cast("double").cast(number[c]).alias(c) if c in number else F.col(c) for c in raw.columns])


def iso(ts: Column) -> Column:
    """A time as ISO text in UTC (the session's zone must be UTC); fractions where there are any."""
    t = ts.cast("timestamp")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.unix_micros(t) % 1_000_000 != 0, F.date_format(t, ".SSSSSS")).otherwise(""), F.lit("+00:00"))
