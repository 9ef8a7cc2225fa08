"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._base import bounded_batches, drop_path, hot_split, nested, scratch, text_or_empty, unnested, written

_RUN = "h binary, n long, last long"
_NO_ID = -(1 << 63)  # stands for a null doc_id: never the largest where another document holds the line


def _keys(text: str, least: int) -> list[bytes | None]:
    """The 128-bit hash of each line's key; None for keys shorter than ``least`` code points."""
    out: list[bytes | None] = []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(b" \t\n\x0b\x0c\r").lower()  # bytes.lower changes A-Z alone
        short = len(key) < least or (not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < least)
        out.append(None if short else xxhash.xxh3_128_digest(key))
    return out


def _stage(least: int):
    def run(batches):
        for b in batches:
            ids, ths, hs = [], [], []
            for doc, th, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                new = set(_keys(text, least)) - {None}
                ids += [doc] * len(new)
                ths += [th] * len(new)
                hs += new
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(hs, pa.binary())], ["doc", "th", "h"])

    return run


def _apply(least: int):
    def run(batches):
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drops in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines = text.count("\n") + 1
                gone = 0
                if drops:
                    drops = set(drops)
                    kept = [line for line, key in zip(text.split("\n"), _keys(text, least), strict=True) if key not in drops]
                    gone = lines - len(kept)
                    text = "\n".join(kept)
                texts.append(text)
                n_lines.append(lines)
                n_dropped.append(gone)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["row", "text", "n_lines", "n_dropped"])

    return run


class LineRuns:
    """Levelled sorted runs in the shared folder: a run has (h, n, last), a row per line that no earlier run holds: the documents of its batch
    that hold the line, and the largest of them.

    A batch is counted by line and merge-anti-joined with the runs: lines that none holds become a run of level 0, the others add to the
    repeats, a separate table. When a level has ``fanout`` runs they are merged into one run of the next level, so an entry is rewritten
    log(batches) times. Runs, batches and repeats are bucketed by line hash and sorted within buckets: a batch is shuffled once, when it is
    counted, and every join and merge after that is of sorted buckets, without a shuffle. Files are immutable; a lost executor costs the task, not the index.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.repeats: list[str] = []
        self.paths: dict[str, str] = {}

        # A scan of a sorted bucket then counts as sorted, so that joins merge without sorting again.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def _write(self, rows: DataFrame, placed: bool = True) -> str:
        """A bucketed, sorted table in the shared folder; its name in the session's catalogue. ``placed``: rows come bucket by bucket already."""
        name = f"line_run_{uuid.uuid4().hex}"
        rows = rows if placed else rows.repartition(self.buckets, "h")
        self.paths[name] = scratch(self.spark, "line-run")
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", self.paths[name]).saveAsTable(name)
        return name

    def _files(self, names: list[str]) -> DataFrame:
        """Tables as plain files, which a plan may group anew: a union of bucketed scans says more of its partitions than it keeps."""
        return self.spark.read.schema(_RUN).parquet(*[self.paths[n] for n in names])

    def _missing(self, rows: DataFrame, run: str) -> DataFrame:
        return rows.join(self.spark.table(run).select("h").hint("merge"), "h", "left_anti")

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The merge-anti-join: the rows whose line no run holds."""
        return reduce(self._missing, [run for level in self.levels for run in level], rows)

    def entries(self) -> DataFrame:
        """(h, n, last) of every line over all batches."""
        names = [run for level in self.levels for run in level]
        if not names:
            return self.spark.createDataFrame([], _RUN)
        if not self.repeats:
            return self._files(names)
        again = self._write(self._files(self.repeats).groupBy("h").agg(F.sum("n").alias("n"), F.max("last").alias("last")), placed=False)
        self.forget(self.repeats)
        self.repeats = [again]
        more = self.spark.table(again).select("h", F.col("n").alias("more"), F.col("last").alias("later")).hint("merge")
        said = lambda run: self.spark.table(run).join(more, "h", "left").select("h", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("last", "later").alias("last"))
        return reduce(DataFrame.unionByName, map(said, names))

    def add(self, keys: DataFrame) -> None:
        """``keys``: (doc, h), a row per document and distinct line."""
        new, level = self._write(keys.groupBy("h").agg(F.count("*").alias("n"), F.max("doc").alias("last")), placed=False), 0
        if self.levels:
            batch, new = new, self._write(self.unseen(self.spark.table(new)))
            self.repeats.append(self._write(self._missing(self.spark.table(batch), new)))
            self.forget([batch])
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            old, self.levels[level] = self.levels[level], []
            new = self._write(reduce(self._merged, map(self.spark.table, old)))
            self.forget(old)
            level += 1

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs, which have no line in common, as one in order."""
        b = b.select("h", F.col("n").alias("other_n"), F.col("last").alias("other_last")).hint("merge")
        return a.join(b, "h", "full").select("h", F.coalesce("n", "other_n").alias("n"), F.coalesce("last", "other_last").alias("last"))

    def forget(self, tables: list[str]) -> None:
        """Drops tables with their files."""
        for name in tables:
            self.spark.sql(f"DROP TABLE {name}")
            drop_path(self.spark, self.paths.pop(name))


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, th, h): a row per row of ``docs`` and distinct key of at least ``min_chars`` code points; th is the hash of the text."""
    bounded_batches(docs.sparkSession)
    text = text_or_empty()
    return docs.select(_doc().alias("doc"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(_stage(min_chars), "doc long, th long, h binary")


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))


def dedup_lines(docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drops the lines of ``docs`` that at least ``min_docs`` documents hold, except in the largest doc_id that holds them.

    A key is a line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z lower-cased; keys under ``min_chars`` code points never count. The
    keys are staged once, dealt into ``batches`` by document and added to ``LineRuns`` batch by batch; what the runs then say of a line decides.
    Returns the columns of ``docs`` with the remaining text, ``n_lines`` (before) and ``n_dropped``, which replace columns of those names.

    Null or empty texts have one empty line and stay. Rows that repeat a doc_id are one document, whose every row keeps the lines that it holds
    as the largest; rows without doc_id are one document together, below every other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = scratch(spark, "line-keys")
    line_keys(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches))).write.partitionBy("batch").parquet(path)
    staged = spark.read.schema("doc long, th long, h binary, batch long").parquet(path)
    runs = LineRuns(spark, fanout)
    for i in range(batches):
        runs.add(staged.where(F.col("batch") == i).select("doc", "h").distinct())
    repeated = written(runs.entries().where(F.col("n") >= min_docs), "repeated-lines")
    runs.forget([run for level in runs.levels for run in level] + runs.repeats)
    hot, rest, cold = hot_split(staged.select("doc", "th", "h"), repeated, ["h"], staged.count())
    drops = hot.unionByName(rest.join(cold, "h")).where("doc <> last").groupBy("doc", "th").agg(F.collect_set("h").alias("drops"))

    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = text_or_empty()
    body = docs.select(nested(docs.drop("text", "n_lines", "n_dropped")), _doc().alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    joined = body.join(drops, ["doc", "th"], "left").select("row", "text", "drops")
    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    done = joined.mapInArrow(_apply(min_chars), schema)
    return done.select(*[F.col("text") if c == "text" else unnested([c])[0] for c in names], "n_lines", "n_dropped")
