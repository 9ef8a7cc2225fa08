"""Raw parts as a data source: JSON lines by source and day, parts that roll over, a manifest of every run, also of one that failed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from corpusloom.operators import ordered

MANIFEST = "run_id string, source string, run_date date, status string, record_count long, duplicates_skipped long, parts array<string>, earliest_created_utc timestamp, latest_created_utc timestamp, finished_at timestamp"
# Line separators that JSON leaves as they are and line readers take for ends of lines.
SEPARATORS = {" ": "\\u2028", " ": "\\u2029", "\x85": "\\u0085"}


def one_line(row: dict) -> str:
    """A record as JSON without any line separator."""
    plain = {k: v.isoformat() if isinstance(v, (datetime, date)) else v for k, v in row.items()}
    text = json.dumps(plain, ensure_ascii=False)
    for char, escaped in SEPARATORS.items():
        text = text.replace(char, escaped)
    return text


@dataclass
class Written:
    """What a task wrote of one source and day."""

    parts: list[str] = field(default_factory=list)
    records: int = 0
    duplicates: int = 0
    earliest: str | None = None
    latest: str | None = None

    def add(self, x: Written) -> None:
        self.parts += x.parts
        self.records += x.records
        self.duplicates += x.duplicates
        self.earliest = min(filter(None, (self.earliest, x.earliest)), default=None)
        self.latest = max(filter(None, (self.latest, x.latest)), default=None)


@dataclass
class Message(WriterCommitMessage):
    groups: dict[tuple[str, str], Written]


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, run: str, most: int):
        self.folder, self.run, self.most = folder, run, most

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Message:
        """Rows come sorted by source, day and id: of equal ids the first stays. A part is closed after ``most`` records."""
        where, root = fs.FileSystem.from_uri(self.folder)
        context = TaskContext.get()
        attempt = f"{context.partitionId():05d}-{context.taskAttemptId()}"
        groups: dict[tuple[str, str], Written] = {}
        now, out, last, held = None, None, None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    day = row["collected_at"].date().isoformat()
                    key = (row["source"], day)
                    got = groups.setdefault(key, Written())
                    if (key, row["source_native_id"]) == (now, last):
                        got.duplicates += 1
                        continue
                    if out is None or key != now or held == self.most:
                        if out is not None:
                            out.close()
                        name = f"{row['source']}/{day}/part-{self.run}-{attempt}-{len(got.parts):03d}.jsonl"
                        where.create_dir(f"{root}/{row['source']}/{day}", recursive=True)
                        out, held = where.open_output_stream(f"{root}/{name}"), 0
                        got.parts.append(name)
                    now, last = key, row["source_native_id"]
                    out.write((one_line(row) + "\n").encode("utf-8", "surrogatepass"))
                    held, got.records = held + 1, got.records + 1
                    if row["created_utc"] is not None:
                        at = row["created_utc"].isoformat()
                        got.earliest, got.latest = min(got.earliest or at, at), max(got.latest or at, at)
        finally:
            if out is not None:
                out.close()
        return Message(groups)

    def _manifest(self, messages: list[Message | None], status: str) -> None:
        """A line per source and day; of a run that wrote nothing, one line without a source."""
        total: dict[tuple[str | None, str | None], Written] = {}
        for message in messages:
            for key, got in (message.groups if message else {}).items():
                total.setdefault(key, Written()).add(got)
        where, root = fs.FileSystem.from_uri(self.folder)
        where.create_dir(f"{root}/_manifests", recursive=True)
        done = datetime.now(timezone.utc).isoformat()
        with where.open_output_stream(f"{root}/_manifests/{self.run}.json") as out:
            for (source, day), got in sorted(total.items() or [((None, None), Written())]):
                row = {"run_id": self.run, "source": source, "run_date": day, "status": status, "record_count": got.records, "duplicates_skipped": got.duplicates, "parts": sorted(got.parts), "earliest_created_utc": got.earliest, "latest_created_utc": got.latest, "finished_at": done}
                out.write((json.dumps(row) + "\n").encode())

    def commit(self, messages: list[Message | None]) -> None:
        self._manifest(messages, "complete")

    def abort(self, messages: list[Message | None]) -> None:
        self._manifest(messages, "failed")


class RawParts(DataSource):
    """``df.write.format("rawparts").option("run_id", ...).option("max_part_records", ...).mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "rawparts"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options["run_id"], int(self.options.get("max_part_records", 100_000)))


def write_parts(records: DataFrame, folder: str, *, max_records: int | None = None, max_part_records: int = 100_000) -> str:
    """Appends records to ``folder`` (a URI that ``pyarrow.fs`` knows) by source and day; gives the id of the run, whose manifest says what came of it.

    Of records of one source, day and native id the earliest collected stays (ties: by text), also across tasks. Of a source at most ``max_records`` of
    these are written, the earliest collected. Every attempt of a task names its own parts, and the manifest lists those of tasks that ended; a
    failed run has a manifest too, with what its ended tasks wrote. Records without a source, an id or a time of collection are left out.
    """
    spark = records.sparkSession
    spark.dataSource.register(RawParts)
    run = uuid.uuid4().hex
    rows = records.where("source is not null and source_native_id is not null and collected_at is not null")
    if max_records is not None:
        first = rows.groupBy("source", F.to_date("collected_at").alias("__day"), "source_native_id").agg(F.min("collected_at").alias("__at"))
        kept = ordered.with_place(first, by=["source"], order=["__at", "source_native_id", "__day"], out="__i").where(F.col("__i") < max_records)
        rows = rows.withColumn("__day", F.to_date("collected_at")).join(kept.select("source", "__day", "source_native_id"), ["source", "__day", "source_native_id"], "left_semi").select(*records.columns)
    day = F.to_date("collected_at")
    # By id, so that a large source is written by many tasks and the copies of a record meet.
    placed = rows.repartition("source", day, "source_native_id").sortWithinPartitions("source", day, "source_native_id", "collected_at", "text")
    placed.write.format("rawparts").option("run_id", run).option("max_part_records", str(max_part_records)).mode("append").save(folder)
    return run


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{folder}/_manifests")


def read_parts(spark: SparkSession, folder: str, schema: str, *, status: str | None = None) -> DataFrame:
    """Records of the parts that manifests list, of runs with ``status`` if one is given."""
    listed = read_manifests(spark, folder)
    if status is not None:
        listed = listed.where(F.col("status") == status)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    rows = spark.read.schema(schema).option("lineSep", "\n").json(f"{folder}/*/*/part-*.jsonl").withColumn("__file", name)
    parts = listed.select(F.explode("parts").alias("p")).select(F.regexp_extract("p", r"([^/]+)$", 1).alias("__file"))
    return rows.join(parts, "__file", "left_semi").drop("__file")
