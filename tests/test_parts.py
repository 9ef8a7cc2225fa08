"""Raw parts: rollover, the cap, duplicates across tasks, separators, and manifests of runs that end and that fail."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.sources import parts

SCHEMA = "source string, source_native_id string, url string, author_raw string, created_utc timestamp, text string, meta string, collected_at timestamp, collector_version string"


def records(spark, rows):
    at = dt.datetime(2024, 1, 5)
    return spark.createDataFrame([(s, i, None, None, at + dt.timedelta(days=-n), t, None, at + dt.timedelta(minutes=n), "1") for n, (s, i, t) in enumerate(rows)], SCHEMA).repartition(3)


def test_parts_roll_over_and_copies_go(spark, tmp_path):
    folder = f"file://{tmp_path}/raw"
    odd = "a b c\x85d\re\nf \"\\ é 🙂"
    rows = [("a", str(i % 20), f"text {i}") for i in range(30)] + [("b", "1", odd), ("b", None, "no id")]
    run = parts.write_parts(records(spark, rows), folder, max_part_records=2)
    got = {(r.source, r.source_native_id): r for r in parts.read_parts(spark, folder, SCHEMA).collect()}
    assert len(got) == 21 and got[("b", "1")].text == odd and got[("a", "3")].text == "text 3" and got[("a", "3")].collected_at == dt.datetime(2024, 1, 5, 0, 3)
    told = {r.source: r for r in parts.read_manifests(spark, folder).collect()}
    assert (told["a"].record_count, told["a"].duplicates_skipped, told["a"].status, told["a"].run_id) == (20, 10, "complete", run)
    assert len(told["a"].parts) >= 10 and told["a"].latest_created_utc == dt.datetime(2024, 1, 5)
    lines = [n for p in told["a"].parts for n in [len((tmp_path / "raw" / p).read_bytes().splitlines())]]
    assert max(lines) <= 2 and sum(lines) == 20
    parts.write_parts(records(spark, [("a", "3", "again")]), folder)
    assert parts.read_parts(spark, folder, SCHEMA).where("source_native_id = '3'").count() == 2


def test_the_cap_keeps_the_earliest(spark, tmp_path):
    folder = f"file://{tmp_path}/raw"
    parts.write_parts(records(spark, [("a", str(i % 9), "x") for i in range(40)] + [("b", "1", "y")]), folder, max_records=5)
    assert sorted((r.source, r.source_native_id) for r in parts.read_parts(spark, folder, SCHEMA).collect()) == [*[("a", str(i)) for i in range(5)], ("b", "1")]


def test_a_failed_run_has_a_manifest(spark, tmp_path):
    folder = f"file://{tmp_path}/raw"

    def fail(batches):
        for b in batches:
            if "bad" in b.column("text").to_pylist():
                raise ValueError("lost")
            yield b

    rows = records(spark, [("a", str(i), "bad" if i == 7 else "fine") for i in range(40)])
    spark.dataSource.register(parts.RawParts)
    with pytest.raises(PySparkException):
        rows.repartition(4, "source_native_id").mapInArrow(fail, SCHEMA).write.format("rawparts").option("run_id", "r1").mode("append").save(folder)
    told = parts.read_manifests(spark, folder).collect()
    assert {r.status for r in told} == {"failed"} and sum(r.record_count for r in told) < 40
    assert parts.read_parts(spark, folder, SCHEMA, status="complete").count() == 0
    parts.write_parts(rows.where(F.col("text") == "fine"), folder)
    assert parts.read_parts(spark, folder, SCHEMA, status="complete").count() == 39
