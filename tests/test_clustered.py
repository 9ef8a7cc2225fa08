"""Clustered tables: a look-up reads few of the rows, found or not; nothing is lost."""

from pyspark.sql import functions as F

from corpusloom.sources import store


def test_lookups_skip_row_groups(spark, tmp_path):
    rows = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("doc_id"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("text"), F.col("id").alias("n"))
    path = f"{tmp_path}/t"
    store.write_clustered(rows, path, "doc_id", row_group_bytes=256 << 10)
    table = spark.read.parquet(path)
    assert table.count() == 40_000 and table.agg(F.sum("n")).first()[0] == sum(range(40_000))
    key = rows.where("n = 777").first().doc_id
    assert [r.n for r in store.point(table, doc_id=key).collect()] == [777]
    assert 0 < store.rows_scanned(store.point(table, doc_id=key)) < 10_000
    assert store.rows_scanned(store.point(table, doc_id="0" * 63 + "x")) < 10_000
    assert store.rows_scanned(table) == 40_000


def test_bloom_filters_skip_what_ranges_do_not(spark, tmp_path):
    """Every file holds ids of the whole range, so statistics say nothing."""
    path = f"{tmp_path}/t"
    for part in range(4):
        rows = spark.range(5000).select(F.sha2(F.concat_ws(":", F.lit(part), F.col("id").cast("string")), 256).alias("doc_id"), F.lit(part).alias("part"))
        store.write_clustered(rows.coalesce(1), path, "doc_id", mode="append")
    table = spark.read.parquet(path)
    key = table.where("part = 2").first().doc_id
    assert store.point(table, doc_id=key).first().part == 2
    assert store.rows_scanned(store.point(table, doc_id=key)) < store.rows_scanned(table) / 2
