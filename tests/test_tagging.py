"""Parsing of tag blobs, hand-collected sources, guards."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.operators import tagging
from corpusloom.sources import manual


def test_tags(spark):
    good = {"doc_id": "a", "blocker_type": ["fit", "price", "fit"], "severity": 3, "confidence_pct": 90, "evidence": [{"tag": "fit", "quote": "too small"}, {"tag": "price", "quote": " "}]}
    rows = spark.createDataFrame([(json.dumps(good),), ("[1]",), ("{bad",), (json.dumps(good | {"severity": 9}),), (None,)], "raw string")
    got = [r["t"] for r in rows.select(tagging.evidenced(tagging.parse_tags(F.col("raw"))).alias("t")).collect()]
    assert got[0]["blocker_type"] == ["fit"] and got[1] is None and got[3] is None and got[4] is None
    response = spark.createDataFrame([(json.dumps({"documents": [good, {"x": 1}]}),), ("nonsense",)], "response string")
    assert [(r.doc_id, r.blocker_type) for r in tagging.parse_response(response).collect()] == [("a", ["fit"])]


def test_steps_inside_one_another_stay_short(spark):
    """The plan grows by steps, not by their product, and the blob is parsed once a step."""
    out = F.col("raw")
    for _ in range(4):
        out = tagging.tags_blob(tagging.evidenced(tagging.parse_tags(out)))
    df = spark.createDataFrame([(json.dumps({"blocker_type": ["fit"], "severity": 2, "evidence": [{"tag": "fit", "quote": "x"}]}),)], "raw string").select(out.alias("b"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 4 and len(plan) < 60_000
    assert json.loads(df.first().b)["blocker_type"] == ["fit"]


def test_mixed_versions_are_refused(spark):
    one = spark.createDataFrame([(1, "t", "p", "m"), (2, "t", "p", "m")], "doc_id long, taxonomy_version string, prompt_version string, model string")
    assert tagging.one_version(one).count() == 2
    with pytest.raises(PySparkException, match="mixed tag versions"):
        tagging.one_version(one.withColumn("model", F.concat("model", F.col("doc_id").cast("string")))).collect()


def test_verdicts(spark):
    docs = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    cache = spark.createDataFrame([(0, False), (1, True)], "doc_id long, is_relevant boolean")
    got = {r.doc_id: (r.is_relevant, r.state) for r in tagging.verdicts(docs, cache, batch=10, tokens_per_doc=1, budget=20).collect()}
    states = [s for _, s in got.values()]
    assert got[0] == (False, "cached") and states.count("asked") == 20 and states.count("beyond budget") == 8


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é one".encode("utf-16"))
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbfproduct: 123456\n[reviews]\n4/5 Fits well.\nby A. Name, 3 March 2024\n\n[qa]\nIs it long?\nYes.")
    (tmp_path / "README.txt").write_text("no")
    (tmp_path / "_x.txt").write_text("no")
    files = {r.file.rsplit("/", 1)[-1]: r.text for r in manual.read_files(spark, str(tmp_path)).collect()}
    assert set(files) == {"a.txt", "b.txt"} and files["a.txt"] == "é one"
    blocks = manual.directive_blocks(manual.read_files(spark, str(tmp_path)))
    got = {r.kind: r for r in blocks.withColumn("r", manual.review_block(F.col("body"))).collect()}
    assert tuple(got["review"].r) == (4, "Fits well.", "A. Name", "3 March 2024") and got["qa"].body == "Is it long?\nYes." and got["qa"]["product"] == "123456"


def test_threads_and_embedded(spark):
    text = "Menu\n\nWhy is it so small?\n\n" + "An answer that is long enough to be kept as one. " + "\n\nshort"
    got = manual.split_thread(spark.createDataFrame([("f", text)], "file string, text string")).collect()
    assert len(got) == 1 and got[0].question == "Why is it so small?"
    html = '<script type="application/ld+json">{"review": [{"reviewBody": "ok", "reviewRating": {"ratingValue": "4"}}]}</script>'
    df = spark.createDataFrame([(html, '{"data": {"reviews": [{"id": "7"}]}}')], "html string, payload string")
    row = df.select(manual.json_ld_reviews(F.col("html")).alias("r"), manual.first_list(F.col("payload"), ["items", "reviews"], "struct<id:string>").alias("l")).first()
    assert row.r[0]["reviewBody"] == "ok" and row.l[0]["id"] == "7"
