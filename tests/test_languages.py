"""Languages: held-out agreement, odd texts, the rule that uses them."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import languages
from corpusloom.functions import text as T

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    if not os.path.isdir(DIR):
        pytest.skip("the driver's tables are not here")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    return languages.fit(docs.join(spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id"), "doc_id", "left_semi"))


def test_held_out_agreement(spark, model):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where(T.word_count(F.col("text")) >= 8)
    held = docs.join(spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id"), "doc_id", "left_anti")
    n, same = held.select(F.count("*"), F.count_if(languages.language(F.col("text"), model) == F.col("lang"))).first()
    assert n > 300 and same / n >= 0.97


def test_posteriors_by_hand(spark):
    rows = spark.createDataFrame([("ab ab!", "x"), ("Cd", "y"), (None, "y"), ("zz", None)], "text string, lang string")
    model = languages.fit(rows)
    assert model.langs == ["x", "y"]

    def bucket(g):
        h = len(g)
        for c in g:
            h = h * 31 + ord(c)
        return h % languages.BUCKETS

    grams = lambda t: [bucket(t[i : i + n]) for n in languages.ORDERS for i in range(len(t) - n + 1)]
    own = {"x": grams("ab ab "), "y": grams("cd")}
    for k, name in enumerate(model.langs):
        for b in {*own["x"], *own["y"]}:
            assert np.isclose(model.weights[b, k], np.log((own[name].count(b) + 1) / (len(own[name]) + languages.BUCKETS)))
    p = model.posteriors(["ab", "", None, "é" * 3])
    s = [sum(model.weights[b, k] for b in grams("ab")) / 4 for k in (0, 1)]
    assert np.allclose(p[0], np.exp(s) / np.exp(s).sum()) and np.allclose(p[1:3], 0.5)


def test_odd_texts(spark, model):
    texts = ["", None, "12345 !!", "\n\t", "ñ", "word " * 50_000, "🙂🙂"]
    got = [r.g for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(languages.identify(F.col("t"), model).alias("g")).collect()]
    assert [g is None for g in got] == [True, True, True, True, False, False, True]
    empty = languages.fit(spark.createDataFrame([], "text string, lang string"))
    assert spark.range(1).select(languages.language(F.lit("a text"), empty).alias("l")).first().l is None


def test_short_and_unsure_texts_stay(spark, model):
    said = " ".join(r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").where("lang = 'es'").orderBy("doc_id").limit(3).collect()).split()
    rows = spark.createDataFrame([(1, " ".join(said[:40])), (2, " ".join(said[:7])), (3, "xq zv kj ww pt qx vk jz"), (4, "यह कपड़ा बहुत अच्छा है"), (5, "a b")], "i int, t string")
    reason = T.exclusion_reason(F.col("t"), languages.language(F.col("t"), model, confidence=0.9), languages=("es",))
    got = {r.i: r.r for r in rows.select("i", reason.alias("r")).collect()}
    assert got[1] == "hindi_language" and got[2] is None and got[4] == "hindi_language" and got[5] == "too_short"
