"""Listings, funnel, quantification over clusters, repairs of tagging, report parts."""

import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus, evaluation, evidence, quantify, reports, tagging
from corpusloom.sources import listings, tables

PAGE = """<html><body><script>var x = "<div class='item'>";</script>
<div class="item big" id="c1234567"><h3><a href="/r/good-phone-999999">Good phone</a></h3><p class="body">It works &amp; lasts.<br>Really.</p><span class="who">Ann</span><time datetime="2024-03-05">x</time><b class="stars">4/5</b></div>
<div class="item"><a href="/r/bad-phone-7654321?x=1">Bad</a><p class="body">It broke</p></div>
<div class="item"><a href="#comment-55555">c</a><p class="body">Third</p></div>
<div class="item"><p class="body">No id here</p></div><div class="item"><p>no body class</p></div></body></html>"""


def test_html_blocks(spark):
    pages = spark.createDataFrame([("http://a.org/list#top", PAGE), ("http://b.org/", None), ("http://c.org/", "<p>none")], "url string, html string")
    fields = {"body": ["div.text", "p.body"], "title": ["h3 a"], "author": [".who"], "rating": ["b.stars"]}
    got = listings.html_blocks(pages, ["article", "div.item"], fields).collect()
    assert [(r.native_id, r.url, r.author, r.created, r.rating) for r in got[:3]] == [
        ("1234567", "http://a.org/list#c1234567", "Ann", "2024-03-05", 4.0),
        ("7654321", "http://a.org/r/bad-phone-7654321?x=1", None, None, None),
        ("55555", "http://a.org/list#c55555", None, None, None),
    ]
    assert got[0].text == "Good phone\n\nIt works & lasts. Really." and len(got) == 4 and len(got[3].native_id) == 16


def test_payloads(spark):
    data = {"props": {"pageProps": {"reviews": [{"id": "7", "title": "T", "text": "body", "rating": 4, "consumer": {"displayName": "A"}}, {"id": "8", "text": ""}]}}}
    page = spark.createDataFrame([("u", f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script>'), ("v", "<p>"), ("w", None)], "url string, html string")
    assert [(r.native_id, r.text, r.author, r.rating) for r in listings.page_data_reviews(page).collect()] == [("7", "T\n\nbody", "A", 4.0)]
    posts = spark.createDataFrame([("p", "Title", "[deleted]", "a", 1, [("c1", "hello", "b", 2, "p"), ("c2", "[removed]", None, 3, "p"), ("c3", None, None, 3, "p")]), ("q", "", "", "a", 1, [])], "id string, title string, body string, author string, created long, comments array<struct<id:string,body:string,author:string,created:long,parent_id:string>>")
    assert [(r.native_id, r.text, r.parent_id) for r in listings.posts_with_comments(posts).collect()] == [("p", "Title", None), ("c1", "hello", "p")]
    pay = spark.createDataFrame([(json.dumps({"data": {"items": [{"id": 1, "text": "", "comment": "fine", "stars": "5"}, {"id": 2}]}}),), ("[bad",), (None,)], "payload string")
    assert [(r.native_id, r.text, r.rating) for r in listings.api_reviews(pay).collect()] == [("1", "fine", 5.0)]
    qa = spark.createDataFrame([(json.dumps({"questions": [{"id": 3, "question": "Long?", "answers": [{"text": "Yes"}, {"answer": "No"}]}]}),)], "payload string")
    assert [(r.native_id, r.text, r.answers) for r in listings.api_questions(qa).collect()] == [("3", "Long?", ["Yes", "No"])]
    found = spark.createDataFrame([(json.dumps({"items": [{"id": {"videoId": "v"}, "snippet": {"title": "t"}}, {"id": {"channelId": "c"}}]}),)], "payload string")
    assert [r.video_id for r in listings.search_results(found).collect()] == ["v"]
    hits = spark.createDataFrame([("v", 2, "b"), ("v", 1, "a")], "video_id string, term_pos int, term string")
    assert [(r.video_id, r.term) for r in listings.first_term(hits).collect()] == [("v", "a")]
    apps = spark.createDataFrame([("1", "ok", "u", "d", 5, "com.Shop.app"), (None, "x", "u", "d", 1, "z")], "review_id string, content string, user string, at string, score int, app_id string")
    assert [(r.native_id, r.own_brand) for r in listings.app_reviews(apps, brand="shop").collect()] == [("1", True)]


def test_small_parsers(spark):
    x = F.col("x")
    at = lambda v, f: spark.createDataFrame([(v,)], "x string").select(f(x).alias("y")).first()["y"]
    assert tuple(at("Q: Is it long?\nA: Yes\n\nA: Very", listings.question_block)) == ("Is it long?", ["Yes", "Very"])
    assert at("no question\nno", listings.question_block) is None
    assert at("https://a.org/x/Good%20Shirt.html?y=1#z", listings.slug) == "good-20shirt-html" and at("https://a.org/", listings.slug) == "a-org"
    assert at('{"text": " ", "body": "b"}', listings.first_text) == "b" and at("no", listings.first_text) is None
    assert at("../b", listings.absolute_url("http://a.org/x/y")) == "http://a.org/b" and at(None, listings.absolute_url("http://a.org")) is None
    cut, was = T.fit_document(F.lit("d1"), x, 6)
    assert at("word " * 10, lambda c: cut) == "word word word" and at("word " * 10, lambda c: was) and not at("word", lambda c: was)


def test_appendix_round_trip(spark):
    quotes = spark.createDataFrame([("t1", 1, "s", "d1", "http://a", "one: two"), ("t2", 1, "s", "d2", None, "three")], "theme string, place int, source string, doc_id string, url string, quote string")
    made = {r.theme: r.line for r in evidence.appendix_lines(quotes).collect()}
    lines = ["# Appendix", "- lost", "## t1", made["t1"], "## t2", made["t2"], "- plain", "# Pipeline run log", "- after"]
    got = listings.read_appendix(spark.createDataFrame(list(enumerate(lines)), "pos int, line string")).orderBy("pos").collect()
    assert [tuple(r)[1:] for r in got] == [("t1", "s", "d1", "http://a", "one: two"), ("t2", "s", "d2", None, "three"), ("t2", None, None, None, "plain")]


def test_stages_and_strata(spark):
    rows = spark.createDataFrame([("reddit", None), ("onsite", "qa"), ("onsite", "review"), ("play_store", "x")], "s string, c string")
    stage = corpus.purchase_stage(F.col("s"), F.col("c"))
    assert [r[0] for r in rows.select(stage).collect()] == ["pre_purchase", "pre_purchase", "post_purchase", "mixed"]
    for bad in (("new", None), ("onsite", None), (None, None)):
        with pytest.raises(PySparkException, match="no purchase stage"):
            spark.createDataFrame([bad], "s string, c string").select(stage).collect()
    raw = spark.createDataFrame([("s", "1", None, " ", dt.datetime(2024, 1, 1), "two words", '{"lang": "en"}'), ("s", "2", None, "h", None, "x", "bad")], "source string, source_native_id string, url string, author_raw string, created_utc timestamp, text string, meta string")
    got = corpus.normalize(raw, salt="z").orderBy("source_native_id").collect()
    assert [(r.lang, r.char_len, r.word_count) for r in got] == [("en", 9, 2), (None, 1, 1)] and got[0].author_hash != got[1].author_hash


def test_funnel(spark):
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(1, "hi", "en"), (2, long + " phone", "en"), (3, long + " phone", "en"), (4, long + " phone.", "en"), (5, "nothing at all here", "en"), (6, "a phone that works well", "en"), (7, "", "en")]
    built = corpus.build(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")), ["phone"])
    got = {r.doc_id: (r.exclusion_reason, r.is_duplicate_of, r.relevance_score, r.is_relevant) for r in built.collect()}
    assert got[1] == ("too_short", None, None, False) and got[7] == got[1]
    assert got[3] == (None, 2, None, None) and got[4] == (None, 2, None, None)
    assert got[5] == (None, None, 0.0, False) and got[2][3] is True and got[6] == (None, None, 0.2, True)
    assert tuple(corpus.profile(built).first())[1:] == (7, 2, 2, 3, 1, 2)


def test_duplicates_of_text_ids(spark):
    prints = spark.createDataFrame([("a", 7), ("b", 7), ("c", 6), ("d", -1)], "doc_id string, fingerprint long")
    docs = spark.createDataFrame([(x, 30) for x in "abcd"], "doc_id string, words int")
    assert {r.doc_id: r.is_duplicate_of for r in corpus.mark_duplicates(docs, prints).collect()} == {"a": None, "b": "a", "c": "a", "d": None}


def test_cluster_rows(spark):
    found = spark.createDataFrame([("b", "x", "b=x"), ("u", "y", "b=x"), ("b", "z", "b=z")], "dimension string, label string, cluster string")
    members = spark.createDataFrame([(1, "b", "x"), (1, "u", "y"), (2, "u", "y"), (3, "b", "z")], "doc_id long, dimension string, label string")
    assert sorted(map(tuple, quantify.cluster_members(members, found).collect())) == [(1, "b", "x"), (2, "b", "x"), (3, "b", "z")]
    docs = spark.createDataFrame([(i, i, "s", dt.datetime(2024, 1, i), 3, 1, 80, i < 3, "mixed") for i in (1, 2, 3)], "doc_id long, author long, source string, created timestamp, severity int, actionability int, confidence int, genuine boolean, stage string")
    flags = members.withColumn("is_flagged", (F.col("doc_id") == 1) & (F.col("label") == "x"))
    got = {r.label: r for r in quantify.quantify(docs, members, found, flags=flags).collect()}
    assert got["x"].n_docs == 2 and got["x"].flagged_share == 0.5 and got["x"].cluster_text == "b=x; u=y" and got["x"].genuine_n == 2 and got["z"].genuine_n == 0 and got["z"].post_only
    rows = spark.createDataFrame([("b", "x", 0.2, 0.2, True, False), ("u", "y", 0.0, None, None, None)], "dimension string, label string, prevalence_p double, prevalence_q double, reportable boolean, post_only boolean")
    assert [r.top_source for r in quantify.top_source(rows, ["p", "q"]).orderBy("label").collect()] == ["p", None]
    assert quantify.filter_scores(rows, reportable_only=True, sources=["q"]).count() == 1 and quantify.filter_scores(rows, dimensions=["u"], hide_post_only=True).count() == 1 and quantify.filter_scores(rows, sources=["none"]).count() == 0
    assert tuple(quantify.typed_cells(rows.where("label = 'x'"), rates=["prevalence_p"], scores=["prevalence_q"]).first()) == ("b", "x", "0.200000", "0.20", "true", "false")


def test_repairs():
    calls = []

    def call(docs, error):
        calls.append((len(docs), error))
        if sum(len(t) for _, t in docs) > 20:
            raise tagging.TooLarge
        if any(t == "bad" for _, t in docs):
            raise tagging.Rejected("no json")
        return [(i, [t]) for i, t in docs]

    tag = tagging.repairing(call, repairs=3)
    got = dict(tag([(1, "ok"), (2, "bad"), (3, "x" * 15), (4, "long " * 20)]))
    assert got[1] == ["ok"] and 2 not in got and got[3] == ["x" * 15] and len(got[4][0]) <= 20
    assert (1, "no json") in calls and len(calls) < 30

    def refused(docs, error):
        raise tagging.SchemaRefused

    with pytest.raises(tagging.SchemaRefused):
        list(tagging.repairing(refused)([(1, "a")]))


def violations(spark, *schemas):
    df = spark.createDataFrame([(i, x if isinstance(x, str) or x is None else json.dumps(x)) for i, x in enumerate(schemas)], "schema_id int, schema string")
    return sorted((r.schema_id, r.path, r.problem, r.name) for r in tagging.schema_violations(df).collect())


def test_strict_schemas(spark):
    """Each rule by itself, in nested places; the tagging schema keeps them all."""
    own = tagging.response_schema({"blocker_type": ["fit"]})
    doc = own["properties"]["documents"]["items"]
    assert next(iter(doc["properties"])) == "doc_id"
    for name in ("severity", "actionability_non_monetary", "confidence_pct"):
        assert "enum" in doc["properties"][name] and not {"minimum", "maximum"} & doc["properties"][name].keys()
    closed = lambda fields, **more: {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False} | more
    text = {"type": "string"}
    mixed = closed({"c": {"type": "number", "enum": [0.0, 0.1, 1.0]}})
    assert violations(spark, own, mixed, closed({"c": {"enum": [0, 10, 100, "x", True]}}), closed({"q": {"type": "string", "minLength": 1}}), closed({"a": text, "b": text}, required=["a", "zz"])) == [
        (1, "$.properties.c", "mixed enum", None), (3, "$.properties.q", "unsupported keyword", "minLength"), (4, "$", "no such property", "zz"), (4, "$", "not required", "b")]
    inner = {"type": "object", "properties": {"x": text}, "required": ["x"]}
    deep = closed({"items": {"type": "array", "items": inner}, "anyOf": text}, anyOf=[{"type": "integer", "default": 1}, closed({})], **{"$defs": {"D": closed({"minimum": text}, additionalProperties=text)}})
    assert violations(spark, deep, "[1]", "{bad", None, {"properties": {}}) == [
        (0, "$.$defs.D", "open object", None), (0, "$.anyOf[0]", "unsupported keyword", "default"), (0, "$.properties.items.items", "open object", None),
        (1, "$", "no object", None), (2, "$", "no object", None), (3, "$", "no object", None), (4, "$", "open object", None)]
    assert violations(spark) == []


def test_evaluation_guards(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, label string")
    assert evaluation.complete_or_fail(gold, gold).count() == 2
    with pytest.raises(PySparkException, match="without a prediction: 1"):
        evaluation.complete_or_fail(gold, gold.where("doc_id = 1")).collect()
    rows = spark.createDataFrame([(i, "x" if i < 2 else "y") for i in range(8)], "doc_id long, bucket string")
    got = [r.bucket for r in evaluation.representative_sample(rows, 16).collect()]
    assert got.count("x") == 4 and got.count("y") == 12
    for size in range(1, 9):  # shares of 1/4 and 3/4 round to more and to less than the size
        some = evaluation.representative_sample(rows, size).collect()
        assert len(some) == size == len({r.doc_id for r in some})
    assert evaluation.representative_sample(rows, 13).count() == 13 and evaluation.representative_sample(rows.where("1 = 0"), 3).count() == 0
    assert evaluation.fingerprint_of(rows) == evaluation.fingerprint_of(rows.repartition(3)) != evaluation.fingerprint_of(rows.where("doc_id > 0"))
    gate = evaluation.floor_gate(rows, wanted=F.col("bucket") == "y", survives=F.col("doc_id") > 3, floor=5).first()
    assert tuple(gate) == (6, 4, pytest.approx(4 / 6), False)


def test_quotes_in_turn(spark):
    rows = [("t1", "s1", 1, "same words", 1, 3), ("t1", "s2", 2, "other words", 0, 3), ("t1", "s1", 3, "third words", 1, 1), ("t2", "s1", 4, "same words", 1, 5), ("t2", "s1", 5, "own words", 0, 1), ("t3", "s", 6, "x", 0, 0)]
    got = evidence.select_in_turn(spark.createDataFrame(rows, "theme string, source string, doc_id long, quote string, overlap int, severity int"), ["t1", "t2"], limit=2)
    assert [(r["theme"], r["doc_id"], r["place"]) for r in got] == [("t1", 1, 1), ("t1", 2, 2), ("t2", 5, 1)]


def test_reports_and_files(spark, tmp_path):
    products = spark.createDataFrame([({"Loose": 60, "Perfect": 40}, {"Bad": 10, "Good": 90}, 4.0, None), ({"Perfect": 60, "Tight": 40}, None, None, {"5": 1, "4": 1}), (None, None, None, None)], "fit map<string,int>, quality map<string,int>, average_rating double, rating_distribution map<string,int>")
    assert tuple(reports.product_summary(products).first()) == (3, 2, 1, 0, 50.0, 1, 10.0, 1, 1, 1, 4.25)
    tagged = spark.createDataFrame([("s", "genuine"), (None, "other")], "source string, intent_class string")
    assert sorted(map(tuple, reports.overview(tagged, ["genuine", "open"]).collect())) == [("intent", "genuine", 1), ("intent", "open", 0), ("source", "s", 1), ("source", "unknown", 1)]
    members = spark.createDataFrame([(1, "p"), (1, "q"), (2, "p")], "doc_id long, label string")
    assert sorted(map(tuple, reports.excluded_labels(members, ["p", "q", "r"]).collect())) == [("any", 2), ("p", 2), ("q", 1), ("r", 0)]
    with pytest.raises(ValueError, match="older"):
        reports.fresh_or_fail(spark.createDataFrame([(dt.datetime(2024, 1, 2),)], "tagged_at timestamp"), dt.datetime(2024, 1, 1))
    assert "## A\n" in reports.report("R", [("A", members), ("B", "text")]) and reports.report("R", [("B", "text")]) == "# R\n\n## B\n\ntext\n"
    (tmp_path / "terms.txt").write_text("# head\nFit\n\nsize # note\nfit\n")
    assert tables.read_terms(spark, str(tmp_path / "terms.txt")) == ["fit", "size"]
    tables.write_worksheet(members.withColumn("verdict", F.lit(None).cast("string")).where("label = 'p'"), str(tmp_path / "sheet"), {"seed": 42})
    lines = [json.loads(x) for f in (tmp_path / "sheet").glob("part-*") for x in f.read_text().splitlines()]
    assert lines[0] == {"_meta": {"seed": 42}} and lines[1] == {"doc_id": 1, "label": "p", "verdict": None} and len(lines) == 3
