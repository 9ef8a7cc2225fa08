"""Hand-computed cases of single operators."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scoring as S
from corpusloom.functions import text as T
from corpusloom.operators import corpus, evaluation, evidence, reports, tags
from corpusloom.sources import html as H
from corpusloom.sources import tables
from corpusloom.streaming import stream


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_words_and_exclusions(spark):
    assert one(spark, "नमस्ते abc_1 é", T.word_count) >= 3
    assert one(spark, "the cat 99 sat", T.content_word_count) == 2
    rows = spark.createDataFrame([("two words", "en"), ("😀 so nice", "en"), ("😀 so very nice indeed", "en"), ("यह बहुत अच्छा है भाई", "hi"), ("one two three", "hi"), ("a b c d e f g h", "hi")], "text string, lang string")
    got = [r["y"] for r in rows.select(T.exclusion_reason(F.col("text"), F.col("lang")).alias("y")).collect()]
    assert got == ["too_short", "too_short", None, "hindi_language", None, "hindi_language"]


def test_text_helpers(spark):
    assert one(spark, "a" * 300, T.truncate) == "a" * 240 + "…"
    assert one(spark, "ab, " * 100, lambda c: T.truncate(c, 10)) == "ab, ab…"
    assert one(spark, "write to a.b@c.org or call +91 9876543210, paid 2,499 for order id: AB-12345, see @some_one", T.redact_collected) == "write to [email] or call [phone], paid 2,499 for order id: [id], see [handle]"
    assert one(spark, "a<br>b  &amp;​ c\n\n\n\nd", T.clean_text) == "a\nb & c\n\nd"
    assert [one(spark, x, T.rating) for x in ("4 of 5", "3.5/5", "2", "9", "none")] == [4.0, 3.5, 2.0, None, None]
    assert one(spark, "word " * 50, lambda c: T.truncate_to_tokens(c, 3)) == "word word"
    assert one(spark, "x" * 50, lambda c: T.truncate_to_tokens(c, 3)) == "x" * 12
    now = F.lit("2024-06-15 00:00:00").cast("timestamp")
    dates = [one(spark, x, lambda c: T.parse_date(c, now).cast("string")) for x in ("today", "yesterday", "2 days ago", "05/03/2024", "March 3, 2024", "nonsense")]
    assert dates == ["2024-06-15 00:00:00", "2024-06-14 00:00:00", "2024-06-13 00:00:00", "2024-03-05 00:00:00", "2024-03-03 00:00:00", None]


def test_scores(spark):
    row = spark.range(1).select(*S.wilson(F.lit(5), F.lit(10)), *S.wilson(F.lit(0), F.lit(0)), S.recency_weight(F.lit(365.0)), S.recency_weight(F.lit(-3.0)), S.lift(F.lit(2), F.lit(4), F.lit(5), F.lit(10.0)), S.lift(F.lit(0), F.lit(0), F.lit(5), F.lit(10.0))).first()
    assert row[0] == 0.5 and abs(row[1] - 0.2366) < 1e-3 and abs(row[2] - 0.7634) < 1e-3 and row[3:6] == (0.0, 0.0, 0.0)
    assert row[6:] == (0.5, 1.0, 1.0, None)
    with pytest.raises(ValueError):
        S.recency_weight(F.lit(1.0), 0)
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double").select(S.min_max(F.col("v")).alias("m")).collect()
    assert [r["m"] for r in same] == [1.0, 1.0]


def test_duplicates_never_chain(spark):
    """1 is near 2, 2 near 3, 1 not near 3: the greedy pass keeps 1 and 3."""
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long")
    got = {r["doc_id"]: r["root"] for r in corpus.first_accepted(spark.createDataFrame([(i,) for i in range(1, 7)], "doc_id long"), pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}
    prints = spark.createDataFrame([(1, 0), (2, 0b1111), (3, (1 << 13) - 1), (4, -1)], "doc_id long, fingerprint long")
    assert {(r.a, r.b, r.distance) for r in corpus.near_pairs(prints).collect()} == {(1, 2, 4), (2, 3, 9)}


def test_first_accepted_settles_long_chains(spark):
    """Each row is near the next only: every second one is a duplicate, to the end of the chain."""
    rows = spark.createDataFrame([(i,) for i in range(56)], "doc_id long").coalesce(1)
    got = {r["doc_id"]: r["root"] for r in corpus.first_accepted(rows, rows.selectExpr("doc_id as a", "doc_id + 1 as b").where("b < 56")).collect()}
    assert got == {i: i - i % 2 for i in range(56)}


def test_upserts(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    assert {tuple(r) for r in corpus.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "C")}
    assert [tuple(r) for r in corpus.absent(new, old, ["k"]).collect()] == [(3, "C")]


def test_author_share_counts_every_voice(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "doc_id long, author string").withColumn("recency", F.lit(1.0))
    members = spark.createDataFrame([(1, "blocker", "fit")], "doc_id long, dimension string, label string")
    assert abs(tags.author_share(docs, members).first()["share"] - 0.5 / 3) < 1e-9


def test_tags_explode_without_repeats(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"], None)], "doc_id long, x array<string>, y array<string>")
    assert sorted(tuple(r) for r in tags.explode_tags(df, {"x": "blocker", "y": "info"}).collect()) == [(1, "blocker", "a"), (1, "blocker", "b")]


def test_sampling(spark):
    counts = spark.createDataFrame([("a", 7), ("b", 2), ("c", 1)], "source string, n long")
    take = lambda df: {r["source"]: r["take"] for r in df.collect()}
    assert take(evaluation.allocate(counts, 5)) == {"a": 4, "b": 1, "c": 0}
    assert take(evaluation.allocate(counts, 99)) == {"a": 7, "b": 2, "c": 1}
    assert min(take(evaluation.allocate(counts, 5, floor=1)).values()) == 1
    assert take(evaluation.allocate(counts, 2, floor=1)) == {"a": 1, "b": 1, "c": 0}


def test_quality(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, label string")
    pred = spark.createDataFrame([(1, "a"), (3, "a")], "doc_id long, label string")
    rows = {r["label"]: r for r in evaluation.label_scores(gold, pred).collect()}
    assert (rows["a"].tp, rows["a"].fp, rows["a"].fn, rows["a"].f1) == (1, 1, 1, 0.5) and rows["b"].f1 == 0
    rates = spark.createDataFrame([("x", 1)] + [("x", 0)] * 9 + [("y", 0)] * 5, "s string, bad int")
    got = {r["s"]: (r["passes"], r["all_pass"]) for r in evaluation.gate(rates, by="s", wrong=F.col("bad") == 1).collect()}
    assert got == {"x": (False, False), "y": (True, False)}


def test_evidence(spark):
    docs = spark.createDataFrame([(1, "the size runs small here")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, "d", "fit", "Size  runs small"), (1, "d", "price", "too dear"), (1, "e", "fit", "runs small"), (1, "e", "fit", "RUNS small"), (1, "e", "a", " "), (1, "e", "b", None)], "doc_id long, dimension string, label string, quote string")
    got = {(r["dimension"], r["label"]): (r["not_in_document"], r["no_cue_overlap"], r["quoted_twice"]) for r in evidence.flags(spans, docs, {"d": {"fit": ["size"]}, "e": {"fit": ["Tight", ""]}}).collect()}
    assert got == {("d", "fit"): (False, False, False), ("d", "price"): (True, False, False), ("e", "fit"): (False, True, True), ("e", "a"): (True, False, False), ("e", "b"): (True, False, False)}


def test_maps(spark):
    df = spark.createDataFrame([({"5": 50, "1": 40}, {"Loose": 30, "Tight": 10, "ok": 60})], "stars map<string,int>, o map<string,int>")
    row = df.select(reports.star_average(F.col("stars")), reports.option_share(F.col("o"), ["loose", "TIGHT"]), reports.top_option(F.col("o"))).first()
    assert tuple(row) == (3.2, 40, "ok")


def test_sources(spark, tmp_path):
    part = tmp_path / "raw" / "shop" / "2024-01-01"
    part.mkdir(parents=True)
    rec = {"source": "shop", "source_native_id": "1", "text": "first", "collected_at": "2024-01-01T00:00:00Z", "created_utc": "2030-01-01T00:00:00Z"}
    (part / "part-000.jsonl").write_text("\n".join([json.dumps(rec), "{broken", json.dumps(rec | {"text": " "}), json.dumps(rec | {"text": "second"})]))
    raw = tables.read_raw(spark, str(tmp_path / "raw"))
    assert raw.where("rejected").count() == 2
    last = tables.latest_raw(raw).collect()
    assert [r["text"] for r in last] == ["second"] and last[0]["created_utc"] == last[0]["collected_at"]
    with pytest.raises(KeyError), tables.run_log(spark, str(tmp_path / "log"), "stage"):
        raise KeyError
    assert spark.read.parquet(str(tmp_path / "log")).first()["notes"] == "failed: KeyError"


def test_parsers(spark):
    feed = json.dumps({"feed": {"entry": [{"title": {"label": "app"}}, {"id": {"label": "9"}, "title": {"label": "T"}, "content": {"label": "C"}, "im:rating": {"label": "4"}}]}})
    assert [(r.id, r.text, r.rating) for r in H.feed_reviews(spark.createDataFrame([(feed,)], "payload string")).collect()] == [("9", "T\nC", 4)]
    c = lambda i, t: {"id": i, "snippet": {"textDisplay": t}}
    threads = json.dumps({"items": [{"id": "t", "snippet": {"topLevelComment": c("a", "top")}, "replies": {"comments": [c("b", "re")]}}]})
    assert sorted((r.id, r.parent_id, r.text) for r in H.comment_threads(spark.createDataFrame([(threads,)], "payload string")).collect()) == [("a", None, "top"), ("b", "a", "re")]
    assert one(spark, "<p>x<script>var a='<p>'</script> y</p>", H.visible_text) == "x y"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", i % 2, "view", 1.0) for i in range(30)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    live = stream.tumbling(stream.read_events(spark, str(tmp_path / "in"))).select("window.start", "event_type", "n")
    q = live.writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = stream.tumbling(spark.read.parquet(str(tmp_path / "in"))).select("window.start", "event_type", "n")
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, batch.collect()))
    stream.upsert_batches(stream.read_events(spark, str(tmp_path / "in")), str(tmp_path / "t"), ["user_id"], str(tmp_path / "ck2"), order=("event_id",))
    assert {r.user_id: r.event_id for r in stream.read_upserted(spark, str(tmp_path / "t"), ["user_id"]).collect()} == {0: 28, 1: 29}
    stream.compact(spark, str(tmp_path / "t"), ["user_id"], str(tmp_path / "u"))
    assert stream.read_upserted(spark, str(tmp_path / "u"), ["user_id"]).count() == 2


def test_tagger_and_packing(spark):
    docs = spark.createDataFrame([(1, "Too tight"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in evaluation.tag_with(docs, evaluation.cue_tagger({"fit": ["tight"]})).collect()}
    assert got == {1: ["fit"], 2: []}
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate([5, 5, 5, 99, 1])], "source string, doc_id long, tokens long")
    packed = evaluation.pack_batches(rows, by="source", order="doc_id", tokens="tokens", max_count=2, budget=10)
    assert [r.batch for r in packed.orderBy("doc_id").collect()] == [0, 0, 1, 2, 3]


def test_near_duplicates_equal_the_sequential_pass(spark):
    import random

    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(40)]
    for _ in range(60):
        words = rng.choice(texts).split()
        words[rng.randrange(60)] = "changed"
        texts.append(" ".join(words))
    texts += [texts[0], "", "http://only.a/link", "short text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("words", T.word_count(F.col("text")))
    prints = S.simhash(docs, "doc_id")
    rows = sorted((r.doc_id, r.fingerprint, r.words) for r in prints.join(docs, "doc_id").collect())
    first, accepted, want = {}, [], {}
    for i, p, n in rows:
        if p in first:
            want[i] = first[p]
            continue
        first[p] = i
        near = [j for j, q in accepted if bin((p ^ q) & (2**64 - 1)).count("1") <= 12] if n >= 25 else []
        if near:
            want[i] = near[0]
        elif n >= 25:
            accepted.append((i, p))
    want = {i: want.get(j, j) for i, j in want.items()}
    got = {r.doc_id: r.is_duplicate_of for r in corpus.mark_duplicates(docs, prints).collect()}
    assert {i: j for i, j in got.items() if j is not None} == want and len(got) == len(texts)
