"""Further queries with their SQL: parsers on payloads that are made from the tables, files that are written and read back, report parts."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import scoring as S
from corpusloom.functions import text as T
from corpusloom.operators import corpus, evaluation, evidence, explorer, ordered, quantify, reports, tagging, tags
from corpusloom.plans.catalog import FLAT_SQL, HITS_SQL, MEM, NORM, REASON_SQL, SPAN_SQL, SQL, STAGE_OF, TERMS, WORDS_SQL, _genuine, _reason, _score_sql, _spans, docs, members, opportunity_score, order_docs, pairs, query, r6, topk_cooccur
from corpusloom.sources import html as H
from corpusloom.sources import listings, manual, parts, robots, store, tables
from corpusloom.sources.tables import checkpointed, scratch, table
from corpusloom.streaming import stream

text = lambda c: F.col(c).cast("string")


# Files that are written and read back.


def _raw(spark, d, version: str = "") -> DataFrame:
    t = F.concat(F.lit(version), F.col("text"))
    created = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    day = "2024-01-06" if version else "2024-01-05"
    return docs(spark, d).select("source", text("doc_id").alias("source_native_id"), F.lit(None).cast("string").alias("url"), F.col("lang").alias("author_raw"), created.alias("created_utc"), t.alias("text"), F.to_json(F.struct("lang")).alias("meta"), F.lit(day).cast("timestamp").alias("collected_at"), F.lit("1").alias("collector_version"))


def _raw_folder(spark, d) -> str:
    """All records, and a day later every third again with another text."""
    path = scratch(spark, "raw")
    tables.write_raw(_raw(spark, d), path)
    tables.write_raw(_raw(spark, d, "again ").where("source_native_id % 3 = 0"), path)
    return path


#: Creation times after collection are clamped to it; rejected are blank texts and those of over 2 % replacement characters.
RAW_SQL = """raw AS (SELECT source, doc_id, text, 0 AS again FROM documents UNION ALL SELECT source, doc_id, 'again ' || text, 1 FROM documents WHERE doc_id % 3 = 0),
r AS (SELECT *, trim(coalesce(text, '')) = '' OR (length(text) - length(replace(text, chr(65533), ''))) / greatest(length(text), 1) > 0.02 AS rejected FROM raw)"""


@query(f"WITH {RAW_SQL} SELECT source, doc_id::varchar AS source_native_id, again, md5(text) AS content, rejected, least(1704067200 + doc_id * 3600, CASE again WHEN 1 THEN 1704499200 ELSE 1704412800 END) AS created FROM r")
def raw_records(spark, d):
    got = tables.read_raw(spark, _raw_folder(spark, d))
    return got.select("source", "source_native_id", (F.to_date("collected_at") == F.lit("2024-01-06").cast("date")).cast("int").alias("again"), F.md5("text").alias("content"), "rejected", F.unix_seconds("created_utc").alias("created"))


@query(f"WITH {RAW_SQL} SELECT source, doc_id::varchar AS source_native_id, arg_max(md5(text), again) AS content FROM r WHERE NOT rejected GROUP BY source, doc_id")
def raw_latest(spark, d):
    return tables.latest_raw(tables.read_raw(spark, _raw_folder(spark, d))).select("source", "source_native_id", F.md5("text").alias("content"))


@query(f"WITH {RAW_SQL} SELECT source, count(*) AS records, count(*) FILTER (WHERE rejected) AS rejected, count(DISTINCT doc_id) FILTER (WHERE NOT rejected) AS documents FROM r GROUP BY source")
def raw_scan(spark, d):
    return tables.scan_counts(tables.read_raw(spark, _raw_folder(spark, d)))


@query(f"WITH {RAW_SQL} SELECT source, DATE '2024-01-05' + again::int AS run_date, 'ok' AS status, count(*) AS records FROM r GROUP BY source, again")
def manifest_rows(spark, d):
    return tables.manifest_of(tables.read_raw(spark, _raw_folder(spark, d))).select("source", "run_date", "status", "records")


@query(f"WITH {RAW_SQL} SELECT s.source, s.source IN (SELECT source FROM r WHERE again = 1) AS done FROM (SELECT DISTINCT source FROM documents) s")
def manifest_skip(spark, d):
    """Which sources have a finished manifest of the second day."""
    m = checkpointed(tables.manifest_of(tables.read_raw(spark, _raw_folder(spark, d))))
    names = [r[0] for r in docs(spark, d).select("source").distinct().collect()]
    return spark.createDataFrame([(s, tables.manifest_exists(m, s, "2024-01-06")) for s in sorted(names)], "source string, done boolean")


#: Documents of a hand-made file: it is read whole.
MANUAL = 256


@query("SELECT doc_id::varchar AS native_id, source, lang AS author, md5(text) AS content FROM documents WHERE trim(text) <> ''")
def manual_documents(spark, d):
    """Files of the object form for the first sources, of a record a line for the others, each of at most ``MANUAL`` documents."""
    path = scratch(spark, "manual")
    rows = docs(spark, d).select(F.when(F.col("source") < "src2", "a").otherwise("b").alias("part"), F.floor(F.col("doc_id") / MANUAL).alias("file"), F.struct(text("doc_id").alias("id"), "source", "text", F.col("lang").alias("author")).alias("item"))
    whole = rows.where("part = 'a'").groupBy("file").agg(F.to_json(F.struct(F.collect_list("item").alias("documents"))).alias("value"))
    whole.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}/a")
    rows.where("part = 'b'").select(F.to_json(F.struct(F.col("item.id").alias("native_id"), "item.source", F.col("item.text").alias("body"), "item.author")).alias("value")).write.option("maxRecordsPerFile", MANUAL).text(f"{path}/b")
    return tables.read_manual(spark, path, files="part-*").select("native_id", "source", "author", F.md5("text").alias("content"))


def _products(spark, d) -> str:
    """Twenty product files, the even ones without an average of their own."""
    line = table(spark, d, "lineitem").withColumn("p", F.col("l_partkey") % 20)
    n = line.groupBy("p").agg(*[F.count_if(F.col("l_quantity").cast("long") % 5 == k).cast("int").alias(f"s{k}") for k in range(5)])
    stars = F.map_from_arrays(F.array(*[F.lit(str(k + 1)) for k in range(5)]), F.array(*[F.col(f"s{k}") for k in range(5)]))
    fit = F.map_from_arrays(F.array(F.lit("Loose"), F.lit("tight"), F.lit("just right")), F.array("s0", "s1", "s2"))
    quality = F.map_from_arrays(F.array(F.lit("Bad"), F.lit("Very Bad"), F.lit("good")), F.array("s1", "s3", "s4"))
    ask = F.array(F.struct(F.lit("fit").alias("question"), fit.alias("options")), F.struct(F.lit("quality").alias("question"), quality.alias("options")))
    body = F.to_json(F.struct(text("p").alias("product_id"), F.lit("2024-01-01").alias("extracted_at"), F.when(F.col("p") % 2 == 1, F.lit(3.5)).alias("average_rating"), stars.alias("rating_distribution"), ask.alias("opinions")))
    path = scratch(spark, "products")
    n.select("p", body.alias("value")).repartition("p").write.partitionBy("p").text(path)
    return path


STARS = "n AS (SELECT l_partkey % 20 AS p, " + ", ".join(f"count(*) FILTER (WHERE l_quantity::bigint % 5 = {k}) AS s{k}" for k in range(5)) + " FROM lineitem GROUP BY 1)"


def _opinion(name: str):
    return F.get(F.filter("opinions", lambda o: o["question"] == name), F.lit(0))["options"]


@query(f"WITH {STARS} SELECT p::varchar AS product_id, CASE WHEN p % 2 = 1 THEN 3.5 END AS average_rating, round((s0 + 2 * s1 + 3 * s2 + 4 * s3 + 5 * s4) / (s0 + s1 + s2 + s3 + s4), 1) AS derived, s0 + s1 AS misfit, s1 + s3 AS bad, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 'Loose' WHEN s1 >= s2 THEN 'tight' ELSE 'just right' END AS top FROM n")
def product_aggregates(spark, d):
    rows = tables.read_aggregates(spark, _products(spark, d), files="part-*")
    return rows.select("product_id", "average_rating", reports.star_average(F.col("rating_distribution")).alias("derived"), reports.option_share(_opinion("fit"), ["loose", "tight"]).alias("misfit"), reports.option_share(_opinion("quality"), ["bad", "very bad"]).alias("bad"), reports.top_option(_opinion("fit")).alias("top"))


SUMMARY = f"""{STARS}, v AS (SELECT *, CASE WHEN p % 2 = 1 THEN 3.5 ELSE round((s0 + 2 * s1 + 3 * s2 + 4 * s3 + 5 * s4) / (s0 + s1 + s2 + s3 + s4), 1) END AS average FROM n)"""


def _summary(spark, d):
    rows = tables.read_aggregates(spark, _products(spark, d), files="part-*")
    return reports.product_summary(rows.select(_opinion("fit").alias("fit"), _opinion("quality").alias("quality"), "average_rating", "rating_distribution"))


@query(f"""WITH {SUMMARY} SELECT count(*) AS products, count(*) AS products_with_fit, count(*) FILTER (WHERE s0 >= s1 AND s0 >= s2) AS top_fit_is_loose, count(*) FILTER (WHERE s1 > s0 AND s1 >= s2) AS top_fit_is_tight, round(avg(s0 + s1), 1) AS mean_misfit_pct,
count(*) AS products_with_quality, round(avg(s1 + s3), 1) AS mean_bad_quality_pct, count(*) FILTER (WHERE p % 2 = 1) AS ratings_reported, count(*) FILTER (WHERE p % 2 = 0) AS ratings_derived, 0 AS ratings_unknown, round(sum((average * 10)::bigint) / (10.0 * count(*)), 2) AS mean_average_rating FROM v""")
def product_summary(spark, d):
    return _summary(spark, d)


@query(f"""WITH {SUMMARY}, m AS (SELECT count(*) AS k, sum((average * 10)::bigint) / (10.0 * count(*)) AS a, avg(s0 + s1) AS f, avg(s1 + s3) AS q, count(*) FILTER (WHERE s0 >= s1 AND s0 >= s2) AS loose, count(*) FILTER (WHERE s1 > s0 AND s1 >= s2) AS tight FROM v)
SELECT 1 AS pos, format('Coverage: **{{}} product(s)**.', k) AS line FROM m UNION ALL SELECT 2, format('- **Rating:** mean {{:.2f}}, 10 reported and 10 derived.', round(a, 2)) FROM m
UNION ALL SELECT 3, format('- **Fit:** {{}} product(s); mean misfit {{:.1f}}%, {{}} loose, {{}} tight.', k, round(f, 1), loose, tight) FROM m UNION ALL SELECT 4, format('- **Quality:** {{}} product(s); mean bad and very bad {{:.1f}}%.', k, round(q, 1)) FROM m
UNION ALL SELECT 5, '- **' || p_type || '**: ' || CASE WHEN contains(p_type, 'STEEL') THEN format('corroborated by fit, mean {{:.1f}}% over {{}} product(s)', round(f, 1), k) ELSE 'not corroborated' END || '.' FROM (SELECT DISTINCT p_type FROM part), m""")
def side_channel_lines(spark, d):
    rows = tables.read_aggregates(spark, _products(spark, d), files="part-*")
    shares = rows.select(reports.option_share(_opinion("fit"), ["loose", "tight"]).alias("misfit"), reports.option_share(_opinion("quality"), ["bad", "very bad"]).alias("bad_quality"))
    themes = table(spark, d, "part").select(F.col("p_type").alias("theme")).distinct()
    return explorer.side_channel(_summary(spark, d), tagging.cross_reference(themes, shares, {"fit": ["steel"]}))


@query("WITH o AS (" + SQL["opportunity_score"] + ") SELECT dimension, label, score, prevalence, row_number() OVER (ORDER BY score DESC, dimension, label) AS place FROM o")
def scores_file(spark, d):
    """The score file as it is written and read back, ordered by score alone."""
    path = scratch(spark, "scores")
    tables.write_csv(opportunity_score(spark, d), path)
    from pyspark.sql import Window

    return tables.read_scores(spark, path).select("dimension", "label", "score", "prevalence").withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "dimension", "label")))


@query(SQL["segment_matrix"])
def segment_file(spark, d):
    path = scratch(spark, "segments")
    tables.write_csv(pairs(spark, d).where("dimension_b = 'segment'").select(F.col("label_b").alias("segment"), F.col("label_a").alias("blocker"), "n_both", r6("lift").alias("lift")), path)
    return store.read_segment_matrix(spark, path).withColumn("n_both", F.col("n_both").cast("long"))


@query("SELECT doc_id, lang, NULL::varchar AS verdict, 'draw of 42' AS how FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 3")
def worksheet(spark, d):
    """A drawn worksheet of JSON lines, its first line saying how it was drawn."""
    path = scratch(spark, "worksheet")
    tables.write_worksheet(evaluation.equal_draw(docs(spark, d).select("doc_id", "lang"), 3, by="lang").withColumn("verdict", F.lit(None).cast("string")), path, {"how": "draw of 42"})
    lines = spark.read.text(path)
    head = lines.where("value like '%_meta%'").select(F.get_json_object("value", "$._meta.how").alias("how"))
    row = F.from_json("value", "doc_id long, lang string, verdict string").alias("r")
    return lines.where("value not like '%_meta%'").select(row).select("r.*").join(head, how="cross")


@query("SELECT 'profile' AS stage, count(*) AS records_in, count(DISTINCT source) AS records_out, '' AS notes FROM documents UNION ALL SELECT 'broken', 0, 0, 'failed: ValueError'")
def audit_log(spark, d):
    """A stage that ends and one that fails, both with their row."""
    path = scratch(spark, "run-log")
    with tables.run_log(spark, path, "profile") as entry:
        own = docs(spark, d)
        entry["records_in"], entry["records_out"] = own.count(), own.select("source").distinct().count()
    try:
        with tables.run_log(spark, path, "broken"):
            raise ValueError("on purpose")
    except ValueError:
        pass
    return spark.read.parquet(path).select("stage", "records_in", "records_out", "notes")


@query("SELECT doc_id, md5(text) AS content FROM documents")
def decoded_files(spark, d):
    """Bytes in UTF-8 without and with its mark, and in UTF-16 with its own."""
    mark = F.unhex(F.lit("EFBBBF"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(mark, F.encode("text", "UTF-8"))).when(F.col("doc_id") % 3 == 1, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    return docs(spark, d).select("doc_id", F.md5(manual.decoded(raw)).alias("content"))


@query("SELECT 'source, source_native_id repeats' AS rule, count(*) AS n FROM (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'parent is not in orders', count(*) FROM lineitem WHERE l_orderkey + l_partkey NOT IN (SELECT o_orderkey FROM orders)")
def broken_rules(spark, d):
    """Lines of orders as rows of a table: repeated unique columns and references to nothing are told, rules that hold are not."""
    rows = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").alias("k"), F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("source_native_id"), (F.col("l_orderkey") + F.col("l_partkey")).alias("parent"))
    parents = {"orders": table(spark, d, "orders")}
    return store.violations(rows, "lines", parents, keys=[], unique=[["source", "source_native_id"]], required=["source", "k"], references=[("parent", "orders", "o_orderkey")])


@query("SELECT 'documents' AS name, count(*) AS n, 0 AS pointed FROM documents UNION ALL SELECT 'doc_tags', 0, 0 UNION ALL SELECT 'llm_cache', 0, 0 UNION ALL SELECT 'run_log', 0, 0 UNION ALL SELECT 'triage_cache', 0, 0")
def store_tables(spark, d):
    """The tables of a new store after documents were put in, replaced by themselves, and their pointers cleared."""
    folder = scratch(spark, "store")
    store.init_store(spark, folder)
    own = docs(spark, d).select(text("doc_id").alias("doc_id"), "source", text("doc_id").alias("source_native_id"), "text", F.lit("x").alias("is_duplicate_of"))
    empty = store.open_table(spark, folder, "documents")
    store.replace_rows(empty.unionByName(own, allowMissingColumns=True), folder, "documents")
    store.init_store(spark, folder)
    store.replace_rows(store.cleared(store.open_table(spark, folder, "documents"), "is_duplicate_of"), folder, "documents")
    rows = []
    for name in sorted(store.LAYOUT):
        t = store.open_table(spark, folder, name)
        rows.append((name, t.count(), t.where("is_duplicate_of is not null").count() if name == "documents" else 0))
    return spark.createDataFrame(rows, "name string, n long, pointed long")


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY source")
def saved_sample(spark, d):
    """A sample is saved, a second one is refused, and with force it stands."""
    folder = scratch(spark, "sample")
    own = docs(spark, d).select("doc_id", "source")
    store.save_sample(own.where("doc_id % 2 = 1"), folder)
    try:
        store.save_sample(own, folder)
    except FileExistsError:
        store.save_sample(own.where("doc_id % 2 = 0"), folder, force=True)
    return spark.read.parquet(f"{folder}/tag_sample").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = 7")
def point_lookup(spark, d):
    """One key of a clustered table: other row groups are skipped."""
    path = scratch(spark, "clustered")
    store.write_clustered(docs(spark, d), path, "doc_id")
    return store.point(spark.read.parquet(path), doc_id=7).select("doc_id", "lang", "source")


@query("SELECT toxic = 1 AS there, count(*) AS n FROM labels WHERE toxic = 1 GROUP BY 1")
def tagged_count(spark, d):
    return spark.createDataFrame([store.tagged_already(table(spark, d, "labels"), toxic=1)], "there boolean, n long")


@query("SELECT * FROM (VALUES ('blocker', 'fit', 'too tight'), ('blocker', 'fit', 'size'), ('segment', 'new', 'first time')) v(dimension, label, cue)")
def cue_lexicon(spark, d):
    path = scratch(spark, "cues")
    spark.createDataFrame([("# cues\nblocker:\n  fit:\n    - 'too tight'\n    - size # common\nsegment:\n  new: [first time]\n",)], "value string").coalesce(1).write.text(path)
    cues = store.read_cues(spark, path)
    return spark.createDataFrame([(dim, label, c) for dim, ls in cues.items() for label, cs in ls.items() for c in cs], "dimension string, label string, cue string")


@query("SELECT DISTINCT lower(lang) AS term FROM documents")
def term_file(spark, d):
    path = scratch(spark, "terms")
    lines = docs(spark, d).select(F.concat(F.upper("lang"), F.lit("  # a language")).alias("value")).distinct().unionByName(spark.createDataFrame([("# only a comment",), ("",)], "value string"))
    lines.coalesce(1).write.text(path)
    return spark.createDataFrame([(t,) for t in tables.read_terms(spark, path)], "term string")


# Parsers, on payloads that are made from the tables.


@query("SELECT p_partkey::varchar AS video_id, p_name AS title, p_brand AS channel, p_type AS published FROM part")
def search_payloads(spark, d):
    """Ten hits a payload, among them one of another kind."""
    hit = F.struct(F.struct(text("p_partkey").alias("videoId"), F.lit(None).cast("string").alias("channelId")).alias("id"), F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("channelTitle"), F.col("p_type").alias("publishedAt")).alias("snippet"))
    other = F.struct(F.struct(F.lit(None).cast("string").alias("videoId"), F.lit("c").alias("channelId")).alias("id"), F.struct(F.lit("t").alias("title"), F.lit("c").alias("channelTitle"), F.lit("p").alias("publishedAt")).alias("snippet"))
    pay = table(spark, d, "part").groupBy(F.col("p_partkey") % 100).agg(F.to_json(F.struct(F.array_append(F.collect_list(hit), other).alias("items"))).alias("payload"))
    return listings.search_results(pay)


@query("SELECT l_partkey AS video_id, min(l_suppkey) AS term_pos FROM lineitem GROUP BY 1")
def first_search_term(spark, d):
    hits = table(spark, d, "lineitem").select(F.col("l_partkey").alias("video_id"), F.col("l_suppkey").alias("term_pos"))
    return listings.first_term(hits)


@query("SELECT conv_id || '-' || turn AS id, CASE WHEN turn > 0 THEN conv_id || '-0' END AS parent_id, md5(text) AS content, role AS author FROM conversations WHERE text IS NOT NULL")
def thread_payloads(spark, d):
    """A conversation as a comment with its replies."""
    said = F.struct(F.col("text").alias("textDisplay"), F.col("role").alias("authorDisplayName"), F.lit("2024").alias("publishedAt"), F.lit(1).alias("likeCount"))
    one = F.struct("turn", F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), said.alias("snippet")).alias("c"))
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    cs = F.transform("t", lambda x: x["c"])
    pay = t.select(F.to_json(F.struct(F.array(F.struct(F.struct(F.get(cs, F.lit(0)).alias("topLevelComment")).alias("snippet"), F.struct(F.slice(cs, F.lit(2), F.size(cs)).alias("comments")).alias("replies"))).alias("items"))).alias("payload"))
    return H.comment_threads(pay).select("id", "parent_id", F.md5("text").alias("content"), "author")


@query("SELECT event_id::varchar AS id, event_type || chr(10) || props AS text, user_id::varchar AS author, (event_id % 5)::int AS rating FROM events WHERE event_id % 7 > 0")
def feed_payloads(spark, d):
    """Entries without a rating describe the app."""
    label = lambda c: F.struct(c.cast("string").alias("label"))
    rated = F.when(F.col("event_id") % 7 > 0, label(F.col("event_id") % 5))
    e = F.struct(label(F.col("event_id")).alias("id"), label(F.col("event_type")).alias("title"), label(F.col("props")).alias("content"), F.struct(label(F.col("user_id")).alias("name")).alias("author"), rated.alias("im:rating"))
    pay = table(spark, d, "events").groupBy(F.col("event_id") % 50).agg(F.to_json(F.struct(F.struct(F.collect_list(e).alias("entry")).alias("feed"))).alias("payload"))
    return H.feed_reviews(pay).select("id", "text", "author", "rating")


@query("SELECT event_id::varchar AS native_id, event_type AS text, user_id % 2 = 0 AS own_brand FROM events WHERE event_type <> 'error'")
def store_reviews(spark, d):
    rows = table(spark, d, "events").select(text("event_id").alias("review_id"), F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("content"), text("user_id").alias("user"), F.lit("d").alias("at"), F.lit(1).alias("score"), F.when(F.col("user_id") % 2 == 0, "com.Shop.app").otherwise("org.other").alias("app_id"))
    return listings.app_reviews(rows, brand="shop").select("native_id", "text", "own_brand")


@query("""WITH f AS (SELECT conv_id, min(turn) AS t FROM conversations GROUP BY 1), p AS (SELECT 'p' || conv_id AS native_id, CASE WHEN conv_id % 3 = 0 THEN 'conversation ' || conv_id ELSE 'conversation ' || conv_id || chr(10) || chr(10) || text END AS t, NULL AS parent_id FROM conversations JOIN f USING (conv_id) WHERE turn = f.t)
SELECT native_id, md5(trim(t)) AS content, parent_id FROM p UNION ALL SELECT conv_id || '-' || turn, md5(text), 'p' || conv_id FROM conversations WHERE turn > 0 AND turn % 4 <> 3 AND trim(text) <> ''""")
def post_payloads(spark, d):
    """A conversation as a post with comments; every third body and every fourth comment was removed."""
    c = table(spark, d, "conversations").withColumn("body", F.when(F.col("turn") % 4 == 3, "[removed]").otherwise(F.col("text")))
    one = F.struct("turn", "text", F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), "body", F.col("role").alias("author"), F.lit(1).cast("long").alias("created"), F.concat(F.lit("p"), "conv_id").alias("parent_id")).alias("c"))
    t = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    posts = t.select(F.concat(F.lit("p"), "conv_id").alias("id"), F.concat(F.lit("conversation "), "conv_id").alias("title"), F.when(F.col("conv_id") % 3 == 0, "[deleted]").otherwise(F.get("t", F.lit(0))["text"]).alias("body"), F.lit("a").alias("author"), F.lit(1).cast("long").alias("created"), F.transform(F.slice("t", F.lit(2), F.size("t")), lambda x: x["c"]).alias("comments"))
    return listings.posts_with_comments(posts).select("native_id", F.md5("text").alias("content"), "parent_id")


def _review_item(*names: str):
    return F.struct(*[F.col(c).alias(n) for n, c in (x.split("=") for x in names)])


@query("SELECT 'http://x/' || (event_id % 20) AS url, event_id::varchar AS native_id, CASE WHEN event_id % 3 = 0 THEN props ELSE event_type || chr(10) || chr(10) || props END AS text, user_id::varchar AS author, value AS rating FROM events WHERE event_id % 11 > 0")
def page_data(spark, d):
    """Reviews in the data of a page; those without text give nothing."""
    e = table(spark, d, "events").select("*", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("title"), F.when(F.col("event_id") % 11 > 0, F.col("props")).otherwise("").alias("body"), F.struct(text("user_id").alias("displayName")).alias("who"), text("value").alias("stars"), text("event_id").alias("eid"))
    pages = e.groupBy(F.concat(F.lit("http://x/"), F.col("event_id") % 20).alias("url")).agg(F.collect_list(_review_item("id=eid", "title=title", "text=body", "rating=stars", "consumer=who")).alias("reviews"))
    data = F.to_json(F.struct(F.struct(F.struct("reviews").alias("pageProps")).alias("props")))
    return listings.page_data_reviews(pages.select("url", F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script></html>")).alias("html"))).select("url", "native_id", "text", "author", "rating")


@query("SELECT event_id % 20 AS page, props AS text, value::varchar AS rating, user_id::varchar AS author FROM events")
def ld_json(spark, d):
    """Reviews of schema.org scripts."""
    r = F.struct(F.col("props").alias("reviewBody"), F.struct(text("value").alias("ratingValue")).alias("reviewRating"), F.struct(text("user_id").alias("name")).alias("author"))
    pages = table(spark, d, "events").groupBy((F.col("event_id") % 20).alias("page")).agg(F.to_json(F.struct(F.collect_list(r).alias("review"))).alias("j"))
    html = F.concat(F.lit('<head><script type="application/ld+json">'), "j", F.lit("</script></head>"))
    return pages.select("page", F.explode(manual.json_ld_reviews(html)).alias("r")).select("page", F.col("r.reviewBody").alias("text"), F.col("r.reviewRating.ratingValue").alias("rating"), F.col("r.author.name").alias("author"))


@query("SELECT event_id::varchar AS native_id, event_type AS text, CASE WHEN event_id % 2 = 0 THEN user_id::varchar END AS author, value AS rating FROM events")
def review_api(spark, d):
    """Payloads of two shapes, one under data.items."""
    e = table(spark, d, "events")
    a = e.where("event_id % 2 = 0").groupBy(F.col("event_id") % 30).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("event_id").alias("reviewId"), F.col("event_type").alias("reviewText"), F.col("user_id").alias("userName"), F.col("value").alias("rating"))).alias("reviews"))).alias("payload"))
    b = e.where("event_id % 2 = 1").groupBy(F.col("event_id") % 30).agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("comment"), F.col("value").alias("stars"))).alias("items")).alias("data"))).alias("payload"))
    return listings.api_reviews(a.select("payload").unionByName(b.select("payload"))).select("native_id", "text", "author", "rating")


@query("SELECT conv_id::varchar AS native_id, 'What of ' || conv_id || '?' AS text, md5(string_agg(text, '|' ORDER BY turn)) AS answers FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def question_api(spark, d):
    """Conversations as questions; answers are objects of two shapes."""
    a = F.struct("turn", F.when(F.col("turn") % 2 == 0, F.struct("text", F.lit(None).cast("string").alias("answer"))).otherwise(F.struct(F.lit(None).cast("string").alias("text"), F.col("text").alias("answer"))).alias("a"))
    q = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(a)), lambda x: x["a"]).alias("answers"))
    pay = q.select(F.to_json(F.struct(F.array(F.struct(F.col("conv_id").alias("questionId"), F.concat(F.lit("What of "), "conv_id", F.lit("?")).alias("question"), "answers")).alias("qna"))).alias("payload"))
    return listings.api_questions(pay).select("native_id", "text", F.md5(F.array_join("answers", "|")).alias("answers"))


ONE_LINE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"WITH l AS (SELECT conv_id, turn, {ONE_LINE} AS t FROM conversations) SELECT conv_id::varchar AS file, 'What of ' || conv_id || '?' AS question, md5(t) AS answer FROM l WHERE t <> '' AND length(t) >= 40")
def thread_files(spark, d):
    """A question and its answers as the paragraphs of a file; short ones go."""
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: T.squeeze(x["text"])).alias("a"))
    files = t.select(text("conv_id").alias("file"), F.concat(F.lit("What of "), "conv_id", F.lit("?\n\n"), F.array_join("a", "\n \n")).alias("text"))
    return manual.split_thread(files).select("file", "question", F.md5("answer").alias("answer"))


@query("SELECT p_brand AS file, 'P' || p_partkey AS product, 1 + p_size % 5 AS rating, p_name || ' fits.' AS text, p_type AS author, '3 March 2024' AS date FROM part")
def review_files(spark, d):
    """Brands as files of products with a review each: directives carry forward, blocks are parsed."""
    one = F.concat(F.lit("product: P"), "p_partkey", F.lit("\n[reviews]\n"), (1 + F.col("p_size") % 5).cast("string"), F.lit("/5 "), "p_name", F.lit(" fits.\nby "), "p_type", F.lit(", 3 March 2024\n"))
    files = table(spark, d, "part").groupBy(F.col("p_brand").alias("file")).agg(F.array_join(F.collect_list(one), "\n").alias("text"))
    return manual.directive_blocks(files).select("file", "product", manual.review_block(F.col("body")).alias("r")).select("file", "product", "r.rating", "r.text", "r.author", "r.date")


@query("SELECT 'P' || p_partkey AS product, 'Is ' || p_name || ' good?' AS question, 'Yes, ' || p_type || '|No' AS answers FROM part")
def question_files(spark, d):
    one = F.concat(F.lit("Product: P"), "p_partkey", F.lit("\n[QA]\nQ: Is "), "p_name", F.lit(" good?\nA: Yes, "), "p_type", F.lit("\nAns. No\n"))
    files = table(spark, d, "part").groupBy(F.col("p_brand").alias("file")).agg(F.array_join(F.collect_list(one), "\n").alias("text"))
    q = manual.directive_blocks(files).where("kind = 'qa'").select("product", listings.question_block(F.col("body")).alias("q"))
    return q.select("product", "q.question", F.array_join("q.answers", "|").alias("answers"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 < 2 THEN (o_orderkey % 6)::double WHEN o_orderkey % 4 = 2 THEN (o_orderkey % 5) + 0.5 END AS rating FROM orders")
def ratings_parsed(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.concat((k % 6).cast("string"), F.lit(" out of 5"))).when(k % 4 == 1, (k % 6).cast("string")).when(k % 4 == 2, F.concat((k % 5).cast("string"), F.lit(".5/5"))).otherwise(F.concat(F.lit("rated "), k.cast("string")))
    return table(spark, d, "orders").select(k.alias("k"), T.rating(raw).alias("rating"))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN TIMESTAMP '2024-06-15 12:00:00' WHEN 1 THEN TIMESTAMP '2024-06-14 12:00:00' WHEN 2 THEN TIMESTAMP '2024-06-15 12:00:00' - to_days((o_orderkey % 30)::int) WHEN 3 THEN TIMESTAMP '2024-06-15 12:00:00' - to_hours((o_orderkey % 30)::int)
WHEN 7 THEN NULL ELSE o_orderdate::date END::varchar AS parsed FROM orders""")
def dates_parsed(spark, d):
    """Words, ages and four formats; nonsense is null."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    n = (k % 30).cast("string")
    raw = F.when(k % 8 == 0, "Just  now").when(k % 8 == 1, "Yesterday").when(k % 8 == 2, F.concat(F.lit("posted "), n, F.lit(" days ago"))).when(k % 8 == 3, F.concat(n, F.lit(" hours ago"))).when(k % 8 == 4, F.date_format(day, "d MMMM yyyy"))
    raw = raw.when(k % 8 == 5, F.concat(F.date_format(day, "MMM d, yyyy"), F.lit("."))).when(k % 8 == 6, F.date_format(day, "yyyy-MM-dd")).otherwise("on a day")
    return table(spark, d, "orders").select(k.alias("k"), F.date_format(T.parse_date(raw, F.lit("2024-06-15 12:00:00").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00' AS at FROM events")
def iso_times(spark, d):
    return table(spark, d, "events").select("event_id", store.iso(F.col("ts")).alias("at"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'http://a.org/x/' || page_id WHEN page_id % 3 = 1 THEN 'http://a.org/' || page_id || '?q=1' END AS url FROM pages")
def absolute_urls(spark, d):
    k = text("page_id")
    href = F.when(F.col("page_id") % 3 == 0, k).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/"), k, F.lit("?q=1"))).otherwise("")
    return table(spark, d, "pages").select("page_id", listings.absolute_url("http://a.org/x/y")(href).alias("url"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', ''), '([^/]+)/*$', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def slugs(spark, d):
    return table(spark, d, "pages").select("page_id", listings.slug(F.col("url")).alias("slug"))


@query("SELECT doc_id, md5(CASE WHEN trim(text) <> '' THEN trim(text) WHEN source <> '' THEN source END) AS content FROM documents")
def first_texts(spark, d):
    raw = F.to_json(F.struct(F.lit(" ").alias("text"), F.col("text").alias("body"), F.col("source").alias("comment")))
    return docs(spark, d).select("doc_id", F.md5(listings.first_text(raw)).alias("content"))


# Text helpers.


@query("SELECT doc_id, (length(text) - length(replace(text, chr(65533), ''))) / greatest(length(text), 1) AS share FROM documents")
def mojibake(spark, d):
    return docs(spark, d).select("doc_id", T.mojibake_share(F.col("text")).alias("share"))


CUT = r"""(CASE WHEN length(text) <= {n} THEN text WHEN NOT contains(left(text, {n} - 1), ' ') THEN left(text, {n}) WHEN regexp_extract(left(text, {n}), '(?s)^(.*) ', 1) = '' THEN left(text, 1) ELSE regexp_extract(left(text, {n}), '(?s)^(.*) ', 1) END)"""


@query(f"SELECT doc_id, md5({CUT.format(n=200)}) AS content, ceil(length(text) / 4)::bigint AS tokens FROM documents")
def token_cut(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.truncate_to_tokens(F.col("text"), 50)).alias("content"), T.estimate_tokens(F.col("text")).alias("tokens"))


FITTED = "r AS (SELECT doc_id, source, text, ceil(length('[' || doc_id || '] ' || text || chr(10)) / 4.0) > 80 AS cut, greatest(80 - ceil(length('[' || doc_id || '] ' || chr(10)) / 4.0)::int, 1) AS room FROM documents), fitted AS (SELECT doc_id, source, cut, CASE WHEN cut THEN " + CUT.replace("{n}", "(room * 4)") + " ELSE text END AS text FROM r)"


@query(f"WITH {FITTED} SELECT doc_id, md5(text) AS content, cut FROM fitted")
def fitted_documents(spark, d):
    fitted, cut = T.fit_document(F.col("doc_id"), F.col("text"), 80)
    return docs(spark, d).select("doc_id", F.md5(fitted).alias("content"), cut.alias("cut"))


@query(f"""WITH RECURSIVE {FITTED}, t AS MATERIALIZED (SELECT source, doc_id, cut, md5(text) AS content, ceil(length('[' || doc_id || '] ' || text || chr(10)) / 4.0)::bigint AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM fitted),
p AS (SELECT source, doc_id, cut, content, i, 0::bigint AS batch, 1 AS n, tokens AS used FROM t WHERE i = 1 UNION ALL
  SELECT t.source, t.doc_id, t.cut, t.content, t.i, CASE WHEN p.n >= 5 OR p.used + t.tokens > 300 THEN p.batch + 1 ELSE p.batch END, CASE WHEN p.n >= 5 OR p.used + t.tokens > 300 THEN 1 ELSE p.n + 1 END, CASE WHEN p.n >= 5 OR p.used + t.tokens > 300 THEN t.tokens ELSE p.used + t.tokens END FROM p JOIN t ON t.source = p.source AND t.i = p.i + 1)
SELECT source, doc_id, cut, content, batch FROM p""")
def fitted_batches(spark, d):
    """Requests of at most five documents and 300 tokens, with the texts that they carry."""
    rows = evaluation.fit_batches(docs(spark, d).select("doc_id", "source", "text"), by="source", order="doc_id", max_count=5, max_doc_tokens=80, input_budget=explorer.input_budget(500, 150, 80), overhead=explorer.overhead_tokens("x" * 200))
    return rows.select("source", "doc_id", "cut", F.md5("text").alias("content"), "batch")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents WHERE source NOT IN ('src0', 'src1') GROUP BY 1), b AS (SELECT greatest(0, 120 - (SELECT count(*) FROM documents WHERE source IN ('src0', 'src1'))) AS b),
e AS (SELECT *, least(b, sum(n) OVER ()) AS places, least(b, sum(n) OVER ())::double * n / sum(n) OVER () AS exact FROM c, b), r AS (SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, n DESC, source) AS rn, sum(floor(exact)) OVER () AS low FROM e),
a AS (SELECT source, least(floor(exact) + CASE WHEN rn <= places - low THEN 1 ELSE 0 END, n) AS take FROM r)
SELECT doc_id, source FROM documents WHERE source IN ('src0', 'src1') UNION ALL SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) AS rn FROM documents) JOIN a USING (source) WHERE rn <= take""")
def drawn_sample(spark, d):
    """Two sources whole, the others share what is left of 120."""
    return evaluation.draw_sample(docs(spark, d).select("doc_id", "source"), target=120, census=["src0", "src1"])


GOLD = """g AS (SELECT doc_id, 'a' AS dimension, 'q' || quality AS label FROM labels UNION ALL SELECT doc_id, 'b', 't' || toxic FROM labels), p AS (SELECT doc_id, 'a' AS dimension, 'q' || (n_chars >= 1000)::int AS label FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'b', 't0' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
f AS (SELECT dimension, label, count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE a IS NULL) AS fp, count(*) FILTER (WHERE b IS NULL) AS fn FROM (SELECT DISTINCT doc_id, dimension, label, true AS a FROM g) FULL JOIN (SELECT DISTINCT doc_id, dimension, label, true AS b FROM p) USING (doc_id, dimension, label) GROUP BY dimension, label),
s AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM f)"""


def _gold(spark, d):
    lab = table(spark, d, "labels")
    seen = docs(spark, d).join(lab.select("doc_id"), "doc_id", "left_semi")
    pair = lambda dim, c: F.struct(F.lit(dim).alias("dimension"), c.alias("label"))
    gold = lab.select("doc_id", F.inline(F.array(pair("a", F.concat(F.lit("q"), "quality")), pair("b", F.concat(F.lit("t"), "toxic")))))
    return gold, seen.select("doc_id", F.inline(F.array(pair("a", F.concat(F.lit("q"), (F.col("n_chars") >= 1000).cast("int"))), pair("b", F.lit("t0")))))


@query(f"WITH {GOLD} SELECT dimension, round(avg(f1), 6) AS macro_f1, count(*) AS n_labels, CASE WHEN dimension = 'a' THEN avg(f1) >= 0.65 END AS passes FROM s GROUP BY dimension UNION ALL SELECT NULL, round(avg(f1), 6), count(*), NULL FROM s")
def gold_by_dimension(spark, d):
    return evaluation.gold_scores(*_gold(spark, d), gated="a").withColumn("macro_f1", r6("macro_f1"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE quality = (n_chars >= 1000)::int) AS n_correct, round(count(*) FILTER (WHERE quality = (n_chars >= 1000)::int) / count(*), 6) AS accuracy FROM labels LEFT JOIN documents USING (doc_id)")
def intent_accuracy(spark, d):
    gold = table(spark, d, "labels").select("doc_id", text("quality").alias("intent_class"))
    pred = docs(spark, d).select("doc_id", (F.col("n_chars") >= 1000).cast("int").cast("string").alias("intent_class"))
    return evaluation.accuracy(gold, pred).withColumn("accuracy", r6("accuracy"))


@query(r"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE left(t, 119) || '…' END AS snippet FROM f")
def log_snippets(spark, d):
    return docs(spark, d).select("doc_id", T.safe_snippet(F.col("text")).alias("snippet"))


@query("SELECT DISTINCT p_type AS label, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS shown FROM part")
def pretty_labels(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("label")).distinct().select("label", T.pretty_label(F.replace(F.lower("label"), F.lit(" "), F.lit("_"))).alias("shown"))


@query("SELECT DISTINCT source, CASE source WHEN 'src0' THEN 'Play Store' WHEN 'src1' THEN 'ConsumerComplaints.in' ELSE upper(source[1]) || source[2:] END AS name FROM documents")
def source_display(spark, d):
    key = F.when(F.col("source") == "src0", "play_store").when(F.col("source") == "src1", "consumer_complaints_in").otherwise(F.col("source"))
    return docs(spark, d).select("source").distinct().select("source", explorer.source_display_name(key).alias("name"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN true WHEN user_id % 3 = 1 THEN false END AS said FROM events")
def booleans(spark, d):
    raw = F.when(F.col("user_id") % 6 == 0, " TRUE").when(F.col("user_id") % 3 == 0, "yes").when(F.col("user_id") % 6 == 1, "0").when(F.col("user_id") % 3 == 1, "No ").otherwise("maybe")
    return table(spark, d, "events").select("event_id", T.as_bool(raw).alias("said"))


COLLECTED_SQL = "text"
for _form, _by in (
    (r"\b[\w.+-]+@[\w-]+\.[\w.-]{2,}\b", "[email]"),
    (r"(?i)\b(order|awb|tracking|docket|invoice|ref|reference|complaint|ticket|txn|transaction|shipment)(\s*(?:id|no\.?|number|#)?\s*[:#\-]?\s*)([A-Za-z0-9][A-Za-z0-9/\-]{5,})", r"\1\2[id]"),
):
    COLLECTED_SQL = f"regexp_replace({COLLECTED_SQL}, '{_form}', '{_by}', 'g')"


@query(f"WITH a AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS text FROM documents) SELECT doc_id, md5({COLLECTED_SQL}) AS content FROM a WHERE NOT regexp_matches(text, '[0-9]{{10}}|@[A-Za-z0-9_.]{{3}}')")
def redact_incoming(spark, d):
    """Emails and labelled ids; patterns that look around are left to the hand-made tests, so texts that they touch stand aside here."""
    a = docs(spark, d).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "_")).where(~F.col("text").rlike(r"[0-9]{10}|@[A-Za-z0-9_.]{3}"))
    return a.select("doc_id", F.md5(T.redact_collected(F.col("text"))).alias("content"))


@query(f"SELECT doc_id, substr(sha256(array_to_string(regexp_extract_all('m 1 2 ' || doc_id || ' ' || {FLAT_SQL}, '[\\p{{L}}\\p{{N}}]+'), ' ')), 1, 16) AS key FROM documents")
def cache_keys(spark, d):
    return docs(spark, d).select("doc_id", S.cache_key(text("doc_id"), F.col("text"), "m", "1", "2").alias("key"))


# Tags, guards, report parts.


def _blobs(spark, d) -> DataFrame:
    """Tag blobs of orders: bad numbers at every thirteenth, evidence for every second label."""
    k = F.col("o_orderkey")
    span = F.struct(F.lit("fit").alias("tag"), F.when(k % 2 == 0, "it is tight").otherwise(" ").alias("quote"))
    body = F.struct(text("o_orderkey").alias("doc_id"), F.lit(True).alias("is_relevant"), F.array(F.lit("fit"), F.lit("price")).alias("blocker_type"), F.col("o_orderpriority").alias("intent_class"), F.when(k % 13 == 0, 9).otherwise(1 + k % 5).cast("int").alias("severity"), (10 * (k % 11)).cast("int").alias("confidence_pct"), F.array(span, F.struct(F.lit("price").alias("tag"), F.lit("dear").alias("quote"))).alias("evidence"))
    return table(spark, d, "orders").select(k.alias("doc_id"), "o_orderstatus", "o_custkey", F.to_json(body).alias("raw"))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 13 > 0 THEN 1 + o_orderkey % 5 END AS severity, CASE WHEN o_orderkey % 13 > 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'fit,price' ELSE 'price' END END AS blockers FROM orders")
def tag_blobs(spark, d):
    """Blobs parsed, written without their document, and parsed again; labels that no quote supports go."""
    again = tagging.parse_tags(tagging.tags_blob(tagging.parse_tags(F.col("raw"))))
    return _blobs(spark, d).select("doc_id", tagging.evidenced(again).alias("t")).select("doc_id", F.col("t.severity").cast("long").alias("severity"), F.array_join("t.blocker_type", ",").alias("blockers"))


@query("SELECT o_orderkey AS doc_id, 'blocker' AS dimension, unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['fit', 'price'] ELSE ['price'] END) AS label FROM orders")
def tag_envelopes(spark, d):
    """Envelopes of documents, parsed and exploded into membership rows."""
    pay = _blobs(spark, d).groupBy(F.col("doc_id") % 200).agg(F.concat(F.lit('{"documents": ['), F.array_join(F.collect_list("raw"), ", "), F.lit("]}")).alias("response"))
    rows = tagging.parse_response(pay.select("response"))
    return tags.explode_tags(rows.withColumn("doc_id", F.col("doc_id").cast("long")), {"blocker_type": "blocker"})


@query("WITH v AS (SELECT o_orderpriority AS version, count(*) AS n FROM orders GROUP BY 1) SELECT version, n, 'read' AS state FROM v WHERE version = (SELECT min(version) FROM v) UNION ALL SELECT 'all', count(*), 'mixed tag versions: ' || min(version) || ' and ' || max(version) FROM v HAVING count(*) > 1")
def one_tag_version(spark, d):
    """Tags of several versions are refused, those of one are read. Priorities of orders stand for the versions."""
    rows = _blobs(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("taxonomy_version")), "doc_id").withColumns({"prompt_version": F.lit("p"), "model": F.lit("m")})
    bounds = rows.agg(F.min("taxonomy_version").alias("lo"), F.max("taxonomy_version").alias("hi"), F.countDistinct("taxonomy_version").alias("n"))
    least = rows.join(F.broadcast(bounds.select(F.col("lo").alias("taxonomy_version"))), "taxonomy_version")
    read = tagging.one_version(least).groupBy(F.col("taxonomy_version").alias("version")).agg(F.count("*").alias("n")).withColumn("state", F.lit("read"))
    try:
        tagging.one_version(rows).agg(F.count("*")).collect()
        return read
    except PySparkException as refused:
        named = [v for v in re.findall(r'"taxonomy_version":"([^"]*)"', str(refused))[:2]]
        return read.unionByName(bounds.select(F.lit("all").alias("version"), "n", F.lit(f"mixed tag versions: {named[0]} and {named[1]}").alias("state")))


def _corpus(spark, d) -> DataFrame:
    own = docs(spark, d).select(F.col("doc_id"), "source", F.lit(None).cast("string").alias("url"), F.lit("2024-01-01").alias("created_utc"), T.word_count(F.col("text")).alias("word_count"), "text", (F.col("doc_id") % 4 > 0).alias("is_relevant"), F.when(F.col("doc_id") % 5 == 0, 0).alias("is_duplicate_of"))
    return own


@query("SELECT count(*) AS documents, count(*) FILTER (WHERE doc_id % 4 > 0 AND doc_id % 5 > 0) AS analyzable, (SELECT count(*) FROM documents WHERE doc_id % 4 > 0 AND doc_id % 5 > 0 AND doc_id IN (SELECT doc_id FROM labels)) AS tagged, (SELECT count(*) FROM labels WHERE quality = 1 AND doc_id % 4 > 0 AND doc_id % 5 > 0 AND doc_id IN (SELECT doc_id FROM documents)) AS genuine_intent FROM documents")
def corpus_facts(spark, d):
    lab = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "genuine_intent").otherwise("ambiguous").alias("intent_class"))
    return explorer.corpus_facts(_corpus(spark, d), lab)


@query(rf"""WITH t AS (SELECT doc_id, source, {WORDS_SQL} AS word_count, trim(regexp_replace({COLLECTED_SQL}, '\s+', ' ', 'g')) AS t FROM (SELECT doc_id, source, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') AS text FROM documents) WHERE doc_id % 4 > 0 AND doc_id % 5 > 0 AND NOT regexp_matches(text, '[0-9]{{10}}|@[A-Za-z0-9_.]{{3}}')),
h AS (SELECT *, regexp_replace(regexp_extract(left(t, 280), '^(.*)\s\S*$', 1), '[.,;:]+$', '') AS head FROM t)
SELECT h.doc_id, source, word_count, CASE WHEN o_orderkey % 13 > 0 THEN o_orderpriority ELSE '' END AS intent_class, CASE WHEN o_orderkey % 13 > 0 THEN 'fit, price' ELSE '' END AS blocker_type, CASE WHEN o_orderkey % 13 > 0 THEN (1 + o_orderkey % 5)::int END AS severity,
md5(CASE WHEN length(t) <= 280 THEN t ELSE CASE WHEN head = '' THEN left(t, 280) ELSE head END || '…' END) AS preview FROM h JOIN orders ON o_orderkey = doc_id""")
def tagged_documents(spark, d):
    plain = _corpus(spark, d).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "_")).where(~F.col("text").rlike(r"[0-9]{10}|@[A-Za-z0-9_.]{3}"))
    got = explorer.tagged_documents(plain.withColumn("word_count", T.word_count(F.col("text"))), _blobs(spark, d).select("doc_id", tagging.parse_tags(F.col("raw")).alias("tags")))
    return got.select("doc_id", "source", "word_count", "intent_class", "blocker_type", "severity", F.md5("preview").alias("preview"))


GROUPS = {"returns": ["R", "A"], "open": ["O"], "none": ["never"]}


@query(f"""WITH {MEM}, g AS (SELECT * FROM (VALUES ('returns', 'R', true, '`R`, `A`'), ('returns', 'A', false, '`R`, `A`'), ('open', 'O', true, '`O`'), ('none', 'never', true, '`never`')) v(name, label, cited, labels)),
x AS (SELECT name, labels, count(DISTINCT od.doc_id) AS n, min(CASE WHEN cited AND od.doc_id IS NOT NULL THEN struct_pack(s := source, d := od.doc_id) END) AS held FROM g LEFT JOIN mem USING (label) LEFT JOIN od ON od.doc_id = mem.doc_id GROUP BY ALL),
y AS (SELECT name, labels, n, (SELECT count(*) FROM od) AS total, coalesce(held, (SELECT min(struct_pack(s := source, d := doc_id)) FROM od)) AS spot FROM x)
SELECT name, n, total, spot.s AS source, spot.d AS doc_id, '**' || n || ' of ' || total || '** tagged documents carry ' || labels || ' (`' || spot.s || '` `' || spot.d || '`).' AS line FROM y""")
def label_shares(spark, d):
    return explorer.label_shares(members(spark, d), order_docs(spark, d), GROUPS)


@query("WITH s AS (" + SQL["label_shares"] + ") SELECT 'Of ' || max(total) || ' tagged documents, tag volumes are ' || string_agg(name || ' **' || n || '**', '; ' ORDER BY name) || '.' AS line FROM s")
def role_volumes(spark, d):
    return explorer.role_volumes(label_shares(spark, d))


@query("WITH s AS (" + SQL["label_shares"] + "), m AS (" + SQL["segment_matrix"] + ") SELECT '**' || n || ' of ' || total || '** tagged documents carry a segment cue. ' || (SELECT count(*) FROM m WHERE lift >= 1) || ' cell(s) of the segment matrix have a lift of 1 or more.' AS line FROM s WHERE name = 'open'")
def cued_line(spark, d):
    matrix = pairs(spark, d).where("dimension_b = 'segment'").withColumn("lift", r6("lift"))
    return explorer.cued_line(label_shares(spark, d).where("name = 'open'"), matrix, lift=1.0)


@query("SELECT segment, blocker, n_both, lift FROM (" + SQL["segment_matrix"] + ") WHERE lift >= 1.02")
def material_cells(spark, d):
    return reports.material_cells(pairs(spark, d).where("dimension_b = 'segment'").select(F.col("label_b").alias("segment"), F.col("label_a").alias("blocker"), "n_both", r6("lift").alias("lift")), lift=1.02)


@query("SELECT dimension_a, label_a, label_b, lift, row_number() OVER (ORDER BY lift DESC, dimension_a, label_a, dimension_b, label_b) AS place FROM (" + SQL["tag_pairs_lift"] + ")")
def lifts_in_order(spark, d):
    """The order of the lift file."""
    return tags.lift_order(pairs(spark, d).withColumn("lift", r6("lift"))).select("dimension_a", "label_a", "label_b", "lift", "place")


@query(f"WITH {MEM} SELECT label, count(DISTINCT doc_id) AS n FROM mem WHERE label IN ('R', 'A') GROUP BY label UNION ALL SELECT 'gone', 0 UNION ALL SELECT 'any', count(DISTINCT doc_id) FROM mem WHERE label IN ('R', 'A')")
def excluded_counts(spark, d):
    return reports.excluded_labels(members(spark, d), ["R", "A", "gone"])


@query("WITH o AS (" + SQL["opportunity_score"] + ") SELECT dimension, label, row_number() OVER (ORDER BY reportable DESC, post_only, score DESC, n_docs DESC, dimension, label) AS place FROM o WHERE dimension = 'blocker' AND reportable")
def ranked_view(spark, d):
    rows = quantify.filter_scores(opportunity_score(spark, d), dimensions=["blocker"], reportable_only=True)
    return quantify.rank_view(rows).select("dimension", "label", "place")


@query("WITH p AS (" + SQL["per_source_pivot"] + ") SELECT dimension, label FROM p WHERE prevalence_BUILDING > 0 AND dimension IN ('blocker', 'segment')")
def filtered_by_source(spark, d):
    from corpusloom.plans.catalog import per_source_pivot

    return quantify.filter_scores(per_source_pivot(spark, d), dimensions=["blocker", "segment"], sources=["BUILDING", "absent"]).select("dimension", "label")


@query("WITH o AS (" + SQL["opportunity_score"] + ") SELECT dimension, label, n_docs::varchar AS n_docs, format('{:.6f}', prevalence) AS prevalence, format('{:.2f}', score) AS score, CASE WHEN reportable THEN 'true' ELSE 'false' END AS reportable FROM o WHERE abs(score * 100 - floor(score * 100) - 0.5) > 0.001")
def typed_cells(spark, d):
    rows = opportunity_score(spark, d).where("abs(score * 100 - floor(score * 100) - 0.5) > 0.001")
    return quantify.typed_cells(rows.select("dimension", "label", "n_docs", "prevalence", "score", "reportable"), rates=["prevalence"], scores=["score"])


@query(f"WITH {MEM}, x AS (SELECT DISTINCT dimension, label FROM mem) SELECT dimension, label, 'blocker=other; free; ' || dimension || '=' || label AS back FROM x")
def parsed_members(spark, d):
    """Members as text, parsed; the row's own pair comes last."""
    own = members(spark, d).select("dimension", "label").distinct()
    got = quantify.parse_members(F.lit("blocker=other; blocker=other ; free;;"), F.col("dimension"), F.col("label"))
    shown = F.transform(got, lambda m: F.when(m["label"] == "free", m["label"]).otherwise(F.concat_ws("=", m["dimension"], m["label"])))
    return own.select("dimension", "label", F.array_join(shown, "; ").alias("back"))


@query(f"WITH {MEM}, m AS (SELECT label_a AS blocker, label_b AS segment, lift FROM ({SQL['tag_pairs_lift']}) WHERE dimension_b = 'segment') SELECT row_number() OVER (ORDER BY label) AS rank, segment, lift FROM (SELECT DISTINCT label FROM mem WHERE dimension = 'blocker') JOIN m ON blocker = label WHERE lift >= 1".replace("SELECT row_number() OVER (ORDER BY label) AS rank, segment, lift FROM (SELECT DISTINCT label FROM mem WHERE dimension = 'blocker')", "SELECT rank, segment, lift FROM (SELECT label, row_number() OVER (ORDER BY label) AS rank FROM (SELECT DISTINCT label FROM mem WHERE dimension = 'blocker'))"))
def segment_hits(spark, d):
    from pyspark.sql import Window

    rows = members(spark, d).where("dimension = 'blocker'").select("label").distinct().withColumn("rank", F.row_number().over(Window.orderBy("label")).cast("long")).select("rank", F.array(F.upper("label")).alias("members"))
    matrix = pairs(spark, d).where("dimension_b = 'segment'").select(F.col("label_a").alias("blocker"), F.col("label_b").alias("segment"), r6("lift").alias("lift"))
    return tagging.segment_hits(rows, matrix, lift=1.0)


@query(f"WITH {MEM} SELECT '[' || string_agg('{{\"dimension\":\"' || dimension || '\",\"label\":\"' || label || '\",\"n\":' || n || '}}', ',' ORDER BY dimension, label) || ']' AS snapshot FROM (SELECT dimension, label, count(*) AS n FROM mem GROUP BY ALL)")
def report_snapshot(spark, d):
    return tagging.snapshot(members(spark, d).groupBy("dimension", "label").agg(F.count("*").alias("n")), ["dimension", "label", "n"])


@query("SELECT theme, source, doc_id::varchar AS doc_id, regexp_replace(quote, '\\s+', ' ', 'g') AS text FROM (" + SQL["select_quotes"] + ") WHERE trim(quote) <> ''")
def appendix(spark, d):
    """Selected quotes as the lines of an appendix, read back."""
    from corpusloom.plans.catalog import select_quotes

    lines = evidence.appendix_lines(select_quotes(spark, d).where("trim(quote) <> ''").withColumn("url", F.when(F.col("doc_id") % 2 == 0, "http://u.org/1")))
    head = lines.select("theme").distinct().select("theme", F.lit(0).alias("place"), F.concat(F.lit("## "), "theme").alias("line"))
    end = spark.createDataFrame([("~", 0, "# Pipeline run log"), ("~", 1, "- **x** `1`: after the end")], "theme string, place int, line string")
    from pyspark.sql import Window

    file = lines.unionByName(head).unionByName(end).withColumn("pos", F.row_number().over(Window.orderBy("theme", "place"))).select("pos", "line")
    return listings.read_appendix(file).select("theme", "source", "doc_id", "text")


@query(f"""WITH {SPAN_SQL}, g AS (SELECT doc_id, dimension, label, NOT ({NORM('quote')} <> '' AND contains({NORM('text')}, {NORM('quote')})) AS bad FROM sp) SELECT doc_id, 'of' AS label, coalesce(bool_or(bad) FILTER (WHERE label = 'of'), true) AS is_flagged FROM g GROUP BY doc_id""")
def document_flags(spark, d):
    """Documents whose label no span supports are flagged."""
    spans = _spans(spark, d).drop("source")
    flagged = evidence.flags(spans, docs(spark, d), {})
    return evidence.document_flags(docs(spark, d).select("doc_id", F.lit("of").alias("label")), flagged)


@query(f"WITH {SPAN_SQL} SELECT doc_id, 'c' AS cluster, quote FROM sp WHERE label = 'und' AND {NORM('quote')} <> '' AND contains({NORM('text')}, {NORM('quote')})")
def unflagged_quotes(spark, d):
    """Of a cluster of two labels the second alone has spans."""
    spans = _spans(spark, d).select("doc_id", "dimension", "label", "quote")
    flagged = evidence.document_flags(spans.select("doc_id", "label"), evidence.flags(spans, docs(spark, d), {}))
    places = spark.createDataFrame([("c", "never", 0), ("c", "und", 1)], "cluster string, label string, place int")
    return explorer.unflagged_quotes(spans.withColumn("pos", F.lit(0)), flagged, places)


@query("""WITH s AS (SELECT source, count(*) AS documents, count(*) FILTER (WHERE doc_id % 4 > 0 AND doc_id % 5 > 0) AS analyzable FROM documents GROUP BY source)
SELECT 0 AS pos, format('**{} documents** in the corpus, **{} analyzable** (relevant, not a duplicate).', sum(documents)::bigint, sum(analyzable)::bigint) AS line FROM s UNION ALL SELECT 1, format('| `{}` | {} | {} |', source, documents, analyzable) FROM s
UNION ALL SELECT 2, 'Analyzable source mix: ' || string_agg(format('`{}` {:.0f}%', source, analyzable * 100.0::double / (SELECT sum(analyzable) FROM s)), ', ' ORDER BY source) || '.' FROM s WHERE analyzable > 0""")
def corpus_summary(spark, d):
    n = _corpus(spark, d).groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.expr("is_relevant and is_duplicate_of is null")).alias("analyzable"))
    return explorer.corpus_summary(n)


@query(f"""WITH f AS ({_score_sql("")} SELECT * FROM s), g AS ({_score_sql("o_orderstatus = 'F'")} SELECT dimension, label, n AS genuine_n FROM s)
SELECT dimension, label, '- opportunity score: ' || printf('%.2f', round(score, 2)) || chr(10) || '- prevalence: ' || printf('%.1f%%', round(p * 100, 1)) || ' (' || printf('%.1f%%', round(greatest(0, mid - half) * 100, 1)) || ' to ' || printf('%.1f%%', round(least(1, mid + half) * 100, 1)) || ')' || chr(10)
  || '- supporting documents: ' || n::bigint || chr(10) || '- distinct authors: ' || n_authors || chr(10) || '- of genuine intent: ' || coalesce(genuine_n, 0)::bigint
  || CASE WHEN post_only THEN chr(10) || '- after the purchase only' ELSE '' END || CASE WHEN n < 20 OR n_authors < 3 THEN chr(10) || '- low confidence' ELSE '' END AS lines FROM f LEFT JOIN g USING (dimension, label)""")
def opportunity_areas(spark, d):
    rows = _genuine(spark, d)
    shown = {c: F.round(c, n) for c, n in (("score", 2), ("prevalence", 3), ("low", 3), ("high", 3))}
    return explorer.opportunity_lines(rows.withColumns(shown)).select("dimension", "label", "lines")


@query("WITH t AS (" + SQL["topk_cooccur"] + "), s AS (" + SQL["opportunity_score"] + ") SELECT s.dimension, s.label, n_docs, top AS co_occurs_with, NULL::varchar AS notes FROM s LEFT JOIN t ON s.dimension = dimension_a AND s.label = label_a")
def score_columns(spark, d):
    """The columns of a score table in their order; of what no row has only the name is there."""
    top = topk_cooccur(spark, d).select(F.col("dimension_a").alias("dimension"), F.col("label_a").alias("label"), F.col("top").alias("co_occurs_with"))
    rows = opportunity_score(spark, d).join(top, ["dimension", "label"], "left").withColumns({"supporting_doc_ids": F.lit("1;2"), "_x": F.lit(1)})
    return explorer.score_table(explorer.compact_rows(rows), ["dimension", "label", "n_docs", "co_occurs_with", "notes"])


@query(f"WITH {MEM} SELECT dimension, label, count(DISTINCT author) / (SELECT count(DISTINCT author)::double FROM od) AS author_prevalence, avg(severity) / 5 AS severity_norm FROM mem JOIN od USING (doc_id) GROUP BY ALL")
def opportunity_shares(spark, d):
    return tags.opportunities(order_docs(spark, d), members(spark, d)).select("dimension", "label", "author_prevalence", "severity_norm")


@query("SELECT 'prevalence_' || source AS column_name, source AS name FROM (SELECT DISTINCT c_mktsegment AS source FROM customer)")
def source_columns(spark, d):
    from corpusloom.plans.catalog import per_source_pivot

    names = explorer.source_names([*per_source_pivot(spark, d).columns, "prevalence_lo", "prevalence_norm"])
    return spark.createDataFrame([(f"prevalence_{s}", s) for s in names], "column_name string, name string")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id + 1 ELSE 56 END AS tokens FROM events")
def reported_tokens(spark, d):
    return table(spark, d, "events").select("event_id", explorer.usage_tokens(F.when(F.col("event_id") % 3 == 0, text("event_id") .cast("long") + 1).when(F.col("event_id") % 3 == 1, F.lit(0).cast("long")), F.lit(56)).alias("tokens"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE n_chars >= 1000) AS n_surviving, round(count(*) FILTER (WHERE n_chars >= 1000) / count(*), 6) AS rate, count(*) FILTER (WHERE n_chars >= 1000) >= 50 AS passes FROM documents WHERE lang = 'en'")
def floor_check(spark, d):
    return evaluation.floor_gate(docs(spark, d), wanted=F.col("lang") == "en", survives=F.col("n_chars") >= 1000, floor=50).withColumn("rate", r6("rate"))


@query("SELECT 'again' AS pass, count(*) AS n, true AS same FROM documents UNION ALL SELECT 'one text changed', count(*), false FROM documents UNION ALL SELECT 'one row lost', count(*) - 1, false FROM documents")
def reproduced(spark, d):
    """A pass dealt out otherwise agrees with the first; one with a changed text or without a row does not."""
    rows = docs(spark, d).select("doc_id", T.norm(F.col("text")).alias("t"))
    one = F.col("doc_id") == rows.agg(F.max("doc_id")).first()[0]
    first = evaluation.fingerprint_of(rows.repartition("doc_id"))
    again = rows.repartitionByRange("doc_id")
    passes = {"again": again, "one text changed": rows.withColumn("t", F.when(one, F.concat("t", F.lit("."))).otherwise(F.col("t"))), "one row lost": rows.where(~one)}
    found = {name: evaluation.fingerprint_of(df) for name, df in passes.items()}
    return spark.createDataFrame([(name, x[0], x == first) for name, x in found.items()], "pass string, n long, same boolean")


@query("SELECT doc_id, 'label' AS label FROM labels WHERE doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM documents)")
def gold_complete(spark, d):
    gold = table(spark, d, "labels").where("doc_id % 2 = 0").select("doc_id", F.lit("label").alias("label")).join(docs(spark, d).select("doc_id"), "doc_id", "left_semi")
    return evaluation.complete_or_fail(gold, docs(spark, d))


@query("SELECT doc_id, array_to_string(list_filter(['toxic', 'short'], lambda l: (l = 'toxic' AND regexp_matches(lower(text), 'idiot|trash')) OR (l = 'short' AND contains(lower(text), ' it '))), ',') AS labels FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def offline_tags(spark, d):
    """Cache misses are tagged by cues."""
    got = evaluation.tag_with(docs(spark, d), evaluation.cue_tagger({"toxic": ["idiot", "trash"], "short": [" it "]}), table(spark, d, "labels"))
    return got.select("doc_id", F.array_join(F.reverse(F.array_sort("labels")), ",").alias("labels"))


# Streams.


def _stream(spark, d) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_upserts(spark, d):
    """The last event of each user by a stream of batches."""
    path = scratch(spark, "upserts")
    stream.upsert_batches(_stream(spark, d).select("user_id", "event_id", "event_type"), f"{path}/t", ["user_id"], f"{path}/ck", order=("event_id",))
    return stream.read_upserted(spark, f"{path}/t", ["user_id"])


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_first_seen(spark, d):
    """Each key once within the watermark, of a stream that is worked off in one run."""
    path = scratch(spark, "first-seen")
    stream.run_once(stream.first_seen(_stream(spark, d), ["user_id", "event_type"], late="400 days").select("user_id", "event_type"), f"{path}/t", f"{path}/ck")
    stream.run_once(stream.first_seen(_stream(spark, d), ["user_id", "event_type"], late="400 days").select("user_id", "event_type"), f"{path}/t", f"{path}/ck")
    return spark.read.parquet(f"{path}/t").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, strftime(least(ts, TIMESTAMP '2024-01-03 00:00:00'), '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def clamped_times(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("2024-01-03 00:00:00").cast("timestamp").alias("seen"))
    return stream.clamp_future(e, "ts", "seen").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


# Robots rules, schemas, the profile by source and stage.


def _site(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


#: Each site's rules are made from its pages: sections and endings that are shut, pages that are open.
ROBOTS_SQL = f"""p AS (SELECT page_id, url, {_site("url")} AS domain, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '#.*$', '') AS rest FROM pages),
q AS (SELECT *, CASE WHEN rest LIKE '/%' THEN rest ELSE '/' || rest END AS path FROM p),
rules AS (SELECT DISTINCT domain, allow, form FROM (SELECT domain, unnest([{{'n': 7, 'allow': false, 'form': regexp_extract(path, '^/[^/]*/?')}}, {{'n': 5, 'allow': true, 'form': path}}, {{'n': 3, 'allow': false, 'form': '/*.html$'}}, {{'n': 4, 'allow': false, 'form': '/*/*?utm_'}}]) AS r, page_id FROM q), (SELECT 1), LATERAL (SELECT r.allow AS allow, r.form AS form, r.n AS n) WHERE page_id % n = 0),
sites AS (SELECT DISTINCT domain, CASE length(domain) % 7 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN NULL ELSE 200 END AS status FROM p),
hits AS (SELECT url, allow, length(form) AS n FROM q JOIN rules USING (domain) WHERE regexp_matches(path, '^' || replace(replace(replace(form, '.', '[.]'), '?', '[?]'), '*', '.*'))),
best AS (SELECT url, arg_max(allow, n * 2 + allow::int) AS allow FROM hits GROUP BY url)"""


@query(f"WITH {ROBOTS_SQL} SELECT DISTINCT url, domain, coalesce(status = 404 OR status = 200 AND coalesce(allow, true), false) AS allowed, CASE WHEN status = 404 THEN 'absent' WHEN status = 200 THEN CASE WHEN coalesce(allow, true) THEN 'allowed' ELSE 'disallowed' END ELSE 'unavailable' END AS reason FROM q JOIN sites USING (domain) LEFT JOIN best USING (url)")
def robots_decisions(spark, d):
    """Which pages a crawler may fetch, under rules made from the pages of each site."""
    pages = table(spark, d, "pages").select("page_id", "url", robots.domain_of(F.col("url")).alias("domain"), robots.path_of(F.col("url")).alias("path"))
    rule = lambda n, allow, form: F.when(F.col("page_id") % n == 0, F.struct(F.lit("*").alias("agent"), F.lit(allow).alias("allow"), form.alias("path")))
    made = F.array(rule(7, False, F.regexp_extract("path", r"^/[^/]*/?", 0)), rule(5, True, F.col("path")), rule(3, False, F.lit("/*.html$")), rule(4, False, F.lit("/*/*?utm_")))
    rules = pages.select("domain", F.explode(F.array_compact(made)).alias("r")).select("domain", "r.*").distinct()
    size = F.char_length("domain") % 7
    sites = pages.select("domain").distinct().withColumn("status", F.when(size == 0, 404).when(size == 1, 503).when(size != 2, 200))
    return robots.decide(pages, sites, rules, user_agent="loom/1.0")


@query("""SELECT o_orderkey AS schema_id, unnest(CASE o_orderkey % 4 WHEN 0 THEN ['$ open object', '$.properties.tag unsupported keyword minLength'] WHEN 1 THEN ['$ not required tag'] WHEN 2 THEN ['$.properties.list.items mixed enum', '$ no such property ' || o_orderstatus] ELSE ['$.$defs.' || o_orderstatus || ' open object'] END) AS problem FROM orders""")
def schema_problems(spark, d):
    """A schema for each order, each with faults of its own."""
    k, status = F.col("o_orderkey") % 4, F.col("o_orderstatus")
    text = '{"type": "string"}'
    body = (
        F.when(k == 0, '{"type": "object", "properties": {"tag": {"type": "string", "minLength": 1}}, "required": ["tag"]}')
        .when(k == 1, '{"type": "object", "properties": {"tag": %s}, "required": [], "additionalProperties": false}' % text)
        .when(k == 2, F.concat(F.lit('{"type": "object", "properties": {"list": {"type": "array", "items": {"enum": [1, 0.5]}}}, "required": ["list", "'), status, F.lit('"], "additionalProperties": false}')))
        .otherwise(F.concat(F.lit('{"anyOf": [%s], "$defs": {"' % text), status, F.lit('": {"type": "object", "properties": {}, "additionalProperties": %s}}}' % text)))
    )
    found = tagging.schema_violations(table(spark, d, "orders").select(F.col("o_orderkey").alias("schema_id"), body.alias("schema")))
    return found.select("schema_id", F.concat_ws(" ", "path", "problem", "name").alias("problem"))


STAGE_SQL = "['pre_purchase', 'post_purchase', 'mixed'][1 + substr(source, 4)::int % 3]"


@query(f"""WITH x AS (SELECT *, min(doc_id) OVER (PARTITION BY md5({FLAT_SQL})) AS root, {REASON_SQL} AS reason, {HITS_SQL} AS hits, {STAGE_SQL} AS stage FROM documents),
b AS (SELECT source, stage, reason IS NOT NULL AS out, root <> doc_id AS dup, CASE WHEN reason IS NOT NULL THEN false WHEN root = doc_id THEN hits > 0 END AS relevant FROM x)
SELECT source, stage, count(*) AS documents, count(*) FILTER (WHERE coalesce(relevant, false) AND NOT dup) AS analyzable, count(*) FILTER (WHERE out) AS excluded, count(*) FILTER (WHERE dup) AS duplicates,
count(*) FILTER (WHERE NOT out AND NOT dup AND NOT relevant) AS triaged, count(*) FILTER (WHERE coalesce(relevant, false)) AS relevant, count(*) FILTER (WHERE coalesce(relevant, false) AND NOT dup AND source <> 'src0') AS analyzable_apart
FROM b GROUP BY GROUPING SETS ((source), (stage), ())""")
def profile_sets(spark, d):
    """Counts by source, by stage and of all, in one pass; exact copies stand for duplicates."""
    own = docs(spark, d).select("doc_id", "source", "text", _reason().alias("exclusion_reason"), T.keyword_hits(F.col("text"), TERMS).alias("hits"))
    built = corpus.with_roots(own).withColumn("is_duplicate_of", F.when(F.col("root") != F.col("doc_id"), F.col("root")))
    verdict = F.when(F.col("exclusion_reason").isNotNull(), False).when(F.col("is_duplicate_of").isNull(), F.col("hits") > 0)
    stage = corpus.purchase_stage(F.col("source"), F.lit(None).cast("string"), stages=STAGE_OF, refined=())
    return corpus.profile_sets(built.withColumn("is_relevant", verdict).withColumn("stage", stage), apart="src0")


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id::varchar) <= 30 AS own, 1 + (doc_id % 3 = 0)::int AS n FROM documents)
SELECT source, DATE '2024-01-05' AS run_date, 'complete' AS status, count(*) AS record_count, sum(n - 1)::bigint AS duplicates_skipped FROM r WHERE own GROUP BY source""")
def raw_parts(spark, d):
    """Records and copies of every third, of each source at most thirty, in parts of seven; what the manifest says of the run."""
    folder = scratch(spark, "parts")
    all_ = _raw(spark, d).unionByName(_raw(spark, d).where("source_native_id % 3 = 0"))
    parts.write_parts(all_, folder, max_records=30, max_part_records=7)
    return parts.read_manifests(spark, folder).select("source", "run_date", "status", "record_count", "duplicates_skipped")


@query(f"""WITH RECURSIVE q AS (SELECT page_id, {_site("url")} AS domain, page_id // 4 AS came, row_number() OVER (PARTITION BY {_site("url")} ORDER BY page_id) AS i FROM pages),
r AS (SELECT page_id, domain, i, came AS starts FROM q WHERE i = 1 UNION ALL SELECT q.page_id, q.domain, q.i, greatest(q.came, r.starts + 3) FROM r JOIN q ON q.domain = r.domain AND q.i = r.i + 1)
SELECT page_id, domain, starts FROM r""")
def paced_requests(spark, d):
    """When each page may be asked for: four arrive a second, those of one host are three seconds apart."""
    pages = table(spark, d, "pages").select("page_id", robots.domain_of(F.col("url")).alias("domain"), F.floor(F.col("page_id") / 4).alias("at"))
    return ordered.paced(pages, by="domain", order=["page_id"], at="at", gap=3).select("page_id", "domain", "starts")
