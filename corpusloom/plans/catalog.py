"""Queries over the driver's tables, and the SQL that gives the same rows.

Orders stand for documents: the customer is the author, the market segment the source, the brands, return flags and line states of the lines are
labels. Documents, conversations, pages and events stand for themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import languages
from corpusloom.functions import scoring as S
from corpusloom.functions import text as T
from corpusloom.operators import corpus, evaluation, evidence, reports, tags
from corpusloom.sources import html as H
from corpusloom.sources.tables import checkpointed, spread, table
from corpusloom.streaming import stream

TERMS = ["the", "la", "der", "tion", "idiot"]
LIFT_PAIRS = [("blocker", "uncertainty"), ("blocker", "segment")]
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


def members(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, dimension, label) of orders, each once: lines meet by order before their labels are exploded, so nothing is shuffled again by order."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    labels = [F.struct(F.lit(dim).alias("dimension"), F.col(c).alias("label")) for dim, c in (("blocker", "p_brand"), ("uncertainty", "l_returnflag"), ("segment", "l_linestatus"))]
    rows = line.join(part, line.l_partkey == part.p_partkey).repartition("l_orderkey").select(F.col("l_orderkey").alias("doc_id"), F.explode(F.array(*labels)).alias("x"))
    return rows.select("doc_id", "x.dimension", "x.label").where("label is not null").distinct()


def order_docs(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    key = F.col("o_orderkey")
    stage = F.when(F.col("o_orderstatus") == "F", "post").when(F.col("o_orderstatus") == "O", "pre").otherwise("mixed")
    return o.join(c, o.o_custkey == c.c_custkey).select(key.alias("doc_id"), F.col("o_custkey").alias("author"), F.col("c_mktsegment").alias("source"), F.col("o_orderdate").alias("created"), (1 + key % 5).alias("severity"), (key % 2).alias("actionability"), (10 * (key % 11)).alias("confidence"), (F.col("o_orderstatus") == "F").alias("genuine"), stage.alias("stage"))


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents on all cores: their expressions are heavy, and the small tables are one row group each."""
    return spread(table(spark, d, "documents"))


MEM = """mem AS (
  SELECT DISTINCT doc_id, dimension, label FROM (
    SELECT l_orderkey AS doc_id, 'blocker' AS dimension, p_brand AS label FROM lineitem JOIN part ON l_partkey = p_partkey
    UNION ALL SELECT l_orderkey, 'uncertainty', l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey
    UNION ALL SELECT l_orderkey, 'segment', l_linestatus FROM lineitem JOIN part ON l_partkey = p_partkey)
), od AS (
  SELECT o_orderkey AS doc_id, o_custkey AS author, c_mktsegment AS source, o_orderdate AS created, 1 + o_orderkey % 5 AS severity, o_orderkey % 2 AS actionability,
         10 * (o_orderkey % 11) AS confidence, o_orderstatus = 'F' AS genuine, CASE o_orderstatus WHEN 'F' THEN 'post' WHEN 'O' THEN 'pre' ELSE 'mixed' END AS stage
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
WILSON = """(n / total) AS p, ((n/total + 1.96*1.96/(2*total)) / (1 + 1.96*1.96/total)) AS mid,
  (1.96 * sqrt((n/total) * (1 - n/total) / total + 1.96*1.96/(4.0*total*total)) / (1 + 1.96*1.96/total)) AS half"""


@query(f"""WITH {MEM}, c AS (SELECT dimension, label, count(*)::double AS n FROM mem GROUP BY ALL), t AS (SELECT count(*)::double AS total FROM orders),
w AS (SELECT *, {WILSON} FROM c, t)
SELECT dimension, label, n::bigint AS n_docs, round(p, 6) AS prevalence, round(greatest(0, mid - half), 6) AS low, round(least(1, mid + half), 6) AS high, n < 20 AS low_confidence FROM w""")
def prevalence_wilson(spark, d):
    total = table(spark, d, "orders").agg(F.count("*").alias("total"))
    p = tags.prevalence(members(spark, d), total)
    return p.select("dimension", "label", "n_docs", r6("prevalence").alias("prevalence"), r6("low").alias("low"), r6("high").alias("high"), "low_confidence")


PAIR_SQL = f"""WITH {MEM}, n AS (SELECT dimension, label, count(*) AS n FROM mem GROUP BY ALL), seen AS (
  SELECT a.dimension AS dimension_a, a.label AS label_a, b.dimension AS dimension_b, b.label AS label_b, count(*) AS n_both
  FROM mem a JOIN mem b ON a.doc_id = b.doc_id AND a.dimension = 'blocker' AND b.dimension IN ('uncertainty', 'segment') GROUP BY ALL),
x AS (SELECT seen.*, x.n AS n_a, y.n AS n_b, n_both::double * (SELECT count(*) FROM orders) / (x.n * y.n) AS lift, n_both::double / (x.n + y.n - n_both) AS jaccard
  FROM seen JOIN n x ON x.dimension = dimension_a AND x.label = label_a JOIN n y ON y.dimension = dimension_b AND y.label = label_b)"""


def pairs(spark, d):
    return tags.cooccurrence(members(spark, d), LIFT_PAIRS, table(spark, d, "orders").agg(F.count("*").alias("total")))


@query(PAIR_SQL + " SELECT dimension_a, label_a, dimension_b, label_b, n_both, n_a, n_b, round(lift, 6) AS lift, round(jaccard, 6) AS jaccard FROM x")
def tag_pairs_lift(spark, d):
    return pairs(spark, d).withColumn("lift", r6("lift")).withColumn("jaccard", r6("jaccard"))


@query(PAIR_SQL + " SELECT label_b AS segment, label_a AS blocker, n_both, round(lift, 6) AS lift FROM x WHERE dimension_b = 'segment'")
def segment_matrix(spark, d):
    return pairs(spark, d).where("dimension_b = 'segment'").select(F.col("label_b").alias("segment"), F.col("label_a").alias("blocker"), "n_both", r6("lift").alias("lift"))


@query(PAIR_SQL + ", k AS (SELECT *, row_number() OVER (PARTITION BY label_a ORDER BY n_both DESC, dimension_b, label_b) AS rn FROM x) SELECT dimension_a, label_a, string_agg(label_b || ' (' || n_both || ')', '; ' ORDER BY rn) AS top FROM k WHERE rn <= 3 GROUP BY ALL")
def topk_cooccur(spark, d):
    return tags.top_cooccurring(pairs(spark, d))


@query(PAIR_SQL + " SELECT 'blocker=' || label_a AS a, dimension_b || '=' || label_b AS b FROM x WHERE jaccard >= 0.1")
def jaccard_edges(spark, d):
    p = pairs(spark, d).where("jaccard >= 0.1")
    return p.select(F.concat_ws("=", "dimension_a", "label_a").alias("a"), F.concat_ws("=", "dimension_b", "label_b").alias("b"))


@query("WITH RECURSIVE " + PAIR_SQL.removeprefix("WITH ") + """, e AS (SELECT 'blocker=' || label_a AS a, dimension_b || '=' || label_b AS b FROM x WHERE jaccard >= 0.1),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT dimension || '=' || label AS node, dimension || '=' || label AS reach FROM n UNION SELECT r.node, s.b FROM r JOIN s ON r.reach = s.a),
root AS (SELECT node, min(reach) AS root FROM r GROUP BY node), z AS (SELECT n.*, root.root, CASE dimension WHEN 'blocker' THEN 0 WHEN 'uncertainty' THEN 1 ELSE 4 END AS pr FROM n JOIN root ON node = dimension || '=' || label)
SELECT dimension, label, first_value(dimension || '=' || label) OVER (PARTITION BY root ORDER BY pr, n DESC, label) AS cluster FROM z""")
def tag_clusters(spark, d):
    return tags.clusters(members(spark, d), jaccard_edges(spark, d))


RECENCY = f"""{MEM}, rec AS (SELECT od.*, CASE WHEN created >= mx THEN 1.0 ELSE pow(0.5, (epoch_us(mx) - epoch_us(created)) / 86400e6 / 365.0) END AS recency FROM od, (SELECT max(created) AS mx FROM od)),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY recency DESC, doc_id) AS rn FROM rec) WHERE rn <= 5)"""


@query(f"WITH {RECENCY} SELECT doc_id, round(recency, 6) AS recency FROM rec")
def recency_weight(spark, d):
    return tags.with_recency(order_docs(spark, d)).select("doc_id", r6("recency").alias("recency"))


@query(f"WITH {RECENCY} SELECT doc_id, author::varchar AS voice FROM kept")
def voice_cap(spark, d):
    return tags.capped(tags.with_recency(order_docs(spark, d))).select("doc_id", "voice")


SHARE = f"""{RECENCY}, whole AS (SELECT author, sum(recency) AS whole FROM kept GROUP BY author), own AS (SELECT dimension, label, author, sum(recency) AS tagged FROM mem JOIN kept USING (doc_id) GROUP BY ALL),
share AS (SELECT dimension, label, sum(tagged / whole) / (SELECT count(*) FROM whole) AS share FROM own JOIN whole USING (author) GROUP BY ALL)"""


@query(f"WITH {SHARE} SELECT dimension, label, round(share, 6) AS share FROM share")
def author_share(spark, d):
    return tags.author_share(tags.with_recency(order_docs(spark, d)), members(spark, d)).select("dimension", "label", r6("share").alias("share"))


def _score_sql(where: str) -> str:
    ctes = f"WITH {SHARE}"
    if where:
        ctes = ctes.replace("FROM orders JOIN customer ON o_custkey = c_custkey\n", f"FROM orders JOIN customer ON o_custkey = c_custkey WHERE {where}\n")
    return f"""{ctes}, t AS (SELECT count(*)::double AS total, count(DISTINCT source)::double AS st FROM od),
st AS (SELECT dimension, label, count(*)::double AS n, avg(severity) AS sev, avg(actionability) AS act, avg(confidence) AS conf, count(DISTINCT author) AS n_authors, count(DISTINCT source) AS n_sources,
  count(*) FILTER (WHERE stage = 'pre') AS n_pre, count(*) FILTER (WHERE stage = 'post') AS n_post, count(*) FILTER (WHERE stage = 'mixed') AS n_mixed FROM mem JOIN od USING (doc_id) GROUP BY ALL),
w AS (SELECT st.*, share, total, t.st AS sources_total, {WILSON} FROM st JOIN share USING (dimension, label), t),
e AS (SELECT *, conf / 100 * (n_sources / sources_total) * least(1, greatest(0, mid - half) / p) AS evidence, CASE WHEN max(share) OVER () = min(share) OVER () THEN 1 ELSE (share - min(share) OVER ()) / (max(share) OVER () - min(share) OVER ()) END AS share_norm FROM w),
s AS (SELECT *, sqrt(share_norm) * (sev / 5) * act * evidence * 100 AS score, n_authors >= 3 AS reportable, n_pre = 0 AS post_only FROM e)"""


@query(_score_sql("") + """ SELECT dimension, label, n::bigint AS n_docs, n_authors, n_sources, n_pre, n_post, n_mixed, round(p, 6) AS prevalence, round(share, 6) AS share, round(evidence, 6) AS evidence, round(score, 5) AS score, reportable, post_only,
row_number() OVER (ORDER BY reportable DESC, post_only, score DESC, n DESC, dimension, label) AS rank FROM s""")
def opportunity_score(spark, d):
    rows = tags.opportunities(order_docs(spark, d), members(spark, d))
    return rows.select("dimension", "label", "n_docs", "n_authors", "n_sources", "n_pre", "n_post", "n_mixed", r6("prevalence").alias("prevalence"), r6("share").alias("share"), r6("evidence").alias("evidence"), F.round("score", 5).alias("score"), "reportable", "post_only", F.col("rank").cast("long"))


def _genuine(spark, d):
    rows = tags.tagged(order_docs(spark, d), members(spark, d))
    return tags.attach_genuine(tags.opportunities_of(rows), tags.opportunities_of(rows.where("genuine")))


@query(f"""WITH f AS ({_score_sql("")} SELECT *, row_number() OVER (ORDER BY reportable DESC, post_only, score DESC, n DESC, dimension, label) AS rank FROM s),
g AS ({_score_sql("o_orderstatus = 'F'")} SELECT *, row_number() OVER (ORDER BY reportable DESC, post_only, score DESC, n DESC, dimension, label) AS rank FROM s)
SELECT dimension, label, f.n::bigint AS n_docs, coalesce(g.n, 0)::bigint AS genuine_n, round(f.score, 5) AS score, round(coalesce(g.score, 0), 5) AS genuine_score, f.rank, g.rank AS genuine_rank, f.rank - g.rank AS delta FROM f LEFT JOIN g USING (dimension, label)""")
def genuine_attach(spark, d):
    return _genuine(spark, d).select("dimension", "label", "n_docs", F.col("genuine_n").cast("long"), F.round("score", 5).alias("score"), F.round("genuine_score", 5).alias("genuine_score"), F.col("rank").cast("long"), F.col("genuine_rank").cast("long"), F.col("delta").cast("long"))


@query(f"""WITH a AS ({SQL["genuine_attach"]}), r AS (SELECT dimension || '=' || label AS label, score, genuine_score, row_number() OVER (ORDER BY score DESC, dimension || '=' || label) AS full_rank,
  row_number() OVER (ORDER BY genuine_score DESC, dimension || '=' || label) AS genuine_rank FROM a),
p AS (SELECT *, full_rank - genuine_rank AS delta, (full_rank <= 10 OR genuine_rank <= 10) AND genuine_score > 0 AS near FROM r),
q AS (SELECT * FROM p WHERE (near OR NOT (SELECT bool_or(near) FROM p)) AND (SELECT count(*) FROM p) >= 2),
s AS (SELECT *, row_number() OVER (ORDER BY abs(delta) DESC, full_rank) AS pos FROM q WHERE delta <> 0), h AS (SELECT *, row_number() OVER (ORDER BY full_rank) AS pos FROM q WHERE delta = 0), k AS (SELECT least(2, (SELECT count(*) FROM h)) AS kept),
x AS (SELECT *, CASE WHEN pos <= 6 - kept THEN 0 ELSE 2 END AS kind FROM s, k UNION ALL SELECT *, CASE WHEN pos <= kept THEN 1 ELSE 3 END FROM h, k), y AS (SELECT *, row_number() OVER (ORDER BY kind, pos) AS place FROM x)
SELECT place, label, full_rank, genuine_rank, delta FROM y WHERE place <= 6""")
def rank_movers(spark, d):
    named = _genuine(spark, d).withColumn("label", F.concat_ws("=", "dimension", "label")).withColumn("score", F.round("score", 5)).withColumn("genuine_score", F.round("genuine_score", 5))
    return tags.movers(named).select(F.col("place").cast("long"), "label", *[F.col(c).cast("long") for c in ("full_rank", "genuine_rank", "delta")])


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"""WITH {MEM}, z AS (SELECT source, count(*)::double AS size FROM od GROUP BY source), n AS (SELECT dimension, label, source, count(*) AS n FROM mem JOIN od USING (doc_id) GROUP BY ALL)
SELECT dimension, label, {', '.join(f"round(coalesce(max(CASE WHEN source = '{s}' THEN n / size END), 0), 6) AS prevalence_{s}" for s in SEGMENTS)} FROM n JOIN z USING (source) GROUP BY dimension, label""")
def per_source_pivot(spark, d):
    wide = tags.per_source(order_docs(spark, d), members(spark, d), SEGMENTS)
    return wide.select("dimension", "label", *[r6(f"prevalence_{s}").alias(f"prevalence_{s}") for s in SEGMENTS])


@query(f"WITH {MEM}, n AS (SELECT dimension, label, count(*)::double AS n FROM mem GROUP BY ALL) SELECT dimension, label, round(CASE WHEN max(n) OVER w = min(n) OVER w THEN 1 ELSE (n - min(n) OVER w) / (max(n) OVER w - min(n) OVER w) END, 6) AS norm FROM n WINDOW w AS (PARTITION BY dimension)")
def minmax_norm(spark, d):
    n = members(spark, d).groupBy("dimension", "label").agg(F.count("*").cast("double").alias("n"))
    return n.select("dimension", "label", r6(S.min_max(F.col("n"), ["dimension"])).alias("norm"))


WORDS_SQL = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))"
REASON_SQL = rf"""CASE WHEN {WORDS_SQL} < 3 THEN 'too_short'
  WHEN regexp_matches(text, '[\x{{1F300}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{1F1E6}}-\x{{1F1FF}}\x{{FE0F}}\x{{200D}}\x{{A9}}\x{{AE}}\x{{2122}}\x{{2B50}}]') AND len(regexp_extract_all(regexp_replace(text, '[\x{{1F300}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{1F1E6}}-\x{{1F1FF}}\x{{FE0F}}\x{{200D}}\x{{A9}}\x{{AE}}\x{{2122}}\x{{2B50}}]', ' ', 'g'), '[\p{{L}}\p{{N}}_]+')) < 3 THEN 'contains_emoji'
  WHEN lang = 'es' AND {WORDS_SQL} >= 8 THEN 'hindi_language' END"""


def _reason():
    return T.exclusion_reason(F.col("text"), F.col("lang"), languages=("es",))


#: Languages are learnt from the labelled documents.
SPOKEN = languages.sql("doc_id IN (SELECT doc_id FROM labels)")


def spoken(spark, d) -> DataFrame:
    """Documents with the language that their texts tell in place of the given one."""
    own = docs(spark, d)
    model = languages.fit(own.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi"))
    return own.withColumn("lang", languages.language(F.col("text"), model))


@query(f"WITH {SPOKEN} SELECT doc_id, lang FROM spoken")
def spoken_language(spark, d):
    return spoken(spark, d).select("doc_id", "lang")


@query(f"WITH {SPOKEN} SELECT doc_id, {WORDS_SQL} AS words, {REASON_SQL} AS reason FROM spoken")
def exclusion_reason(spark, d):
    """Spanish stands for the excluded language of the rule."""
    return spoken(spark, d).select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"), _reason().alias("reason"))


@query(f"WITH {SPOKEN} SELECT coalesce(reason, 'eligible') AS reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT {REASON_SQL} AS reason FROM spoken) GROUP BY 1")
def funnel_by_reason(spark, d):
    n = spoken(spark, d).groupBy(F.coalesce(_reason(), F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))
    return n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


@query(f"SELECT source, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS n_en, count(*) FILTER (WHERE {WORDS_SQL} < 25) AS n_short, sum(n_chars)::bigint AS chars, round(avg({WORDS_SQL}), 6) AS mean_words FROM documents GROUP BY source")
def source_stage_profile(spark, d):
    w = T.word_count(F.col("text"))
    return docs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"), F.count_if(w < 25).alias("n_short"), F.sum("n_chars").alias("chars"), r6(F.avg(w)).alias("mean_words"))


#: Terms are single words, so hits are the words that are terms.
HITS_SQL = r"len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: w IN ('the', 'la', 'der', 'tion', 'idiot')))"


@query(f"SELECT doc_id, {HITS_SQL} AS hits, round({HITS_SQL} / greatest({WORDS_SQL}, 1), 4) AS relevance_score, CASE WHEN {HITS_SQL} = 0 THEN false END AS is_relevant FROM documents")
def keyword_density(spark, d):
    return corpus.tier1(docs(spark, d), TERMS).select("doc_id", F.col("hits").cast("long"), "relevance_score", "is_relevant")


@query(r"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "))) AS content_words FROM documents")
def content_words(spark, d):
    return docs(spark, d).select("doc_id", T.content_word_count(F.col("text")).cast("long").alias("content_words"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, d):
    return corpus.latest_per_key(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_miss_anti(spark, d):
    return corpus.absent(docs(spark, d).select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY source")
def sample_semi(spark, d):
    return docs(spark, d).join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, coalesce(o.n, 0)::bigint AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def upsert_outer(spark, d):
    """Customers with zero orders, replaced by the counts there are."""
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    old = table(spark, d, "customer").select("c_custkey", F.lit(0).cast("long").alias("n_orders"))
    return corpus.upsert(old, new.join(old.select("c_custkey"), "c_custkey", "left_semi"), ["c_custkey"])


FLAT_SQL = r"array_to_string(regexp_extract_all(replace(lower(regexp_replace(regexp_replace(text, '(?m)^\s*>.*$', ' ', 'g'), '(?i)(https?://|www\.)\S+', ' ', 'g')), 'ß', 'ss'), '[\p{L}\p{N}]+'), ' ')"


@query(f"SELECT doc_id, CASE WHEN {FLAT_SQL} <> '' THEN substr(sha256({FLAT_SQL}), 1, 16) END AS content FROM documents")
def content_ids(spark, d):
    """Texts without words have no id."""
    flat = docs(spark, d).select("doc_id", T.for_fingerprint(F.col("text")).alias("flat"))
    return flat.select("doc_id", F.when(F.col("flat") != "", S.short_hash(F.col("flat"))).alias("content"))


@query(f"""WITH w AS (SELECT doc_id, string_split({FLAT_SQL}, ' ') AS w FROM documents), g AS (SELECT doc_id, unnest(CASE WHEN len(w) <= 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
h AS (SELECT doc_id, md5(g) AS m FROM g WHERE g <> ''), b AS (SELECT doc_id, unnest(range(0, 64)) AS b, m FROM h),
s AS (SELECT doc_id, b, sum(CASE WHEN (('0x' || substr(m, 16 - (b // 4)::int, 1))::int >> (b % 4)::int) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM b GROUP BY ALL),
p AS (SELECT doc_id, sum(CASE WHEN s > 0 THEN (CASE WHEN b = 63 THEN -9223372036854775808::hugeint ELSE (1::hugeint << b::int) END) ELSE 0 END) AS f FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(f, 0)::bigint AS fingerprint FROM documents d LEFT JOIN p USING (doc_id)""")
def simhash(spark, d):
    return S.simhash(docs(spark, d), "doc_id", digest="md5")


@query(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY md5({FLAT_SQL})) AS root FROM documents")
def exact_dups(spark, d):
    return corpus.with_roots(docs(spark, d).select("doc_id", "text")).select("doc_id", "root")


@query(f"WITH f AS (SELECT fingerprint, min(doc_id) AS doc_id FROM ({SQL['simhash']}) GROUP BY 1) SELECT x.doc_id AS a, y.doc_id AS b, bit_count(xor(x.fingerprint, y.fingerprint))::bigint AS distance FROM f x JOIN f y ON x.doc_id < y.doc_id WHERE bit_count(xor(x.fingerprint, y.fingerprint)) <= 12")
def near_pairs(spark, d):
    return corpus.near_pairs(S.simhash(docs(spark, d), "doc_id", digest="md5")).withColumn("distance", F.col("distance").cast("long"))


#: The greedy pass in id order over distinct fingerprints of enough words: a row is accepted unless an accepted one before it is near.
DUPS = f"""WITH RECURSIVE f AS (SELECT d.doc_id, fingerprint, {WORDS_SQL} AS words FROM documents d JOIN ({SQL['simhash']}) USING (doc_id) WHERE @where),
e AS MATERIALIZED (SELECT *, min(doc_id) OVER (PARTITION BY fingerprint) AS exact FROM f), c AS MATERIALIZED (SELECT doc_id, fingerprint FROM e WHERE doc_id = exact AND words >= 25),
n AS (SELECT y.doc_id, list(x.doc_id) AS near FROM c x JOIN c y ON x.doc_id < y.doc_id AND bit_count(xor(x.fingerprint, y.fingerprint)) <= 12 GROUP BY 1), i AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM n),
r AS (SELECT 0::bigint AS k, []::bigint[] AS gone UNION ALL SELECT i.k, CASE WHEN len(list_filter(i.near, lambda v: NOT list_contains(r.gone, v))) > 0 THEN list_append(r.gone, i.doc_id) ELSE r.gone END FROM r JOIN i ON i.k = r.k + 1),
g AS (SELECT gone FROM r ORDER BY k DESC LIMIT 1), m AS (SELECT i.doc_id AS exact, list_min(list_filter(near, lambda v: NOT list_contains(gone, v))) AS near FROM i, g WHERE list_contains(gone, i.doc_id)),
dup AS (SELECT doc_id, nullif(coalesce(m.near, exact), doc_id) AS is_duplicate_of FROM e LEFT JOIN m USING (exact))"""


@query(DUPS.replace("@where", "true") + " SELECT * FROM dup")
def near_dups(spark, d):
    own = docs(spark, d).select("doc_id", T.word_count(F.col("text")).alias("words"))
    return corpus.mark_duplicates(own, S.simhash(docs(spark, d), "doc_id", digest="md5"))


NORM = lambda c: rf"trim(regexp_replace(lower({c}), '\s+', ' ', 'g'))"


@query(f"SELECT item_id, doc_id FROM (SELECT item_id, {NORM('text')} AS q FROM benchmark) JOIN (SELECT doc_id, {NORM('text')} AS t FROM documents) ON contains(t, q) WHERE q <> ''")
def quote_containment(spark, d):
    return evidence.contained(table(spark, d, "benchmark"), docs(spark, d))


def _spans(spark, d):
    b = docs(spark, d).select("doc_id", "source", "text")
    first = F.regexp_extract("text", r"^(\S+(?:[ ]\S+){0,5})", 1)
    return b.select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y").alias("dimension"), F.when(F.col("doc_id") % 3 == 0, "of").otherwise("und").alias("label"), F.when(F.col("doc_id") % 5 == 0, F.lit("never in a text")).otherwise(first).alias("quote"))


CUES = {"x": {"of": ["the", "of"], "und": ["der", "und"]}, "y": {"of": [" ", "Zz"]}}
SPAN_SQL = r"""sp AS (SELECT doc_id, source, text, CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE 'y' END AS dimension, CASE WHEN doc_id % 3 = 0 THEN 'of' ELSE 'und' END AS label, CASE WHEN doc_id % 5 = 0 THEN 'never in a text' ELSE regexp_extract(text, '^(\S+(?:[ ]\S+){0,5})', 1) END AS quote FROM documents)"""


@query(f"""WITH {SPAN_SQL} SELECT doc_id, dimension, label, NOT ({NORM('quote')} <> '' AND contains({NORM('text')}, {NORM('quote')})) AS not_in_document,
CASE WHEN dimension = 'y' AND label = 'of' THEN NOT contains({NORM('quote')}, 'zz') WHEN dimension = 'y' THEN false
  WHEN label = 'of' THEN NOT (contains({NORM('quote')}, 'the') OR contains({NORM('quote')}, 'of')) ELSE NOT (contains({NORM('quote')}, 'der') OR contains({NORM('quote')}, 'und')) END AS no_cue_overlap,
{NORM('quote')} <> '' AND count(*) OVER (PARTITION BY doc_id, {NORM('quote')}) > 1 AS quoted_twice FROM sp""")
def evidence_flags(spark, d):
    return evidence.flags(_spans(spark, d).drop("source"), docs(spark, d), CUES).drop("quote")


SHOWN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(quote, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+', '[email]', 'g'), '(?i)\border\s*(?:id|no)?\s*[:#]?\s*[a-z0-9-]*\d[a-z0-9-]{4,}', '[order]', 'g'), '@[A-Za-z0-9_]{2,}', '[handle]', 'g'), '\+?[0-9][0-9 ()-]{8,}[0-9]', '[phone]', 'g')"""


@query(rf"""WITH {SPAN_SQL}, q AS (SELECT doc_id, source, label AS theme, contains(lower(quote), 'the')::int AS overlap, doc_id % 5 AS severity, trim(regexp_replace(replace(replace({SHOWN}, '|', '\|'), '`', ''''), '\s+', ' ', 'g')) AS t FROM sp),
h AS (SELECT *, CASE WHEN length(t) <= 240 THEN t ELSE regexp_replace(regexp_extract(left(t, 240), '^(.*)\s\S*$', 1), '[.,;:]+$', '') || '…' END AS quote FROM q),
a AS (SELECT *, row_number() OVER (PARTITION BY theme, quote ORDER BY overlap DESC, severity DESC, source, doc_id) AS rn FROM h),
b AS (SELECT *, row_number() OVER (PARTITION BY theme, source ORDER BY overlap DESC, severity DESC, source, doc_id) AS rs FROM a WHERE rn = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY (rs = 1) DESC, overlap DESC, severity DESC, source, doc_id) AS place FROM b)
SELECT theme, place, source, doc_id, quote FROM c WHERE place <= 4""")
def select_quotes(spark, d):
    rows = _spans(spark, d).withColumnRenamed("label", "theme").withColumn("overlap", F.contains(F.lower("quote"), F.lit("the")).cast("int")).withColumn("severity", F.col("doc_id") % 5)
    return evidence.select_quotes(rows).select("theme", "place", "source", "doc_id", "quote")


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+', '[email]', 'g'), '(?i)\border\s*(?:id|no)?\s*[:#]?\s*[a-z0-9-]*\d[a-z0-9-]{4,}', '[order]', 'g'), '@[A-Za-z0-9_]{2,}', '[handle]', 'g'), '\+?[0-9][0-9 ()-]{8,}[0-9]', '[phone]', 'g')) AS redacted FROM documents""")
def redact_pii(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.redact_shown(F.col("text"))).alias("redacted"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), h AS (SELECT *, regexp_replace(regexp_extract(left(t, 240), '^(.*)\s\S*$', 1), '[.,;:]+$', '') AS head FROM f)
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE CASE WHEN head = '' THEN left(t, 240) ELSE head END || '…' END AS shown FROM h""")
def truncate_text(spark, d):
    return docs(spark, d).select("doc_id", T.truncate(F.col("text")).alias("shown"))


ALLOC = """c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT *, least({b} - {f} * count(*) OVER (), sum(n - {f}) OVER ())::double * (n - {f}) / sum(n - {f}) OVER () AS exact, least({b} - {f} * count(*) OVER (), sum(n - {f}) OVER ()) AS places FROM c),
r AS (SELECT *, floor(exact) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, n DESC, source) AS rn FROM e), alloc AS (SELECT source, n, least({f} + base + CASE WHEN rn <= places - sum(base) OVER () THEN 1 ELSE 0 END, n)::bigint AS take FROM r)"""


@query("WITH " + ALLOC.format(b=157, f=0) + " SELECT * FROM alloc")
def sample_allocation(spark, d):
    return evaluation.allocate(docs(spark, d).groupBy("source").agg(F.count("*").alias("n")), 157)


@query("WITH " + ALLOC.format(b=157, f=1) + " SELECT * FROM alloc")
def source_floor(spark, d):
    return evaluation.allocate(docs(spark, d).groupBy("source").agg(F.count("*").alias("n")), 157, floor=1)


@query("WITH " + ALLOC.format(b=157, f=0) + " SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) AS rn FROM documents) JOIN alloc USING (source) WHERE rn <= take")
def stratified_draw(spark, d):
    return evaluation.stratified_draw(docs(spark, d).select("doc_id", "source"), sample_allocation(spark, d))


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 10")
def equal_strata(spark, d):
    return evaluation.equal_draw(docs(spark, d).select("doc_id", "lang"), 10, by="lang")


PRF = """g AS (SELECT doc_id, unnest([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END]) AS label FROM labels), p AS (SELECT doc_id, unnest([CASE WHEN n_chars >= 1000 THEN 'quality' END, CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'trash') THEN 'toxic' END]) AS label FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
f AS (SELECT label, count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE a IS NULL) AS fp, count(*) FILTER (WHERE b IS NULL) AS fn FROM (SELECT doc_id, label, true AS a FROM g WHERE label IS NOT NULL) FULL JOIN (SELECT doc_id, label, true AS b FROM p WHERE label IS NOT NULL) USING (doc_id, label) GROUP BY label),
q AS (SELECT *, tp + fn AS support, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM f), s AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM q)"""


def _prf(spark, d):
    lab = table(spark, d, "labels")
    gold = lab.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))).alias("label"))
    low = F.lower("text")
    pred = docs(spark, d).join(lab.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("n_chars") >= 1000, "quality"), F.when(F.contains(low, F.lit("idiot")) | F.contains(low, F.lit("trash")), "toxic")))).alias("label"))
    return evaluation.label_scores(gold, pred)


@query(f"WITH {PRF} SELECT label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s")
def label_prf(spark, d):
    return _prf(spark, d).select("label", "tp", "fp", "fn", "support", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@query(f"WITH {PRF} SELECT round(avg(f1), 6) AS macro_f1, count(*) AS n_labels FROM s WHERE support > 0 OR fp > 0")
def macro_f1(spark, d):
    return evaluation.macro_f1(_prf(spark, d)).select(r6("macro_f1").alias("macro_f1"), "n_labels")


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 0) AS n_wrong, round(count(*) FILTER (WHERE quality = 0) / count(*), 6) AS rate, count(*) FILTER (WHERE quality = 0) / count(*) < 0.1 AS passes, min(count(*) FILTER (WHERE quality = 0) / count(*) < 0.1) OVER () AS all_pass FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def audit_gate(spark, d):
    rows = docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return evaluation.gate(rows, by="lang", wrong=F.col("quality") == 0).withColumn("rate", r6("rate"))


@query("SELECT n AS n_docs, ceil(n / 6)::bigint AS calls, n * 645 AS tokens, round(n * 645 * 0.72 * 0.15 / 1e6 + n * 645 * (1 - 0.72) * 0.6 / 1e6, 6) AS usd, ceil(n * 645 / 200000)::bigint AS days FROM (SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))")
def cost_model(spark, d):
    return evaluation.cost_model(cache_miss_anti(spark, d)).withColumn("usd", r6("usd"))


@query("""WITH RECURSIVE t AS (SELECT source, doc_id, least(ceil(length(text) / 4.0)::bigint, 6000) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r AS (SELECT source, doc_id, i, 0::bigint AS batch, 1 AS n, tokens AS used FROM t WHERE i = 1 UNION ALL
  SELECT t.source, t.doc_id, t.i, CASE WHEN r.n >= 12 OR r.used + t.tokens > 6000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n >= 12 OR r.used + t.tokens > 6000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 12 OR r.used + t.tokens > 6000 THEN t.tokens ELSE r.used + t.tokens END FROM r JOIN t ON t.source = r.source AND t.i = r.i + 1)
SELECT source, doc_id, batch FROM r""")
def pack_batches(spark, d):
    rows = docs(spark, d).select("doc_id", "source", T.estimate_tokens(F.col("text")).alias("tokens"))
    return evaluation.pack_batches(rows, by="source", order="doc_id", tokens="tokens", max_count=12, budget=6000).select("source", "doc_id", "batch")


@query("WITH s AS (SELECT l_partkey, 1 + (l_quantity::bigint % 5) AS star, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_partkey, round(sum(star * n)::double / sum(n), 1) AS average, sum(n)::bigint AS ratings, coalesce(sum(n) FILTER (WHERE star IN (1, 2)), 0)::bigint AS low FROM s GROUP BY l_partkey")
def star_average(spark, d):
    stars = table(spark, d, "lineitem").groupBy("l_partkey", (1 + F.col("l_quantity").cast("long") % 5).cast("string").alias("star")).agg(F.count("*").alias("n"))
    maps = stars.groupBy("l_partkey").agg(F.map_from_entries(F.collect_list(F.struct("star", "n"))).alias("m"))
    return maps.select("l_partkey", reports.star_average(F.col("m")).alias("average"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, v: a + v).alias("ratings"), reports.option_share(F.col("m"), ["1", "2"]).alias("low"))


@query(f"WITH {MEM} SELECT q AS question, count(DISTINCT doc_id) AS n FROM mem JOIN (VALUES ('returns', 'R'), ('returns', 'A'), ('open', 'O'), ('filled', 'F'), ('none', 'N')) v(q, label) USING (label) GROUP BY q")
def ten_questions(spark, d):
    """Distinct documents over fixed label sets."""
    sets = spark.createDataFrame([("returns", "R"), ("returns", "A"), ("open", "O"), ("filled", "F"), ("none", "N")], "question string, label string")
    return members(spark, d).join(F.broadcast(sets), "label").groupBy("question").agg(F.countDistinct("doc_id").alias("n"))


@query("SELECT min(o_orderdate)::date AS first, max(o_orderdate)::date AS last, count(*) AS n FROM orders")
def date_range(spark, d):
    return table(spark, d, "orders").agg(F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"), F.count("*").alias("n"))


@query("SELECT event_type AS stage, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, round(greatest(0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 3) AS seconds, count(*) AS records_in, count(*) FILTER (WHERE value > 100) AS records_out FROM events GROUP BY 1")
def runlog_elapsed(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.count("*").alias("records_in"), F.count_if(F.col("value") > 100).alias("records_out"))
    return reports.elapsed(e).withColumn("seconds", F.round("seconds", 3)).withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS n_links, regexp_matches(lower(left(html, 4000)), 'captcha|cf-challenge|are you a robot|access denied') AS challenge FROM pages")
def html_links(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", H.title(h).alias("title"), F.size(H.links(h)).cast("long").alias("n_links"), H.is_challenge(h).alias("challenge"))


def _chain(start: str, *rules: tuple[str, str]) -> str:
    out = start
    for form, by in rules:
        out = f"regexp_replace({out}, '{form}', '{by}', 'g')"
    return out


#: The pages hold four named entities.
ENTITIES = "{}"
for _name, _char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    ENTITIES = f"replace({ENTITIES}, '{_name}', '{_char}')"
VISIBLE = _chain("html", (r"(?is)<script\b.*?</script\s*>", " "), (r"(?is)<style\b.*?</style\s*>", " "), (r"(?i)<(?:br|/p|/div|/li|/h[1-6])\s*/?>", "\n"), (r"(?s)<[^>]*>", " "), (r"\r\n?", "\n"))
VISIBLE = _chain(ENTITIES.format(VISIBLE), (r"[ \t]{2,}", " "), (r"[ \t]*\n[ \t]*", "\n"), (r"\n{3,}", "\n\n"))


@query(f"SELECT page_id, trim({VISIBLE}, ' ' || chr(10) || chr(9)) AS text FROM pages".replace("\n", "' || chr(10) || '"))
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", H.visible_text(F.col("html")).alias("text"))


@query("SELECT * FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN 'turn ' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations) WHERE role <> 'user'")
def carry_forward(spark, d):
    """What users say stands for directives, the other turns for lines."""
    line = F.when(F.col("role") == "user", F.concat(F.lit("# asked: turn "), F.col("turn").cast("string"))).otherwise("a line")
    lines = table(spark, d, "conversations").select("conv_id", "turn", "role", line.alias("line"))
    return H.carry_forward(lines, by="conv_id", pos="turn", line="line").drop("line")


@query("SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE role = 'assistant') AS n_replies, string_agg(role, '>' ORDER BY turn) AS shape FROM conversations GROUP BY conv_id")
def thread_flatten(spark, d):
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "assistant").alias("n_replies"), F.array_join(F.transform(turns, lambda t: t["role"]), ">").alias("shape"))


@query("SELECT event_type, count(*) AS n, sum((props::json->>'k')::bigint)::bigint AS k, count(*) FILTER (WHERE (props::json->>'k') IS NULL) AS without FROM events GROUP BY 1")
def json_meta(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"), F.count_if(k.isNull()).alias("without"))


@query("SELECT CASE WHEN w <= 5 THEN '3-5' WHEN w <= 10 THEN '6-10' WHEN w <= 20 THEN '11-20' ELSE '21+' END AS bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT " + WORDS_SQL + " AS w FROM documents) WHERE w >= 3 GROUP BY 1")
def length_strata(spark, d):
    w = docs(spark, d).select(T.word_count(F.col("text")).alias("w")).where("w >= 3")
    n = w.groupBy(F.when(F.col("w") <= 5, "3-5").when(F.col("w") <= 10, "6-10").when(F.col("w") <= 20, "11-20").otherwise("21+").alias("bucket")).agg(F.count("*").alias("n"))
    return n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::date AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(spark, d):
    return stream.tumbling(_events(spark, d)).select(F.to_date("window.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT (ts::date - o.o::int)::date AS day, event_type, count(*) AS n FROM events, (VALUES (0), (1)) o(o) GROUP BY ALL")
def event_sliding(spark, d):
    return stream.sliding(_events(spark, d)).select(F.to_date("window.start").alias("day"), "event_type", "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, session""")
def event_session(spark, d):
    return stream.sessions(_events(spark, d)).select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


@query("SELECT doc_id, substr(sha256(source || '|' || doc_id), 1, 16) AS id, substr(sha256(source || '|' || coalesce(nullif(trim(lang), ''), '__anonymous__') || 'salt'), 1, 16) AS author FROM documents")
def hashed_ids(spark, d):
    return docs(spark, d).select("doc_id", S.doc_id(F.col("source"), F.col("doc_id").cast("string")).alias("id"), S.author_hash(F.col("source"), F.col("lang"), "salt").alias("author"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source FROM documents WHERE source IN ('src0', 'src1') UNION ALL SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) AS rn FROM documents WHERE source NOT IN ('src0', 'src1')) WHERE rn <= 3)")
def census_and_sample(spark, d):
    """Two sources whole, three documents of each other one."""
    rows = docs(spark, d).select("doc_id", "source")
    census = F.col("source").isin("src0", "src1")
    return rows.where(census).unionByName(evaluation.equal_draw(rows.where(~census), 3, by="source"))


@query("SELECT batch, used FROM (SELECT doc_id // 20 AS batch, sum(count(*) * 56) OVER (ORDER BY doc_id // 20) AS used FROM documents GROUP BY 1) WHERE used <= 20000")
def budget_stop(spark, d):
    b = docs(spark, d).groupBy(F.floor(F.col("doc_id") / 20).cast("long").alias("batch")).agg((F.count("*") * 56).alias("tokens"))
    return evaluation.budget_stop(b, limit=20000).select("batch", "used")


@query("WITH s AS (SELECT l_partkey, sum(l_quantity::bigint % 3 = 0)::bigint AS bad, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT count(*) AS n, round(avg(100.0 * bad / n), 1) AS m FROM s) SELECT p_type AS theme, CASE WHEN contains(lower(p_type), 'steel') THEN 'fit' WHEN contains(lower(p_type), 'brass') THEN 'quality' ELSE 'none' END AS kind, CASE WHEN regexp_matches(lower(p_type), 'steel|brass') THEN n ELSE 0 END AS n_products, CASE WHEN regexp_matches(lower(p_type), 'steel|brass') THEN m END AS mean_share FROM (SELECT DISTINCT p_type FROM part), r")
def cross_reference(spark, d):
    from corpusloom.operators import tagging

    s = table(spark, d, "lineitem").groupBy("l_partkey").agg((F.count_if(F.col("l_quantity").cast("long") % 3 == 0) * 100.0 / F.count("*")).alias("misfit"))
    themes = table(spark, d, "part").select(F.col("p_type").alias("theme")).distinct()
    return tagging.cross_reference(themes, s.withColumn("bad_quality", F.col("misfit")), {"fit": ["steel"], "quality": ["brass"]})


@query("WITH e AS (SELECT event_type AS source, ts::date AS run_date, count(*) AS records FROM events GROUP BY ALL) SELECT source, max(run_date) AS run_date, arg_max(records, run_date) AS records FROM e GROUP BY source")
def manifest_latest(spark, d):
    from corpusloom.sources import manual

    m = table(spark, d, "events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("run_date")).agg(F.count("*").alias("records")).withColumn("status", F.lit("ok"))
    return manual.latest_manifest(m).select("source", "run_date", "records")


@query("SELECT page_id, len(list_distinct(regexp_extract_all(html, '/p/(\\d{6,})', 1))) AS n_products, html[1:15] AS head FROM pages".replace("\\\\", "\\"))
def product_ids(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(H.product_ids(F.col("html"))).cast("long").alias("n_products"), F.left("html", F.lit(15)).alias("head"))


@query("WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents) SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'cached' ELSE 'asked' END AS state, count(*) AS n, count(*) FILTER (WHERE coalesce(toxic = 0, true)) AS relevant FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def tier2_verdicts(spark, d):
    from corpusloom.operators import tagging

    cache = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 0).alias("is_relevant"))
    v = tagging.verdicts(docs(spark, d), cache, budget=10_000_000_000)
    return v.groupBy("state").agg(F.count("*").alias("n"), F.count_if("is_relevant").alias("relevant"))


@query("SELECT round(sum(n_chars) * 0.15 / 1e6 + sum(length(lang) + 1) * 0.6 / 1e6, 6) AS usd, sum(n_chars)::bigint AS prompt FROM documents")
def token_totals(spark, d):
    t = docs(spark, d).agg(F.sum("n_chars").alias("prompt"), F.sum(F.char_length("lang")).alias("completion"), F.count("*").alias("reasoning"))
    return t.select(r6(reports.paid_usd(F.col("prompt"), F.col("completion"), F.col("reasoning"))).alias("usd"), "prompt")


STAGE_OF = {f"src{i}": ("pre_purchase", "post_purchase", "mixed")[i % 3] for i in range(20)}


@query("SELECT doc_id, CASE WHEN source = 'src0' THEN CASE WHEN lang = 'en' THEN 'pre_purchase' ELSE 'post_purchase' END ELSE ['pre_purchase', 'post_purchase', 'mixed'][1 + substr(source, 4)::int % 3] END AS stage FROM documents")
def purchase_stages(spark, d):
    """The first source has both kinds of texts, told apart by the language column."""
    kind = F.when(F.col("lang") == "en", "qa").otherwise("review")
    return docs(spark, d).select("doc_id", corpus.purchase_stage(F.col("source"), kind, stages=STAGE_OF, refined=("src0",)).alias("stage"))


@query(f"SELECT substr(sha256(source || '|' || doc_id), 1, 16) AS doc_id, source, lang, length(text)::bigint AS char_len, {WORDS_SQL}::bigint AS word_count FROM documents")
def normalized(spark, d):
    raw = docs(spark, d).select("source", F.col("doc_id").cast("string").alias("source_native_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("author_raw"), F.lit(None).cast("timestamp").alias("created_utc"), "text", F.to_json(F.struct("lang")).alias("meta"))
    return corpus.normalize(raw, salt="salt").select("doc_id", "source", "lang", "char_len", "word_count")


STOP_SQL = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(rf"""WITH s AS (SELECT doc_id, {REASON_SQL} AS reason, {HITS_SQL} AS hits, len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nl}}\p{{No}}]+'), lambda w: w NOT IN ({STOP_SQL}))) AS content FROM documents)
SELECT doc_id, CASE WHEN reason IS NOT NULL THEN reason WHEN hits > 0 THEN 'tier2_rejected' WHEN content < 40 THEN 'tier1_zero_hits_contentless' ELSE 'tier1_zero_hits_contentful' END AS stratum FROM s""")
def rejected_strata(spark, d):
    """Every document as if it had been rejected."""
    a = corpus.tier1(docs(spark, d), TERMS)
    return a.select("doc_id", corpus.rejected_stratum(_reason(), F.col("hits").cast("double"), T.content_word_count(F.col("text")), min_content_words=40).alias("stratum"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_per_key(spark, d):
    return corpus.latest_per_key(table(spark, d, "events"), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_type", "event_id")


def _brand_clusters(spark, d):
    """Brands of one maker are a cluster; the other labels stand alone."""
    m = members(spark, d)
    names = m.where("dimension = 'blocker'").select(F.concat(F.lit("blocker="), "label").alias("a")).distinct()
    edges = names.join(names.withColumnRenamed("a", "b"), F.expr("left(a, 15) = left(b, 15) AND a < b"))
    return m, tags.clusters(m, edges)


_CLUSTERED = """, cl AS (SELECT dimension, label, first_value(label) OVER (PARTITION BY dimension, CASE WHEN dimension = 'blocker' THEN left(label, 7) ELSE label END ORDER BY n DESC, label) AS cluster FROM (SELECT dimension, label, count(*) AS n FROM mem0 GROUP BY ALL)),
mem AS (SELECT DISTINCT doc_id, dimension, cluster AS label FROM mem0 JOIN cl USING (dimension, label))"""


@query(_score_sql("").replace("mem AS (", "mem0 AS (", 1).replace("), od AS (", ")" + _CLUSTERED + ", od AS (", 1).replace("conf / 100 *", "(1 - bad) * conf / 100 *").replace("avg(severity) AS sev", "avg(severity) AS sev, count(*) FILTER (WHERE doc_id % 7 = 0) / count(*) AS bad")
       + " SELECT dimension, label, n::bigint AS n_docs, round(bad, 6) AS flagged_share, round(share, 6) AS share, round(evidence, 6) AS evidence, round(score, 5) AS score FROM s")
def cluster_quantify(spark, d):
    """The whole pass over label clusters; every seventh document has flagged evidence."""
    from corpusloom.operators import quantify

    m, found = _brand_clusters(spark, d)
    rows = quantify.quantify(order_docs(spark, d), m, found, flags=m.withColumn("is_flagged", F.col("doc_id") % 7 == 0))
    return rows.select("dimension", "label", "n_docs", r6("flagged_share").alias("flagged_share"), r6("share").alias("share"), r6("evidence").alias("evidence"), F.round("score", 5).alias("score"))


@query("WITH p AS (" + SQL["per_source_pivot"] + ") SELECT dimension, label, CASE greatest(" + ", ".join(f"prevalence_{s}" for s in SEGMENTS) + ") WHEN 0 THEN NULL " + " ".join(f"WHEN prevalence_{s} THEN '{s}'" for s in SEGMENTS) + " END AS top_source FROM p")
def top_source(spark, d):
    from corpusloom.operators import quantify

    return quantify.top_source(per_source_pivot(spark, d), SEGMENTS).select("dimension", "label", "top_source")


@query(f"WITH {SPAN_SQL}, q AS (SELECT {NORM('quote')} <> '' AND contains({NORM('text')}, {NORM('quote')}) AS ok FROM sp) SELECT count(*) AS n_quotes, count(*) FILTER (WHERE ok) AS n_contained, round(count(*) FILTER (WHERE ok) / count(*), 6) AS precision FROM q")
def evidence_precision(spark, d):
    return evaluation.evidence_precision(_spans(spark, d), docs(spark, d)).withColumn("precision", r6("precision"))


@query("""WITH n AS (SELECT lang, count(*) AS n, least(round_even(151.0 * count(*) / sum(count(*)) OVER (), 0), count(*))::bigint AS want FROM documents GROUP BY lang),
t AS (SELECT lang, greatest(0, least(want, 151 - coalesce(sum(want) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::bigint AS take FROM n),
o AS (SELECT doc_id, lang, sha256('42:' || doc_id) AS h, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS rn FROM documents),
x AS (SELECT o.*, rn <= take AS own FROM o JOIN t USING (lang)), y AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY h, doc_id) AS more FROM x)
SELECT doc_id, lang FROM y WHERE own OR more <= 151 - (SELECT sum(take) FROM t)""")
def representative_sample(spark, d):
    return evaluation.representative_sample(docs(spark, d).select("doc_id", "lang"), 151, by="lang").select("doc_id", "lang")


@query("SELECT 'source' AS kind, source AS key, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source UNION ALL SELECT 'intent', i, count(*) FILTER (WHERE quality::varchar = i) FROM labels JOIN documents USING (doc_id), (VALUES ('0'), ('1'), ('2')) v(i) GROUP BY i")
def overview_counts(spark, d):
    rows = docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("source", F.col("quality").cast("string").alias("intent_class"))
    return reports.overview(rows, ["0", "1", "2"])


@query("SELECT event_type AS source, 'ok' AS status, count(*) AS records, true AS passes FROM events GROUP BY event_type UNION ALL SELECT 'absent', 'missing', 0, false")
def manifest_gate(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("records")).withColumn("status", F.lit("ok"))
    return evaluation.manifest_check(e.select("source").unionByName(spark.createDataFrame([("absent",)], "source string")), e)


@query(DUPS.replace("@where", f"({REASON_SQL}) IS NULL") + f""", a AS (SELECT d.doc_id, source, ({REASON_SQL}) IS NOT NULL AS out, is_duplicate_of IS NOT NULL AS dup, {HITS_SQL} AS hits FROM documents d LEFT JOIN dup USING (doc_id))
SELECT source, count(*) AS documents, count(*) FILTER (WHERE out) AS excluded, count(*) FILTER (WHERE dup) AS duplicates, count(*) FILTER (WHERE NOT out AND NOT dup) AS eligible,
count(*) FILTER (WHERE NOT out AND NOT dup AND hits = 0) AS without_hits, count(*) FILTER (WHERE NOT out AND NOT dup AND hits > 0) AS relevant FROM a GROUP BY source""")
def corpus_funnel(spark, d):
    """The whole funnel by source."""
    return corpus.profile(corpus.build(docs(spark, d), TERMS, languages=("es",), digest="md5"))


LI = r"unnest(regexp_extract_all(html, '(?s)<li><a href=\"[^\"]*\">(.*?)</a></li>', 1))"


@query(f"WITH b AS (SELECT url AS page, {ENTITIES.format(LI)} AS text FROM pages), c AS (SELECT *, {FLAT_SQL} AS flat FROM b) SELECT page, CASE WHEN flat <> '' THEN substr(sha256(flat), 1, 16) END AS native_id, page AS url, text FROM c WHERE trim(text) <> ''".replace(ENTITIES.format(LI), LI))
def page_blocks(spark, d):
    """Navigation entries of all pages as blocks."""
    from corpusloom.sources import listings

    return listings.html_blocks(table(spark, d, "pages"), ["div.review", "nav li"], {"body": ["p.body", "a"]}).select("page", "native_id", "url", "text")
