"""The subpackage's queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import audio, chat, chosen_path, lines, merkle, mixing, packing, repair, spots, suffixes, tokens, toxicity, warc

#: Where tokenizer files lie; the installed public ones by default.
TOKENIZERS = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers")
SAMPLE_RATE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.compare_edited(table(spark, sf_dir, "documents"))


def op3_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Melodies made from all embeddings; half a second to 3.5 seconds of those whose id is divisible by 20 are searched for among all of them. A row
    per clip: its best class of equal prints and all that align with it (``audio.members`` has the recordings of a class)."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    stored = audio.fingerprints(audio.sonify(vectors, SAMPLE_RATE), SAMPLE_RATE)
    asked = audio.fingerprints(audio.sonify(vectors.where("id % 20 = 0"), SAMPLE_RATE, clip=(0.5, 3.5)), SAMPLE_RATE)
    return audio.search(asked, stored)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.write_tokens(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", end_id=2)
    return tokens.token_index(spark, path)


def op5_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    path = chat.write_trees(chat.format_trees(rows.unionByName(more), f"{TOKENIZERS}/byte_bpe_50k.json"))
    return chat.read_conversations(spark, path)


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's records are found again by its URL: directory, block, range read."""
    pages = table(spark, sf_dir, "pages")
    folder, index = warc.write_archives(pages)
    keys = pages.select(warc.url_key(F.col("url").cast("string")).alias("key"))
    return warc.find_keys(index, folder, keys, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op7_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "class_size")


def op8_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lex = toxicity.fit_lexicon(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), lex)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))


def domains_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows and their domain: the language and the quality label."""
    return labels.select("doc_id", "quality").join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", F.concat_ws("/", "lang", F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("domain"))


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = mixing.rates(docs, domains_of(docs, labels))
    return got.select("doc_id", "n_tokens", "domain", F.round("p_domain", 6).alias("p_domain"), F.round("rate", 6).alias("rate"))


def op10_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of which all rows were lost have a report of zeros."""
    rows = table(spark, sf_dir, "conversations")
    found, all_ = repair.repair(repair.damaged(rows)), rows.select("conv_id").distinct()
    zeros = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return all_.join(found, all_["conv_id"].eqNullSafe(found["conv_id"]), "left").select(all_["conv_id"], *[F.coalesce(c, F.lit(z)).alias(c) for c, z in zeros.items()])


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id has an even crc32 are verified against texts without line ends."""
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.col("text").cast("string")
    return merkle.proofs(merkle.build(docs, claimed_text=F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_spot_signatures, op3_chroma_fingerprints, op4_token_files, op5_chat_trees, op6_warc_index, op7_chosen_path_join, op8_toxicity_lexicon, op9_soft_mixing, op10_bin_slack_packing, op11_suffix_array_dedup, op12_conversation_repair, op13_merkle_manifest, pipeline)}

SQL = {
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), many AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, (m.key IS NOT NULL AND m.last <> k.doc_id) AS gone FROM keyed k LEFT JOIN many m USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op6_warc_index": r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (payload_digest)""",
    "op11_suffix_array_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, substr(x, (2 * p + 1)::bigint, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS p FROM d)),
own AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, p FROM w JOIN own USING (s) WHERE first < doc_id),
cut AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM cut),
span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM run GROUP BY doc_id, run),
part AS (SELECT doc_id, a, z, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM (SELECT * FROM span UNION ALL SELECT doc_id, -1, 0 FROM d)),
kept AS (SELECT doc_id, string_agg(substr(x, (2 * z + 1)::bigint, (2 * (coalesce(next, n) - z))::bigint), '' ORDER BY a) AS x, sum(CASE WHEN a >= 0 THEN z - a ELSE 0 END)::bigint AS n_removed, count(*) - 1 AS n_spans
  FROM part JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(kept.x)) AS kept_sha256 FROM d JOIN kept USING (doc_id)""",
    "op12_conversation_repair": r"""
WITH RECURSIVE own AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         @crc(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')) % 20 AS fault FROM conversations
), bad AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM own)
), placed AS (SELECT *, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM bad),
said AS (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS t, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM placed),
faults AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS kind FROM said),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE kind = 'blank') AS blank, count(*) FILTER (WHERE kind = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE kind = 'truncated') AS truncated, count(*) FILTER (WHERE prev || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faults GROUP BY conv_id
), grammar(q, r, q2) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
name(r, role) AS (VALUES ('u', 'user'), ('a', 'assistant')),
ins AS (  -- up to two inserted rows
  SELECT DISTINCT q, q AS q2, 0 AS cost, '' AS audit, []::varchar[] AS lines FROM (SELECT q FROM grammar UNION SELECT q2 FROM grammar)
  UNION ALL SELECT q, q2, 2, 'I', [role || ':'] FROM grammar JOIN name USING (r)
  UNION ALL SELECT g.q, h.q2, 4, 'II', [m.role || ':', n.role || ':'] FROM grammar g JOIN name m ON m.r = g.r JOIN grammar h ON h.q = g.q2 JOIN name n ON n.r = h.r
), way AS (
  SELECT conv_id, 0::bigint AS i, '' AS q, {'cost': 0, 'audit': '', 'lines': []::varchar[]} AS w FROM sums
  UNION ALL
  SELECT conv_id, i, q, min(w) FROM (
    SELECT p.conv_id, f.i, CASE e.edit WHEN 'D' THEN n.q2 ELSE g.q2 END AS q,
           {'cost': p.w.cost + n.cost + e.cost + CASE WHEN e.edit <> 'D' AND f.kind = 'truncated' THEN 1 ELSE 0 END, 'audit': p.w.audit || n.audit || e.edit,
            'lines': p.w.lines || n.lines || CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [m.role || ':' || f.text] END} AS w
    FROM way p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN ins n ON n.q = p.q
    JOIN (VALUES ('K', 0), ('R', 2), ('D', 3)) e(edit, cost) ON e.edit = 'D' OR f.kind IS NULL OR f.kind = 'truncated'
    LEFT JOIN grammar g ON g.q = n.q2 AND (e.edit = 'R' AND g.r <> 's' OR e.edit = 'K' AND g.r = f.r) LEFT JOIN name m ON m.r = g.r
    WHERE e.edit = 'D' OR g.q IS NOT NULL) GROUP BY conv_id, i, q
), best AS (
  SELECT s.conv_id, min({'cost': w.cost + n.cost, 'audit': w.audit || n.audit, 'lines': w.lines || n.lines}) AS w
  FROM sums s JOIN way p ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.i = s.n JOIN ins n ON n.q = p.q WHERE n.q2 IN ('', 'a') GROUP BY s.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(w.cost, 0)::bigint AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, text, concat(@f(doc_id), @f(source), @f(lang), @f(n_chars)) AS head,
         @crc(doc_id::varchar) AS crc
  FROM documents
), d AS (
  SELECT doc_id, source, sha256(head || @f(text)) AS h, sha256(head || CASE WHEN crc % 2 = 0 THEN @f(replace(text, chr(10), '')) ELSE @f(text) END) AS claimed FROM f
), leaf AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d),
tree AS (
  SELECT 0 AS level, source, i, h FROM leaf
  UNION ALL
  SELECT level + 1, source, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM tree) WHERE n > 1 GROUP BY level, source, i // 3
), sub AS (SELECT source, max(level) AS top, arg_max(h, level) AS subroot FROM tree WHERE i = 0 GROUP BY source),
src AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i FROM sub),
crown AS (
  SELECT 0 AS level, i, subroot AS h FROM src
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM crown) WHERE n > 1 GROUP BY level, i // 3
), ends AS (SELECT max(level) AS top, arg_max(h, level) AS root FROM crown WHERE i = 0),
whole AS (  -- every node below the root, with a level and place that count on from sources to their tree
  SELECT t.level, t.source, t.i, t.h FROM tree t JOIN sub s ON t.source IS NOT DISTINCT FROM s.source AND t.level < s.top
), step AS (
  SELECT l.doc_id, l.h AS leaf, 0 AS k, l.i AS at, false AS high, 0 AS level, l.claimed AS folded, '' AS proof, l.source FROM leaf l
  UNION ALL
  SELECT p.doc_id, p.leaf, p.k + 1, p.to_at, p.to_high, p.to_level, CASE WHEN p.turn THEN p.folded ELSE sha256(p.lft || p.folded || p.rgt) END, p.proof || p.lft || p.rgt, p.source
  FROM (
    SELECT x.doc_id, x.leaf, x.k, x.folded, x.proof, x.source, NOT x.high AND x.level = any_value(s.top) AS turn,
           CASE WHEN NOT x.high AND x.level = any_value(s.top) THEN any_value(s.i) ELSE x.at // 3 END AS to_at,
           x.high OR x.level = any_value(s.top) AS to_high, CASE WHEN NOT x.high AND x.level = any_value(s.top) THEN 0 ELSE x.level + 1 END AS to_level,
           coalesce(string_agg(w.h, '' ORDER BY w.i) FILTER (WHERE w.i < x.at), '') AS lft, coalesce(string_agg(w.h, '' ORDER BY w.i) FILTER (WHERE w.i > x.at), '') AS rgt
    FROM step x JOIN src s ON s.source IS NOT DISTINCT FROM x.source JOIN ends e ON NOT (x.high AND x.level = e.top)
    LEFT JOIN (SELECT false AS high, level, source, i, h FROM whole UNION ALL SELECT true, level, NULL, i, h FROM crown, ends WHERE level < top) w
      ON w.high = x.high AND w.level = x.level AND w.i // 3 = x.at // 3 AND w.i <> x.at AND (x.high OR w.source IS NOT DISTINCT FROM x.source)
    GROUP BY x.doc_id, x.leaf, x.k, x.at, x.high, x.level, x.folded, x.proof, x.source
  ) p
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM step x JOIN sub s ON s.source IS NOT DISTINCT FROM x.source JOIN ends e ON x.high AND x.level = e.top""",
}

_CALL = r"\(((?:[^()]|\([^()]*(?:\([^()]*\)[^()]*)*\))*)\)"
for _name in ("op12_conversation_repair", "op13_merkle_manifest"):
    # A value with its length, as leaves have it; the checksum of ASCII text, a byte and a bit at a time.
    SQL[_name] = re.sub("@f" + _CALL, r"coalesce(octet_length(encode(\1::varchar))::varchar || ':' || \1::varchar, '-')", SQL[_name])
    SQL[_name] = re.sub("@crc" + _CALL, r"xor(list_reduce(list_transform(string_split(\1, ''), lambda x: ord(x)::ubigint), lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384::ubigint * (x & 1)), xor(c, b)), 4294967295::ubigint), 4294967295::ubigint)", SQL[_name])
