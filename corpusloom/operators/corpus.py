"""Corpus funnel: latest copies, upserts, tier-1 triage, exact and near duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import scoring as S
from corpusloom.functions import text as T
from corpusloom.operators.graph import first_accepted, near_pairs
from corpusloom.sources.tables import bounded_batches, checkpointed


# The side of a purchase that a source's texts speak to, and that of the kinds of texts where a source has both.
STAGES = {
    "youtube": "pre_purchase", "quora_manual": "pre_purchase", "reddit": "pre_purchase", "mouthshut": "post_purchase", "trustpilot": "post_purchase",
    "complaints_board": "post_purchase", "consumer_complaints_in": "post_purchase", "play_store": "mixed", "app_store": "mixed",
}
BY_CONTENT = {"qa": "pre_purchase", "review": "post_purchase"}


def purchase_stage(source: Column, content_type: Column, *, stages: dict[str, str] | None = None, refined: tuple[str, ...] = ("onsite", "onsite_manual")) -> Column:
    """The stage of a source; of the ``refined`` ones by content type. A source (or content type there) that is not known fails the query."""
    literal = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    fail = F.raise_error(F.concat(F.lit("no purchase stage for source "), F.coalesce(source, F.lit("null")), F.lit(", content type "), F.coalesce(content_type, F.lit("null")))).cast("string")
    return F.when(source.isin(*refined), F.coalesce(literal(BY_CONTENT)[content_type], fail)).otherwise(F.coalesce(literal(STAGES if stages is None else stages)[source], fail))


def normalize(raw: DataFrame, *, salt: str) -> DataFrame:
    """Documents of raw records: hashed ids, no handles, the language that ``meta`` names, sizes."""
    lang = F.try_variant_get(F.try_parse_json("meta"), "$.lang", "string")
    return raw.select(
        S.doc_id(F.col("source"), F.col("source_native_id")).alias("doc_id"), "source", "source_native_id", "url", S.author_hash(F.col("source"), F.col("author_raw"), salt).alias("author_hash"), "created_utc", "text",
        lang.alias("lang"), F.char_length("text").cast("long").alias("char_len"), T.word_count(F.col("text")).cast("long").alias("word_count"), "meta", F.current_timestamp().alias("ingested_at"),
    )


def rejected_stratum(reason: Column, score: Column, content_words: Column, *, min_content_words: int = 3) -> Column:
    """What rejected a document: a hard rule by its name, no keyword at all (with or without content), else the second tier."""
    few = F.when(content_words < min_content_words, "tier1_zero_hits_contentless").otherwise("tier1_zero_hits_contentful")
    return F.when(reason.isNotNull(), reason).when(F.coalesce(score, F.lit(0.0)) == 0, few).otherwise("tier2_rejected")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (newest first, with every tie broken)."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-if-absent, cache misses, set difference: rows of ``new`` whose key ``old`` lacks."""
    return new.join(old.select(*keys), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys, and its other rows."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def tier1(docs: DataFrame, terms: list[str], *, min_content_words: int = 3) -> DataFrame:
    """relevance_score (hits a word, four places), is_relevant false at no hit (else still open), contentless for such rows of few words."""
    hits, words = T.keyword_hits(F.col("text"), terms), T.word_count(F.col("text"))
    df = docs.withColumn("hits", hits).withColumn("words", words)
    score = F.round(F.col("hits") / F.greatest(F.col("words"), F.lit(1)), 4)
    return df.withColumn("relevance_score", score).withColumn("is_relevant", F.when(F.col("hits") == 0, False)).withColumn("contentless", (F.col("hits") == 0) & (T.content_word_count(F.col("text")) < min_content_words))


def with_roots(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) without their texts, and the smallest doc_id whose text has the same words (root). Null texts are copies of each other.

    A text is folded once: rows are written with the hash of its words, then meet the smallest id of each hash.
    """
    bounded_batches(docs.sparkSession)
    content = F.coalesce(F.md5(T.for_fingerprint(F.col("text"))), F.lit(""))
    own = checkpointed(docs.withColumn("__content", content).drop("text"))
    return own.join(own.groupBy("__content").agg(F.min("doc_id").alias("root")), "__content").drop("__content")


def mark_duplicates(docs: DataFrame, prints: DataFrame, *, bits: int = 12, min_words: int = 25) -> DataFrame:
    """(doc_id, is_duplicate_of): exact fingerprints first (smallest id stands), then near ones among the rest of enough words; pointers go to roots.

    ``docs``: doc_id, words. Rows with other exclusions must be left out before.
    """
    all_ = checkpointed(prints.join(docs.select("doc_id", "words"), "doc_id"))
    roots = all_.groupBy("fingerprint").agg(F.min("doc_id").alias("exact"))
    exact = all_.join(roots, "fingerprint")
    long = exact.where((F.col("doc_id") == F.col("exact")) & (F.col("words") >= min_words)).select("doc_id", "fingerprint")
    near = first_accepted(long, near_pairs(long, bits=bits)).withColumnRenamed("doc_id", "exact").withColumnRenamed("root", "near")
    found = exact.join(near, "exact", "left").withColumn("root", F.coalesce("near", "exact"))
    return found.select("doc_id", F.when(F.col("root") != F.col("doc_id"), F.col("root")).alias("is_duplicate_of"))


def build(docs: DataFrame, terms: list[str], *, languages: tuple[str, ...] = ("hi",), min_words: int = 3, bits: int = 12, near_words: int = 25, digest: str = "blake2b") -> DataFrame:
    """The funnel over documents (doc_id, text, lang, ...): adds word_count, exclusion_reason, fingerprint, is_duplicate_of, relevance_score, is_relevant.

    Hard-excluded rows are not relevant and have no score; duplicates have neither score nor verdict; rows without a hit score 0 and are not
    relevant; the others are (a second tier may take that back: ``tagging.verdicts``). Fingerprints are there for all rows, but only rows
    that no rule excludes anchor duplicates.
    """
    rows = checkpointed(docs.withColumn("word_count", T.word_count(F.col("text")).cast("long")).withColumn("exclusion_reason", T.exclusion_reason(F.col("text"), F.col("lang"), min_words=min_words, languages=languages)))
    prints = checkpointed(S.simhash(rows, "doc_id", digest=digest))
    open_ = rows.where("exclusion_reason is null").select("doc_id", F.col("word_count").alias("words"))
    rows = rows.join(prints, "doc_id").join(mark_duplicates(open_, prints, bits=bits, min_words=near_words), "doc_id", "left")
    scored = tier1(rows, terms)
    out, dup = F.col("exclusion_reason").isNotNull(), F.col("is_duplicate_of").isNotNull()
    verdict = F.when(out, False).when(~dup, F.col("hits") > 0)
    return scored.withColumn("is_relevant", verdict).withColumn("relevance_score", F.when(~out & ~dup, F.col("relevance_score"))).drop("hits", "words", "contentless")


def profile(built: DataFrame, *, by: str = "source") -> DataFrame:
    """Per source the counts of the funnel, in one pass: documents, excluded, duplicates, eligible, without hits, relevant."""
    return built.groupBy(by).agg(
        F.count("*").alias("documents"), F.count_if(F.col("exclusion_reason").isNotNull()).alias("excluded"), F.count_if(F.col("is_duplicate_of").isNotNull()).alias("duplicates"),
        F.count_if(F.col("exclusion_reason").isNull() & F.col("is_duplicate_of").isNull()).alias("eligible"), F.count_if(F.col("relevance_score") == 0).alias("without_hits"), F.count_if(F.col("is_relevant")).alias("relevant"),
    )


def profile_sets(built: DataFrame, *, apart: str, by: tuple[str, str] = ("source", "stage")) -> DataFrame:
    """The profile by source, by stage and of all documents, in one pass over ``built`` (source, stage, exclusion_reason, is_duplicate_of, is_relevant).

    Counters: documents, analyzable (relevant and no duplicate), excluded, duplicates, triaged (not relevant for no other reason), relevant, and analyzable
    ones of all sources but ``apart``, which is large enough to hide the others. A row of a grouping has nulls in the columns that it sums over.
    """
    relevant, alone = F.coalesce(F.col("is_relevant"), F.lit(False)), F.col("is_duplicate_of").isNull()
    out = F.col("exclusion_reason").isNotNull()
    counts = {
        "documents": F.count("*"), "analyzable": F.count_if(relevant & alone), "excluded": F.count_if(out), "duplicates": F.count_if(~alone),
        "triaged": F.count_if(~F.coalesce(F.col("is_relevant"), F.lit(True)) & ~out & alone), "relevant": F.count_if(relevant), "analyzable_apart": F.count_if(relevant & alone & (F.col("source") != apart)),
    }
    keys = [F.col(c) for c in by]
    return built.groupingSets([[keys[0]], [keys[1]], []], *keys).agg(*[c.alias(name) for name, c in counts.items()])
