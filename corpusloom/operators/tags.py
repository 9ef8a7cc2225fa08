"""Tags of documents: membership, co-occurrence, label clusters, capped author shares, opportunity rows.

Throughout, ``members`` has (doc_id, dimension, label) without repeats, and ``docs`` has doc_id, author, source, created, severity, actionability,
confidence, genuine, stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import scoring as S
from corpusloom.sources.tables import checkpointed

PRIORITY = ["blocker", "uncertainty", "info", "motivation", "segment"]


def explode_tags(tags: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """Membership rows from label arrays: ``dimensions`` maps a column to its dimension."""

    def pair(dimension: str):
        return lambda x: F.struct(F.lit(dimension).alias("dimension"), x.alias("label"))

    pairs = F.flatten(F.array(*[F.transform(F.coalesce(F.col(c), F.array()), pair(d)) for c, d in dimensions.items()]))
    return tags.select("doc_id", F.inline(F.array_distinct(pairs)))


def prevalence(members: DataFrame, n_docs: DataFrame, *, low_n: int = 20) -> DataFrame:
    """Per label: documents, share of all (a one-row frame ``total``), Wilson bounds, low-confidence flag."""
    got = members.groupBy("dimension", "label").agg(F.count("*").alias("n_docs")).join(F.broadcast(n_docs), how="cross")
    p, low, high = S.wilson(F.col("n_docs"), F.col("total"))
    return got.select("dimension", "label", "n_docs", p.alias("prevalence"), low.alias("low"), high.alias("high"), (F.col("n_docs") < low_n).alias("low_confidence"))


def cooccurrence(members: DataFrame, pairs: list[tuple[str, str]], n_docs: DataFrame) -> DataFrame:
    """Observed label pairs of the dimension pairs, with counts, lift and Jaccard. Labels of a document meet within its row."""
    docs = members.groupBy("doc_id").agg(F.collect_set(F.struct("dimension", "label")).alias("t"))
    both = docs.select(F.explode("t").alias("a"), "t").select("a", F.explode("t").alias("b")).where(reduce(lambda p, q: p | q, [(F.col("a.dimension") == i) & (F.col("b.dimension") == j) for i, j in pairs]))
    both = both.groupBy("a", "b").agg(F.count("*").alias("n_both"))
    size = members.groupBy(F.struct("dimension", "label").alias("k")).agg(F.count("*").alias("n"))
    out = both.join(F.broadcast(size.select(F.col("k").alias("a"), F.col("n").alias("n_a"))), "a").join(F.broadcast(size.select(F.col("k").alias("b"), F.col("n").alias("n_b"))), "b").join(F.broadcast(n_docs), how="cross")
    return out.select(
        F.col("a.dimension").alias("dimension_a"), F.col("a.label").alias("label_a"), F.col("b.dimension").alias("dimension_b"), F.col("b.label").alias("label_b"),
        "n_both", "n_a", "n_b", S.lift(F.col("n_both"), F.col("n_a"), F.col("n_b"), F.col("total").cast("double")).alias("lift"),
        (F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))).alias("jaccard"),
    )


def lift_order(pairs: DataFrame) -> DataFrame:
    """Label pairs with their place by lift, the largest first; ties by names. A row per pair of labels, a fixed vocabulary."""
    return pairs.withColumn("place", F.row_number().over(Window.orderBy(F.desc("lift"), "dimension_a", "label_a", "dimension_b", "label_b")).cast("long"))


def clusters(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(dimension, label, cluster): components of the label graph ``edges`` (a, b: ``dimension=label``), by minimum label propagation.

    The graph has a node per label, a fixed vocabulary, so rounds are few and small. A cluster is named by the member of the first dimension,
    the most documents, then the alphabet.
    """
    names = F.concat_ws("=", "dimension", "label")
    size = members.groupBy("dimension", "label", names.alias("node")).agg(F.count("*").alias("n"))
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    state = size.select("node", F.col("node").alias("root"))
    settled = False
    while not settled:  # a round settles the neighbours of what is settled, so labels bound the rounds
        low = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = checkpointed(state.join(low, "node", "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root")))
        settled = step.join(state.withColumnRenamed("root", "was"), "node").where("root <> was").isEmpty()
        state = step
    rank = reduce(lambda c, d: c.when(F.col("dimension") == d[1], d[0]), list(enumerate(PRIORITY[1:], 1)), F.when(F.col("dimension") == PRIORITY[0], 0)).otherwise(len(PRIORITY))
    named = size.join(state, "node")
    primary = named.groupBy("root").agg(F.min_by("node", F.struct(rank.alias("r"), (-F.col("n")).alias("m"), "label")).alias("cluster"))
    return named.join(primary, "root").select("dimension", "label", "cluster")


def top_cooccurring(pairs: DataFrame, k: int = 3) -> DataFrame:
    """Per label the ``k`` labels that share most documents, as ``label (n)`` joined by ``; ``."""
    w = Window.partitionBy("dimension_a", "label_a").orderBy(F.desc("n_both"), "dimension_b", "label_b")
    ranked = pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    text = F.concat("label_b", F.lit(" ("), F.col("n_both").cast("string"), F.lit(")"))
    return ranked.groupBy("dimension_a", "label_a").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", text.alias("s")))), lambda x: x["s"]), "; ").alias("top"))


def voice(author: Column, doc: Column) -> Column:
    """Anonymous documents are voices of their own."""
    return F.coalesce(author.cast("string"), F.concat(F.lit("anon:"), doc.cast("string")))


def with_recency(docs: DataFrame, half_life: float = 365.0) -> DataFrame:
    """Adds recency, by age from the latest ``created`` (1.0 where there is none)."""
    latest = docs.agg(F.max("created").alias("__now"))
    age = (F.unix_micros(F.col("__now").cast("timestamp")) - F.unix_micros(F.col("created").cast("timestamp"))) / 86400e6
    return docs.join(F.broadcast(latest), how="cross").withColumn("recency", F.coalesce(S.recency_weight(age, half_life), F.lit(1.0))).drop("__now")


def capped(docs: DataFrame, cap: int = 5) -> DataFrame:
    """Of each voice its ``cap`` most recent documents of the population (ties: the smaller id)."""
    w = Window.partitionBy("voice").orderBy(F.desc("recency"), "doc_id")
    return docs.withColumn("voice", voice(F.col("author"), F.col("doc_id"))).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).drop("rn")


def author_share(docs: DataFrame, members: DataFrame, *, cap: int = 5) -> DataFrame:
    """(dimension, label, share): a voice's share is the recency weight of its capped documents with the label; the mean is over all voices."""
    kept = capped(docs, cap)
    total = kept.groupBy("voice").agg(F.sum("recency").alias("whole")).where("whole > 0")
    voices = total.agg(F.count("*").alias("voices"))
    own = members.join(kept.select("doc_id", "voice", "recency"), "doc_id").groupBy("dimension", "label", "voice").agg(F.sum("recency").alias("tagged"))
    return own.join(total, "voice").groupBy("dimension", "label").agg(F.sum(F.col("tagged") / F.col("whole")).alias("s")).join(F.broadcast(voices), how="cross").select("dimension", "label", (F.col("s") / F.col("voices")).alias("share"))


def tagged(docs: DataFrame, members: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """``docs``, a row each, with ``tags``: their labels as (dimension, label, is_flagged), null where there are none. A table: what is counted by label and what
    is summed by voice are read from it, and no row per label is shuffled."""
    rows = members.select("doc_id", "dimension", "label", F.lit(False).alias("is_flagged"))
    if flags is not None:
        rows = members.select("doc_id", "dimension", "label", F.lit(True).alias("own"), F.lit(None).cast("boolean").alias("is_flagged")).unionByName(flags.select("doc_id", "dimension", "label", F.lit(False).alias("own"), "is_flagged"))
        rows = rows.repartition("doc_id").groupBy("doc_id", "dimension", "label").agg(F.bool_or("own").alias("own"), F.bool_or("is_flagged").alias("is_flagged")).where("own")
    lists = rows.groupBy("doc_id").agg(F.collect_list(F.struct("dimension", "label", "is_flagged")).alias("tags"))
    return checkpointed(docs.join(lists, "doc_id", "left"))


def _voices(rows: DataFrame, cap: int) -> DataFrame:
    """(dimension, label, n_authors, share) of ``tagged`` rows with recency. Documents meet by voice; all that follows happens where a voice is."""
    own = rows.select("doc_id", voice(F.col("author"), F.col("doc_id")).alias("voice"), "recency", "tags")
    place = F.row_number().over(Window.partitionBy("voice").orderBy(F.desc("recency"), "doc_id"))
    kept = own.withColumn("kept", F.when(place <= cap, F.col("recency")))
    kept = kept.withColumn("whole", F.sum("kept").over(Window.partitionBy("voice")))
    each = kept.select("voice", "kept", "whole", F.inline("tags")).groupBy("voice", "dimension", "label").agg(F.sum("kept").alias("tagged"), F.max("whole").alias("whole"))
    return each.groupBy("dimension", "label").agg(F.count("*").alias("n_authors"), F.sum(F.when(F.col("whole") > 0, F.col("tagged") / F.col("whole"))).alias("s")).where("s is not null")


def opportunities(docs: DataFrame, members: DataFrame, *, flags: DataFrame | None = None, **how) -> DataFrame:
    """The scored, ranked label rows of a population: one pass over members for counts and means, one for capped author shares.

    ``flags``: doc_id, dimension, label, is_flagged; the share of flagged documents lowers a label's evidence. ``post_only`` holds where no
    document is of the stage before the purchase.
    """
    return opportunities_of(tagged(docs, members, flags), **how)


def opportunities_of(rows: DataFrame, *, cap: int = 5, min_authors: int = 3, low_n: int = 20) -> DataFrame:
    """``opportunities`` of ``tagged`` documents, or of some of them: recency and caps are those of the rows given."""
    docs = with_recency(rows)
    by_voice = docs.groupBy(voice(F.col("author"), F.col("doc_id")).alias("voice")).agg(F.count("*").alias("n"), F.max("recency").alias("most"))
    totals = by_voice.agg(F.sum("n").alias("total"), F.count("voice").alias("authors_total"), F.count_if(F.col("most") > 0).alias("voices"))
    totals = totals.join(docs.agg(F.countDistinct("source").alias("sources_total")), how="cross")
    sums = {c: F.sum(c).alias(f"sum_{c}") for c in ("severity", "actionability", "confidence")}
    known = {c: F.count(c).alias(f"n_{c}") for c in sums}
    by_source = docs.select("source", "severity", "actionability", "confidence", "stage", F.inline("tags")).groupBy("dimension", "label", "source").agg(
        F.count("*").alias("n"), *sums.values(), *known.values(), F.count_if("is_flagged").alias("flagged"), *[F.count_if(F.col("stage") == s).alias(f"n_{s}") for s in ("pre", "post", "mixed")]
    )
    mean = lambda c: (F.sum(f"sum_{c}") / F.sum(f"n_{c}")).alias(f"mean_{c}")
    stats = by_source.groupBy("dimension", "label").agg(
        F.sum("n").alias("n_docs"), *[mean(c) for c in sums], F.count("source").alias("n_sources"), *[F.sum(f"n_{s}").alias(f"n_{s}") for s in ("pre", "post", "mixed")], (F.sum("flagged") / F.sum("n")).alias("flagged_share")
    )
    rows = stats.join(_voices(docs, cap), ["dimension", "label"]).join(F.broadcast(totals), how="cross").withColumn("share", F.col("s") / F.col("voices")).drop("s", "voices")
    p, low, high = S.wilson(F.col("n_docs"), F.col("total"))
    rows = rows.withColumns({"prevalence": p, "low": low, "high": high, "spread": F.col("n_sources") / F.col("sources_total")})
    rows = rows.withColumn("evidence", S.evidence_confidence(F.col("mean_confidence"), F.col("spread"), S.sample_size_factor(F.col("prevalence"), F.col("low")), 1 - F.col("flagged_share")))
    rows = rows.withColumns({"share_norm": S.min_max(F.col("share")), "author_prevalence": F.col("n_authors") / F.col("authors_total"), "severity_norm": F.col("mean_severity") / 5.0})
    rows = rows.withColumn("score", S.opportunity_score(F.col("share_norm"), F.col("mean_severity"), F.col("mean_actionability"), F.col("evidence")))
    rows = rows.withColumns({"reportable": F.col("n_authors") >= min_authors, "post_only": F.col("n_pre") == 0, "low_confidence": (F.col("n_docs") < low_n) | (F.col("n_authors") < min_authors), "source_specific": F.col("n_sources") == 1, "high_prevalence": F.col("prevalence") > 0.9})
    order = Window.orderBy(F.desc("reportable"), "post_only", F.desc("score"), F.desc("n_docs"), "dimension", "label")  # a row per label
    return rows.withColumn("rank", F.row_number().over(order))


def attach_genuine(full: DataFrame, genuine: DataFrame) -> DataFrame:
    """Full rows with the genuine population's count, score and rank (0 where a label is not there) and the movement of ranks."""
    g = genuine.select("dimension", "label", F.col("n_docs").alias("genuine_n"), F.col("score").alias("genuine_score"), F.col("rank").alias("genuine_rank"))
    out = full.join(g, ["dimension", "label"], "left").na.fill(0, ["genuine_n", "genuine_score"])
    return out.withColumn("delta", F.col("rank") - F.col("genuine_rank"))


def movers(rows: DataFrame, *, head: int = 10, limit: int = 6, holds: int = 2) -> DataFrame:
    """Labels by how far they move between the ranking by score and that by genuine_score (ties by label), in the order of a report.

    Labels in the head of either ranking with a genuine score over 0 come into question, all of them where there is no such one. The farthest
    movers stand first, then up to ``holds`` labels that keep their place; places that one kind leaves free go to the other. ``rows`` has a row
    per label: label, score, genuine_score; fewer than two scored labels give none.
    """
    by = lambda *order: F.row_number().over(Window.orderBy(*order))
    all_ = Window.partitionBy()
    r = rows.where("score is not null and genuine_score is not null").select("label", "score", "genuine_score")
    r = r.withColumn("full_rank", by(F.desc("score"), "label")).withColumn("genuine_rank", by(F.desc("genuine_score"), "label")).withColumn("delta", F.col("full_rank") - F.col("genuine_rank"))
    near = ((F.col("full_rank") <= head) | (F.col("genuine_rank") <= head)) & (F.col("genuine_score") > 0)
    r = r.withColumn("near", near).withColumn("any", F.bool_or("near").over(all_)).withColumn("n", F.count("*").over(all_))
    r = r.where("n >= 2 and (near or not any)").withColumn("holds", F.col("delta") == 0)
    r = r.withColumn("pos", F.row_number().over(Window.partitionBy("holds").orderBy(F.desc(F.abs("delta")), "full_rank", "label"))).withColumn("kept", F.least(F.count_if("holds").over(all_), F.lit(min(holds, limit))))
    kind = F.when(~F.col("holds"), F.when(F.col("pos") <= limit - F.col("kept"), 0).otherwise(2)).otherwise(F.when(F.col("pos") <= F.col("kept"), 1).otherwise(3))
    return r.withColumn("place", by(kind, "pos")).where(F.col("place") <= limit).select("place", "label", "score", "genuine_score", "full_rank", "genuine_rank", "delta")


def per_source(docs: DataFrame, members: DataFrame, sources: list[str]) -> DataFrame:
    """Prevalence of each label within each source: a column ``prevalence_<source>`` each."""
    size = docs.groupBy("source").agg(F.count("*").alias("size"))
    n = members.join(docs.select("doc_id", "source"), "doc_id").groupBy("dimension", "label", "source").agg(F.count("*").alias("n")).join(F.broadcast(size), "source")
    wide = n.groupBy("dimension", "label").pivot("source", sources).agg(F.first(F.col("n") / F.col("size")))
    return wide.select("dimension", "label", *[F.coalesce(F.col(f"`{s}`"), F.lit(0.0)).alias(f"prevalence_{s}") for s in sources])
