"""The quantification pass over label clusters, and the views of its rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import tags


def cluster_members(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` under the first label of their cluster: a document counts once in a cluster, however many of its labels it has.

    ``found``: dimension, label, cluster (``dimension=label``), a row per label.
    """
    name = F.split("cluster", "=", 2)
    return members.join(found.select("dimension", "label", "cluster"), ["dimension", "label"]).select("doc_id", name[0].alias("dimension"), name[1].alias("label")).distinct()


def cluster_flags(flags: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, dimension, label, is_flagged): a document is flagged in a cluster where any of its labels there is."""
    name = F.split("cluster", "=", 2)
    rows = flags.join(found.select("dimension", "label", "cluster"), ["dimension", "label"]).select("doc_id", name[0].alias("dimension"), name[1].alias("label"), "is_flagged")
    return rows.groupBy("doc_id", "dimension", "label").agg(F.bool_or("is_flagged").alias("is_flagged"))


def cluster_texts(found: DataFrame) -> DataFrame:
    """(dimension, label, cluster_text): the members of each cluster as ``dimension=label; ...``, by dimension and label."""
    name = F.split("cluster", "=", 2)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("dimension", "label"))), lambda m: F.concat_ws("=", m["dimension"], m["label"])), "; ")
    return found.groupBy("cluster").agg(listed.alias("cluster_text")).select(name[0].alias("dimension"), name[1].alias("label"), "cluster_text")


def parse_members(text: Column, dimension: Column, label: Column) -> Column:
    """``dimension=label; ...`` as distinct structs in order, with the row's own pair at the end where it is not among them. A part without ``=``
    is a label of the row's dimension; blank parts go; null text has the own pair alone."""
    pair = lambda d, x: F.struct(F.trim(d).alias("dimension"), F.trim(x).alias("label"))
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != "")
    named = F.transform(parts, lambda p: F.when(F.contains(p, F.lit("=")), pair(F.substring_index(p, "=", 1), F.regexp_replace(p, "^[^=]*=", ""))).otherwise(pair(dimension, p)))
    return F.array_distinct(F.concat(named, F.array(pair(dimension, label))))


def quantify(docs: DataFrame, members: DataFrame, found: DataFrame, *, flags: DataFrame | None = None, **how) -> DataFrame:
    """A ranked row per cluster: the full population, beside it count, score and rank of the genuine one, and the cluster's members.

    ``found``: the clusters (``tags.clusters``); ``flags``: doc_id, dimension, label, is_flagged of evidence that was screened. Supporting
    documents are a table of their own (``cluster_members``), not a list in a row: a list would grow with the corpus.
    """
    own = cluster_members(members, found)
    bad = cluster_flags(flags, found) if flags is not None else None
    held = tags.tagged(docs, own, bad)
    rows = tags.opportunities_of(held, **how)
    few = tags.opportunities_of(held.where("genuine"), **how)
    return tags.attach_genuine(rows, few).join(cluster_texts(found), ["dimension", "label"], "left")


def top_source(rows: DataFrame, sources: list[str]) -> DataFrame:
    """``rows`` with top_source, the source of the largest ``prevalence_<source>`` over 0 (of equals the first in ``sources``), else null."""
    best = F.greatest(F.lit(0.0), F.lit(0.0), *[F.coalesce(F.col(f"prevalence_{s}"), F.lit(0.0)) for s in sources])
    pick = reduce(lambda c, s: F.when(F.col(f"prevalence_{s}") == best, s).otherwise(c), reversed(sources), F.lit(None).cast("string"))
    return rows.withColumn("top_source", F.when(best > 0, pick))


def filter_scores(rows: DataFrame, *, dimensions: list[str] | None = None, sources: list[str] | None = None, reportable_only: bool = False, hide_post_only: bool = False) -> DataFrame:
    """Rows of the dimensions, seen in any of the sources, reportable, not of later stages alone; each condition only where it is asked for."""
    if dimensions:
        rows = rows.where(F.col("dimension").isin(dimensions))
    if reportable_only:
        rows = rows.where(F.coalesce("reportable", F.lit(False)))
    if hide_post_only:
        rows = rows.where(~F.coalesce("post_only", F.lit(False)))
    known = [s for s in sources or [] if f"prevalence_{s}" in rows.columns]
    if sources:
        rows = rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(f"prevalence_{s}").try_cast("double"), F.lit(0.0)) > 0 for s in known], F.lit(False)))
    return rows


def rank_view(rows: DataFrame, *, genuine: bool = False) -> DataFrame:
    """Rows with ``place``: reportable first, then those not of later stages alone, then by the score of the population."""
    score, n = ("genuine_score", "genuine_n") if genuine else ("score", "n_docs")
    order = Window.orderBy(F.desc("reportable"), "post_only", F.desc(score), F.desc(n), "dimension", "label")  # a row per label
    return rows.withColumn("place", F.row_number().over(order))


def typed_cells(rows: DataFrame, *, rates: list[str] = (), means: list[str] = (), scores: list[str] = ()) -> DataFrame:
    """Rows as a report prints them: booleans true or false, rates with six decimals, means with four, scores with two, nulls empty."""
    digits = {**dict.fromkeys(rates, 6), **dict.fromkeys(means, 4), **dict.fromkeys(scores, 2)}
    cell = lambda c: F.format_string(f"%.{digits[c]}f", F.col(c).cast("double")) if c in digits else F.col(c).cast("string")
    return rows.select(*[F.when(F.col(c).isNull(), "").otherwise(cell(c)).alias(c) for c in rows.columns])
