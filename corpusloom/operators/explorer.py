"""Projections that an explorer of the corpus shows, and the lines of a report that come from counts of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# Names of sources as a reader sees them, columns that are no source, and list columns of tags.
NAMES = {"youtube": "YouTube", "play_store": "Play Store", "app_store": "App Store", "consumer_complaints_in": "ConsumerComplaints.in", "quora_manual": "Quora", "complaints_board": "ComplaintsBoard", "reddit": "Reddit"}
NO_SOURCES = {"lo", "hi", "norm", "genuine", "lo_genuine", "hi_genuine"}
LISTS = ("blocker_type", "uncertainty_type", "wishlist_motivation", "info_sought_elsewhere", "segment_cue")


def analyzable(docs: DataFrame) -> DataFrame:
    """Relevant documents that are no duplicates."""
    return docs.where("is_relevant and is_duplicate_of is null")


def tagged_documents(docs: DataFrame, tags: DataFrame, *, limit: int = 280) -> DataFrame:
    """A row per tagged analyzable document: what is shown of it, list columns joined by commas, the text redacted and cut.

    ``tags``: doc_id and a struct ``tags`` (``tagging.parse_tags``), null where the blob is bad: then all of its fields are empty.
    """
    joined = analyzable(docs).join(tags.select("doc_id", "tags"), "doc_id")
    text = lambda c: F.coalesce(F.col(f"tags.{c}"), F.lit("")).alias(c)
    lists = [F.coalesce(F.array_join(f"tags.{c}", ", "), F.lit("")).alias(c) for c in LISTS]
    shown = T.truncate(T.redact_collected(F.coalesce("text", F.lit(""))), limit)
    return joined.select("doc_id", "source", "url", "created_utc", "word_count", text("intent_class"), *lists, text("outcome_mentioned"), "tags.severity", "tags.confidence_pct", shown.alias("preview"))


def corpus_facts(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: documents, analyzable ones, those with tags, and those of genuine intent. ``tags``: doc_id, intent_class."""
    n = docs.agg(F.count("*").alias("documents"), F.count_if(F.expr("is_relevant and is_duplicate_of is null")).alias("analyzable"))
    t = analyzable(docs).select("doc_id").join(tags.select("doc_id", "intent_class"), "doc_id").agg(F.count("*").alias("tagged"), F.count_if(F.col("intent_class") == "genuine_intent").alias("genuine_intent"))
    return n.join(F.broadcast(t), how="cross")  # a row each


def source_names(columns: list[str]) -> list[str]:
    """The sources that a score table has prevalence columns of, in its order."""
    found = [c.removeprefix("prevalence_") for c in columns if c.startswith("prevalence_")]
    return [c for c in found if c and c not in NO_SOURCES]


def source_display_name(source: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return F.coalesce(F.element_at(known, source), T.pretty_label(source))


def compact_rows(rows: DataFrame) -> DataFrame:
    """Rows without lists of documents and without internal columns."""
    return rows.select(*[c for c in rows.columns if c != "supporting_doc_ids" and not c.startswith("_")])


def label_shares(members: DataFrame, docs: DataFrame, groups: dict[str, list[str]], *, cite: dict[str, str] | None = None) -> DataFrame:
    """(name, n, total, source, doc_id, line) per group of labels: documents with any of them, all documents, and one that is cited.

    The cited document has the group's ``cite`` label (the first of its labels where none is named): the smallest (source, doc_id); without
    one, the smallest of all. ``groups`` is a fixed vocabulary.
    """
    spark = members.sparkSession
    rows = [(name, label, label == (cite or {}).get(name, labels[0])) for name, labels in groups.items() for label in labels]
    wanted = F.broadcast(spark.createDataFrame(rows, "name string, label string, cited boolean"))
    names = spark.createDataFrame([(name, ", ".join(f"`{x}`" for x in labels)) for name, labels in groups.items()], "name string, labels string")
    place = F.struct("source", "doc_id")
    own = members.join(wanted, "label").join(docs.select("doc_id", "source"), "doc_id").groupBy("name").agg(F.countDistinct("doc_id").alias("n"), F.min(F.when(F.col("cited"), place)).alias("at"))
    whole = docs.agg(F.count("*").alias("total"), F.min(place).alias("any"))
    out = names.join(own, "name", "left").join(F.broadcast(whole), how="cross").withColumn("at", F.coalesce("at", "any")).withColumn("n", F.coalesce("n", F.lit(0)))
    said = F.concat(F.lit("**"), F.col("n").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit("** tagged documents carry "), F.col("labels"), F.lit(" ("), citation(F.col("at.source"), F.col("at.doc_id")), F.lit(")."))
    return out.select("name", "n", "total", "at.source", "at.doc_id", said.alias("line"))


def citation(source: Column, doc: Column) -> Column:
    return F.when(doc.isNull(), "`(no tagged document)`").otherwise(F.concat(F.lit("`"), source, F.lit("` `"), doc.cast("string"), F.lit("`")))


def role_volumes(shares: DataFrame) -> DataFrame:
    """One row ``line``: the volumes of ``label_shares`` as ``name **n**``, in alphabetical order."""
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "n"))), lambda x: F.concat(x["name"], F.lit(" **"), x["n"].cast("string"), F.lit("**"))), "; ")
    return shares.groupBy().agg(F.concat(F.lit("Of "), F.max("total").cast("string"), F.lit(" tagged documents, tag volumes are "), parts, F.lit(".")).alias("line"))


def cued_line(shares: DataFrame, matrix: DataFrame, *, lift: float = 2.0) -> DataFrame:
    """One row ``line``: documents with a cue of a segment, and the cells of the matrix whose lift is material."""
    cells = matrix.agg(F.count_if(F.col("lift") >= lift).alias("cells"))
    one = shares.select("n", "total").limit(1).join(F.broadcast(cells), how="cross")
    return one.select(F.format_string(f"**%d of %d** tagged documents carry a segment cue. %d cell(s) of the segment matrix have a lift of {lift:g} or more.", "n", "total", "cells").alias("line"))


def unflagged_quotes(spans: DataFrame, flagged: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, cluster, quote): of each document the first quote of the cluster's labels, in the cluster's order, that belongs to a label without
    any flagged span. ``spans``: doc_id, label, pos, quote; ``flagged``: doc_id, label, is_flagged; ``members``: cluster, label, place."""
    good = spans.where("trim(coalesce(quote, '')) <> ''").join(flagged.where("not is_flagged").select("doc_id", "label"), ["doc_id", "label"])
    return good.join(F.broadcast(members), "label").groupBy("doc_id", "cluster").agg(F.min_by("quote", F.struct("place", "pos", "quote")).alias("quote"))


def corpus_summary(by_source: DataFrame) -> DataFrame:
    """(pos, line) of the summary: totals, a table row per source (source, documents, analyzable), and the mix of the analyzable ones."""
    total = by_source.agg(F.sum("documents").alias("d"), F.sum("analyzable").alias("a"), F.count_if(F.col("analyzable") > 0).alias("k"), F.min(F.when(F.col("analyzable") > 0, F.col("source"))).alias("one"))
    head = total.select(F.lit(0).alias("pos"), F.format_string("**%d documents** in the corpus, **%d analyzable** (relevant, not a duplicate).", F.coalesce("d", F.lit(0)), F.coalesce("a", F.lit(0))).alias("line"))
    rows = by_source.select(F.lit(1).alias("pos"), F.format_string("| `%s` | %d | %d |", "source", "documents", "analyzable").alias("line"))
    share = by_source.where("analyzable > 0").join(F.broadcast(total), how="cross").select("source", F.format_string("`%s` %.0f%%", "source", F.col("analyzable") * 100.0 / F.col("a")).alias("s"))
    mix = share.groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "s"))), lambda x: x["s"]), ", ").alias("mix"))
    tail = total.join(mix, how="cross").select(F.lit(2).alias("pos"), F.when(F.col("k") == 0, "No analyzable documents yet, so there is no source mix to report.").when(F.col("k") == 1, F.concat(F.lit("The analyzable corpus is "), F.col("one"), F.lit("-only."))).otherwise(F.concat(F.lit("Analyzable source mix: "), F.col("mix"), F.lit("."))).alias("line"))
    return head.unionByName(rows).unionByName(tail)


def limitations(counts: dict) -> list[str]:
    """Sentences that hold of a corpus with these counts (by_source: source -> analyzable documents, pre, tagged, relevant, sampled, flagged_share)."""
    some = {s: n for s, n in counts.get("by_source", {}).items() if n}
    out = []
    if len(some) == 1:
        out.append(f"The analyzable corpus is {next(iter(some))}-only: what it says is what that platform's users say.")
    if some and counts.get("pre"):
        top = max(sorted(some), key=lambda s: some[s])
        out.append(f"{top} has {some[top]} of {sum(some.values())} analyzable documents ({some[top] / sum(some.values()):.0%}).")
    out += [f"{s} contributed no analyzable document." for s, n in sorted(counts.get("by_source", {}).items()) if not n]
    if counts.get("sampled"):
        out.append(f"Tags are of a sample, {counts['tagged']} of {counts['relevant']} relevant documents; shares are of the sample.")
    if counts.get("flagged_share") is None:
        out.append("Tags are a machine's; how many are wrong has not been measured.")
    else:
        out.append(f"Tags are a machine's; {counts['flagged_share']:.0%} of the supporting documents rest on a flagged quote.")
    if not counts.get("ranked", True):
        out.append("No themes have been ranked.")
    return out


def side_channel(summary: DataFrame, references: DataFrame) -> DataFrame:
    """(pos, line) of the section on product aggregates: coverage, average, fit, quality (``reports.product_summary``), and a line per theme
    (``tagging.cross_reference``). Without products one line says so."""
    line = lambda pos, when, form, *args: F.when(when, F.struct(F.lit(pos).alias("pos"), F.format_string(form, *args).alias("line")))
    some = F.col("products") > 0
    lines = F.array(
        line(0, ~some, "No aggregate records were available, so none is cited."), line(1, some, "Coverage: **%d product(s)**.", "products"),
        line(2, some & F.col("mean_average_rating").isNotNull(), "- **Rating:** mean %.2f, %d reported and %d derived.", "mean_average_rating", "ratings_reported", "ratings_derived"),
        line(3, some & (F.col("products_with_fit") > 0), "- **Fit:** %d product(s); mean misfit %.1f%%, %d loose, %d tight.", "products_with_fit", "mean_misfit_pct", "top_fit_is_loose", "top_fit_is_tight"),
        line(4, some & (F.col("products_with_quality") > 0), "- **Quality:** %d product(s); mean bad and very bad %.1f%%.", "products_with_quality", "mean_bad_quality_pct"),
    )
    own = summary.select(F.inline(F.array_compact(lines)))
    themes = references.join(F.broadcast(summary.where(some).select("products")), how="cross").select(F.lit(5).alias("pos"), F.concat(F.lit("- **"), F.col("theme"), F.lit("**: "), F.when(F.col("n_products") > 0, F.format_string("corroborated by %s, mean %.1f%% over %d product(s)", "kind", "mean_share", "n_products")).otherwise("not corroborated"), F.lit(".")).alias("line"))
    return own.unionByName(themes)


def opportunity_lines(rows: DataFrame) -> DataFrame:
    """(rank, label, lines): the bullet lines of each ranked row; what a row does not have is left out."""
    say = lambda when, form, *args: F.when(when, F.format_string(form, *args))
    has = lambda c: F.col(c).isNotNull()
    lines = F.array_compact(F.array(
        say(has("score"), "- opportunity score: %.2f", "score"), say(has("prevalence"), "- prevalence: %.1f%% (%.1f%% to %.1f%%)", F.col("prevalence") * 100, F.col("low") * 100, F.col("high") * 100),
        say(has("n_docs"), "- supporting documents: %d", "n_docs"), say(has("n_authors"), "- distinct authors: %d", "n_authors"), say(has("genuine_n"), "- of genuine intent: %d", "genuine_n"),
        say(F.col("post_only"), "- after the purchase only"), say(F.col("low_confidence"), "- low confidence"),
    ))
    return rows.select("rank", "dimension", "label", F.array_join(lines, "\n").alias("lines"))


def score_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with exactly ``columns``, in that order; what is not there is null."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])


def overhead_tokens(prompt: str, schema: str = "") -> int:
    """Estimated tokens of a call besides its documents."""
    return -(-len(prompt) // 4) + -(-len(schema) // 4)


def input_budget(per_minute: int, completion: int, per_document: int) -> int:
    """Tokens that one call's input may have: what a minute leaves beside the completion, a whole document at least."""
    return max(per_document, per_minute - completion)


def usage_tokens(reported: Column, estimate: Column) -> Column:
    """The tokens that a response reports, else the estimate; a report of nothing counts as none."""
    return F.coalesce(F.nullif(reported.try_cast("long"), F.lit(0)), estimate.cast("long"))
