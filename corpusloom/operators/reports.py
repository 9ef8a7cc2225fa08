"""Roll-ups for reports: corpus profile, star maps, run log, markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Options of product questions that count as too loose, too tight and bad.
LOOSE = ("loose", "too loose")
TIGHT = ("tight", "too tight")
BAD = ("bad", "very bad")


def star_average(stars: Column) -> Column:
    """The mean star of a map star -> share, over the shares' own sum, to one place; null on an empty map."""
    entries = F.map_entries(stars)
    total = F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e["value"])
    return F.round(F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["key"].cast("double") * e["value"]) / F.nullif(total, F.lit(0)), 1)


def option_share(options: Column, labels: list[str]) -> Column:
    low = [x.lower() for x in labels]
    return F.aggregate(F.filter(F.map_entries(options), lambda e: F.lower(e["key"]).isin(low)), F.lit(0).cast("long"), lambda a, e: a + e["value"])


def top_option(options: Column) -> Column:
    """The label of the largest share; of equals the first in the map."""
    entries = F.map_entries(options)
    most = F.array_max(F.map_values(options))
    return F.element_at(F.filter(entries, lambda e: e["value"] == most), 1)["key"]


def elapsed(log: DataFrame) -> DataFrame:
    """Stages in order with their seconds, never under zero."""
    return log.select("stage", "started_at", F.greatest(F.lit(0.0), (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6).alias("seconds"), "records_in", "records_out").orderBy("started_at", "stage")


def paid_usd(prompt: Column, completion: Column, reasoning: Column) -> Column:
    return (prompt * 0.15 + (completion + reasoning) * 0.60) / 1e6


def markdown(rows: DataFrame, title: str, *, limit: int = 200) -> str:
    """A report table as markdown, of at most ``limit`` rows."""
    found = rows.limit(limit).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in found)]) + "\n"


def product_summary(products: DataFrame, *, loose: tuple[str, ...] = LOOSE, tight: tuple[str, ...] = TIGHT, bad: tuple[str, ...] = BAD) -> DataFrame:
    """One row over products (fit and quality: maps of option -> share or null; average_rating; rating_distribution: map of star -> share or null).

    Means are over the products that have the map; an average is the reported one, else that of the distribution.
    """
    none = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    top = F.lower(F.when(none("fit"), top_option(F.col("fit"))))
    misfit = F.when(none("fit"), option_share(F.col("fit"), [*loose, *tight]))
    poor = F.when(none("quality"), option_share(F.col("quality"), list(bad)))
    derived = F.when(none("rating_distribution"), star_average(F.col("rating_distribution")))
    rows = products.select(top.alias("top"), misfit.alias("misfit"), poor.alias("poor"), "average_rating", derived.alias("derived"))
    return rows.agg(
        F.count("*").alias("products"), F.count("top").alias("products_with_fit"), F.count_if(F.col("top").isin(*loose)).alias("top_fit_is_loose"), F.count_if(F.col("top").isin(*tight)).alias("top_fit_is_tight"),
        F.round(F.avg("misfit"), 1).alias("mean_misfit_pct"), F.count("poor").alias("products_with_quality"), F.round(F.avg("poor"), 1).alias("mean_bad_quality_pct"),
        F.count("average_rating").alias("ratings_reported"), F.count_if(F.col("average_rating").isNull() & F.col("derived").isNotNull()).alias("ratings_derived"),
        F.count_if(F.coalesce("average_rating", "derived").isNull()).alias("ratings_unknown"), F.round(F.avg(F.coalesce("average_rating", "derived").cast("decimal(12,4)")), 2).cast("double").alias("mean_average_rating"),
    )


def overview(rows: DataFrame, intents: list[str]) -> DataFrame:
    """(kind, key, n): tagged rows (source, intent_class) by source (null: unknown) and by each of the fixed intents, zero where there is none."""
    by_source = rows.groupBy(F.coalesce("source", F.lit("unknown")).alias("key")).agg(F.count("*").alias("n")).select(F.lit("source").alias("kind"), "key", "n")
    counted = rows.agg(*[F.count_if(F.col("intent_class") == i).alias(i) for i in intents])
    return by_source.unionByName(counted.select(F.lit("intent").alias("kind"), F.inline(F.array(*[F.struct(F.lit(i).alias("key"), F.col(i).alias("n")) for i in intents]))))


def material_cells(matrix: DataFrame, *, lift: float = 2.0) -> DataFrame:
    """Cells of a segment matrix whose lift is material, the largest first."""
    return matrix.where(F.col("lift") >= lift).orderBy(F.desc("lift"), "segment", "blocker")


def excluded_labels(members: DataFrame, labels: list[str], prevalence: DataFrame | None = None) -> DataFrame:
    """(label, n): documents of each of ``labels`` (a prevalence table's count stands before the members' own), and all of them as ``any``."""
    own = members.where(F.col("label").isin(labels))
    names = members.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    n = names.join(own.groupBy("label").agg(F.countDistinct("doc_id").alias("own")), "label", "left")
    if prevalence is not None:
        n = n.join(prevalence.groupBy("label").agg(F.max("n_docs").alias("stated")), "label", "left")
    else:
        n = n.withColumn("stated", F.lit(None).cast("long"))
    return n.select("label", F.coalesce("stated", "own", F.lit(0)).alias("n")).unionByName(own.agg(F.countDistinct("doc_id").alias("n")).select(F.lit("any").alias("label"), "n"))


def fresh_or_fail(tagged_at: DataFrame, scores_written_at) -> None:
    """Refuses a report whose scores (written at a driver-side time) are older than the newest tag (column tagged_at)."""
    newest = tagged_at.agg(F.max("tagged_at")).first()[0]
    if newest is not None and newest > scores_written_at:
        raise ValueError(f"scores of {scores_written_at} are older than the newest tag of {newest}")


def report(title: str, sections: list[tuple[str, DataFrame | str]], *, limit: int = 200) -> str:
    """A whole report: sections are tables of few rows or finished text, in order."""
    body = [markdown(part, head, limit=limit) if isinstance(part, DataFrame) else f"## {head}\n\n{part}\n" for head, part in sections]
    return f"# {title}\n\n" + "\n".join(body)
