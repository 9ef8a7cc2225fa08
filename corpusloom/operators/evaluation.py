"""Sampling, allocation, label quality, gates, cost and batch packing."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.ordered import next_fit
from corpusloom.sources.tables import checkpointed


def allocate(counts: DataFrame, budget: int, *, by: str = "source", n: str = "n", floor: int = 0) -> DataFrame:
    """(by, n, take): a proportional split of ``budget`` by largest remainder, at least ``floor`` each and no more than there is.

    ``counts`` has a row per source. With fewer places than sources the largest get one each.
    """
    all_ = Window.partitionBy()
    rows = counts.withColumn("k", F.count("*").over(all_)).withColumn("room", F.col(n) - floor).withColumn("rest", F.lit(budget) - floor * F.col("k"))
    places = F.least(F.greatest(F.col("rest"), F.lit(0)), F.sum("room").over(all_))
    exact = places * F.col("room") / F.nullif(F.sum("room").over(all_), F.lit(0))
    rows = rows.withColumn("places", places).withColumn("exact", F.coalesce(exact, F.lit(0.0))).withColumn("base", F.floor("exact"))
    rows = rows.withColumn("left", F.col("places") - F.sum("base").over(all_))
    rows = rows.withColumn("rn", F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.col("base")), F.desc(n), by)))
    rows = rows.withColumn("big", F.row_number().over(Window.orderBy(F.desc(n), by)))
    take = F.when((F.lit(floor) > 0) & (F.lit(budget) < F.col("k")), (F.col("big") <= budget).cast("long")).otherwise(floor + F.col("base") + (F.col("rn") <= F.col("left")).cast("long"))
    return rows.select(by, n, F.least(take, F.col(n)).cast("long").alias("take"))


def drawn_order(key: str, seed: int) -> Column:
    """A seeded order that every engine reproduces: the digest of seed and id."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def stratified_draw(universe: DataFrame, takes: DataFrame, *, by: str = "source", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """The first ``take`` rows of each stratum in the seeded order. The largest take bounds what a task hands on of a stratum."""
    most = takes.agg(F.max("take")).first()[0] or 0
    w = Window.partitionBy(by).orderBy(drawn_order(key, seed), key)
    first = universe.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    return first.join(F.broadcast(takes.select(by, "take")), by).where("rn <= take").drop("rn", "take")


def draw_sample(universe: DataFrame, *, target: int, census: list[str], by: str = "source", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Rows of the ``census`` sources whole; what is left of ``target`` is split over the others in proportion (largest remainder) and drawn from each
    in the seeded order. Counts of sources, a fixed vocabulary, are counted on the way."""
    own = universe.where(F.col(by).isin(census))
    rest = universe.where(~F.coalesce(F.col(by).isin(census), F.lit(False)))
    takes = allocate(rest.groupBy(by).agg(F.count("*").alias("n")), max(0, target - own.count()), by=by)
    return own.unionByName(stratified_draw(rest, takes, by=by, key=key, seed=seed))


def equal_draw(pool: DataFrame, per_stratum: int, *, by: str, key: str = "doc_id", seed: int = 42) -> DataFrame:
    w = Window.partitionBy(by).orderBy(drawn_order(key, seed), key)
    return pool.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_stratum).drop("rn")


def label_scores(gold: DataFrame, pred: DataFrame, keys: tuple[str, ...] = ("doc_id", "label")) -> DataFrame:
    """(label, tp, fp, fn, support, precision, recall, f1), zeros where nothing was there to divide by."""
    both = gold.select(*keys).distinct().withColumn("g", F.lit(1)).join(pred.select(*keys).distinct().withColumn("p", F.lit(1)), list(keys), "full")
    n = both.groupBy(keys[-1]).agg(F.count_if(F.expr("g = 1 and p = 1")).alias("tp"), F.count_if(F.expr("g is null")).alias("fp"), F.count_if(F.expr("p is null")).alias("fn"))
    zero = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    n = n.withColumns({"support": F.col("tp") + F.col("fn"), "precision": zero(F.col("tp"), F.col("tp") + F.col("fp")), "recall": zero(F.col("tp"), F.col("tp") + F.col("fn"))})
    return n.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(scores: DataFrame) -> DataFrame:
    """The mean over labels that either side used; null without any."""
    return scores.where("support > 0 or fp > 0").agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("n_labels"))


def gold_scores(gold: DataFrame, pred: DataFrame, *, gated: str, gate: float = 0.65) -> DataFrame:
    """(dimension, macro_f1, n_labels, passes) of label rows (doc_id, dimension, label), and a row for all dimensions together (null).

    A macro mean is over the labels that either side used. ``passes`` says whether ``gated`` reaches ``gate``; of the others it is null.
    """
    name = F.concat_ws("=", "dimension", "label").alias("label")
    each = label_scores(gold.select("doc_id", name), pred.select("doc_id", name)).where("support > 0 or fp > 0").withColumn("dimension", F.substring_index("label", "=", 1))
    rows = each.groupBy("dimension").agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("n_labels"))
    whole = each.agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("n_labels")).select(F.lit(None).cast("string").alias("dimension"), "macro_f1", "n_labels")
    return rows.unionByName(whole).withColumn("passes", F.when(F.col("dimension") == gated, F.col("macro_f1") >= gate))


def accuracy(gold: DataFrame, pred: DataFrame, *, key: str = "doc_id", value: str = "intent_class") -> DataFrame:
    """One row: gold rows, those whose prediction has the same value (a missing one is an empty text), and the share (0 without rows)."""
    held = F.coalesce(F.col(value), F.lit("")) == F.coalesce("__p", F.lit(""))
    n = gold.join(pred.select(key, F.col(value).alias("__p")), key, "left").agg(F.count("*").alias("n"), F.count_if(held).alias("n_correct"))
    return n.withColumn("accuracy", F.coalesce(F.col("n_correct") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)))


def gate(rows: DataFrame, *, by: str, wrong: Column, limit: float = 0.1) -> DataFrame:
    """Per stratum the rate of wrong rows and whether it is strictly under ``limit``; ``all_pass`` holds for the whole."""
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(wrong).alias("n_wrong")).withColumn("rate", F.col("n_wrong") / F.col("n")).withColumn("passes", F.col("rate") < limit)
    return g.withColumn("all_pass", F.min("passes").over(Window.partitionBy()))


def cost_model(pending: DataFrame, *, batch: int = 6, tokens_per_doc: int = 645, prompt_share: float = 0.72, prompt_usd: float = 0.15, completion_usd: float = 0.60, per_day: int = 200_000) -> DataFrame:
    """One row: documents, calls, tokens, dollars (prices a million tokens) and days at a daily limit."""
    n = pending.agg(F.count("*").alias("n_docs"))
    tokens = F.col("n_docs") * tokens_per_doc
    usd = tokens * prompt_share * prompt_usd / 1e6 + tokens * (1 - prompt_share) * completion_usd / 1e6
    return n.select("n_docs", F.ceil(F.col("n_docs") / batch).alias("calls"), tokens.alias("tokens"), usd.alias("usd"), F.ceil(tokens / per_day).alias("days"))


def running_total(rows: DataFrame, *, order: str, value: str, out: str) -> DataFrame:
    """Adds ``out``, the sum of ``value`` up to and with a row in the order of ``order``: sums over range partitions (a row each) are added up in one
    window, those within a partition in a window of its own, so no task sees all rows."""
    placed = checkpointed(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    sums = placed.groupBy("__part").agg(F.sum(value).alias("__sum"))
    bases = sums.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    within = F.sum(value).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("__in", within).join(F.broadcast(bases), "__part").withColumn(out, F.col("__base") + F.col("__in")).drop("__part", "__in", "__base")


def budget_stop(batches: DataFrame, *, limit: int, order: str = "batch", tokens: str = "tokens") -> DataFrame:
    """The batches before the one that would pass the budget."""
    return running_total(batches, order=order, value=tokens, out="used").where(F.col("used") <= limit)


def pack_batches(docs: DataFrame, *, by: str, order: str, tokens: str, max_count: int, budget: int) -> DataFrame:
    """Next-fit batches within each ``by``: a batch closes at ``max_count`` documents or where the next would pass ``budget`` tokens. No task holds a whole
    ``by`` (``ordered.next_fit``)."""
    return next_fit(docs, by=by, order=order, tokens=tokens, max_count=max_count, budget=budget)


def fit_batches(docs: DataFrame, *, by: str, order: str, max_count: int, max_doc_tokens: int, input_budget: int, overhead: int) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the text that a request carries, ``cut``, its ``tokens`` and its batch: a document that is too long for a
    request, or over ``max_doc_tokens``, is cut, none is dropped."""
    room = max(1, input_budget - overhead)
    fitted, cut = T.fit_document(F.col("doc_id"), F.coalesce("text", F.lit("")), min(max_doc_tokens, room))
    rows = docs.withColumn("cut", cut).withColumn("text", fitted).withColumn("tokens", T.line_tokens(F.col("doc_id"), F.col("text")))
    return pack_batches(rows, by=by, order=order, tokens="tokens", max_count=max_count, budget=room)


def tag_with(docs: DataFrame, tagger: Callable[[Iterable[tuple[int, str]]], Iterable[tuple[int, list[str]]]], cache: DataFrame | None = None) -> DataFrame:
    """(doc_id, labels) of documents that ``cache`` lacks, by any tagger that takes and gives batches; append the result to the cache to resume."""
    todo = docs.select("doc_id", "text") if cache is None else docs.select("doc_id", "text").join(cache.select("doc_id"), "doc_id", "left_anti")

    def run(frames):
        for pdf in frames:
            got = dict(tagger(zip(pdf["doc_id"], pdf["text"], strict=True)))
            yield pd.DataFrame({"doc_id": list(got), "labels": [list(v) for v in got.values()]})

    return todo.mapInPandas(run, "doc_id long, labels array<string>")


def cue_tagger(cues: dict[str, list[str]]):
    """The offline tagger: a label holds where one of its cues is in the lower-cased text."""

    def tag(batch):
        for doc, text in batch:
            low = (text or "").lower()
            yield doc, [label for label, words in sorted(cues.items()) if any(w in low for w in words)]

    return tag


def evidence_precision(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: quotes, those that their document holds, and the share (null without quotes). A quote of an unknown document is not held."""
    held = F.coalesce(T.contains_quote(F.col("text"), F.col("quote")), F.lit(False))
    n = spans.select("doc_id", "quote").join(docs.select("doc_id", "text"), "doc_id", "left").agg(F.count("*").alias("n_quotes"), F.count_if(held).alias("n_contained"))
    return n.withColumn("precision", F.col("n_contained") / F.nullif(F.col("n_quotes"), F.lit(0)))


def representative_sample(rows: DataFrame, size: int, *, by: str = "bucket", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Exactly ``size`` rows in the proportions of ``by``, with ``draw``, a number for each time that a row is in the sample.

    A bucket gives its share, rounded half to even and no more than it has; what rounding leaves open is filled from all other rows, what it
    gives too much is cut from the last buckets. Where ``size`` is more than all rows, each is there once for every whole time that they fit
    in it. ``by`` is a fixed vocabulary: its counts are collected. An empty table gives no rows.
    """
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    whole, part = divmod(size, total) if total else (0, 0)
    left, takes = part, {}
    for name in sorted(counts, key=lambda b: (b is None, b)):
        takes[name] = min(round(part * counts[name] / total), counts[name], left)
        left -= takes[name]
    ranked = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(by).orderBy(drawn_order(key, seed), key)))
    take = F.lit(0)
    for name, n in takes.items():
        take = F.when(F.col(by).eqNullSafe(F.lit(name)), n).otherwise(take)
    first = ranked.where(F.col("__rn") <= max([0, *takes.values()]) + left).withColumn("__take", take)
    drawn = first.where("__rn <= __take")
    if left:
        drawn = drawn.unionByName(first.where("__rn > __take").orderBy(drawn_order(key, seed), key).limit(left))
    drawn = drawn.drop("__rn", "__take").withColumn("draw", F.lit(whole))
    again = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(whole - 1)))) if whole else rows.withColumn("draw", F.lit(0)).limit(0)
    return again.unionByName(drawn)


def complete_or_fail(gold: DataFrame, pred: DataFrame, *, key: str = "doc_id", label: str = "label") -> DataFrame:
    """``gold`` itself; the query fails when a gold row has no label yet or no prediction. One counted row decides, nothing is multiplied."""
    n = gold.join(pred.select(key).distinct().withColumn("__there", F.lit(True)), key, "left").agg(F.count_if(F.col(label).isNull()).alias("__open"), F.count_if(F.col("__there").isNull()).alias("__missing"))
    bad = F.raise_error(F.concat(F.lit("gold rows without a label: "), F.col("__open").cast("string"), F.lit(", without a prediction: "), F.col("__missing").cast("string"))).cast("boolean")
    return gold.join(F.broadcast(n), how="cross").where(F.when((F.col("__open") == 0) & (F.col("__missing") == 0), True).otherwise(bad)).drop("__open", "__missing")


def manifest_check(sources: DataFrame, manifests: DataFrame) -> DataFrame:
    """(source, status, records, passes): every enabled source has a finished manifest with records."""
    rows = sources.select("source").distinct().join(manifests.select("source", "status", "records"), "source", "left")
    return rows.select("source", F.coalesce("status", F.lit("missing")).alias("status"), F.coalesce("records", F.lit(0)).cast("long").alias("records"), F.coalesce((F.col("status") == "ok") & (F.col("records") > 0), F.lit(False)).alias("passes"))


def floor_gate(rows: DataFrame, *, wanted: Column, survives: Column, floor: int) -> DataFrame:
    """One row: wanted rows, those that survive, the share, and whether the survivors reach the floor."""
    n = rows.where(wanted).agg(F.count("*").alias("n"), F.count_if(survives).alias("n_surviving"))
    return n.select("n", "n_surviving", (F.col("n_surviving") / F.nullif(F.col("n"), F.lit(0))).alias("rate"), (F.col("n_surviving") >= floor).alias("passes"))


def fingerprint_of(rows: DataFrame) -> tuple[int, str]:
    """Rows and an order-free digest of a result: two passes are the same when both agree."""
    got = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).alias("h")).first()
    return got["n"], str(got["h"])
