"""Evidence quotes: screening, selection, containment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.tables import checkpointed


def flags(spans: DataFrame, docs: DataFrame, cues: dict[str, dict[str, list[str]]]) -> DataFrame:
    """``spans`` (doc_id, dimension, label, quote) with three flags: not in the document, no cue of its label in it, quoted twice on the document.

    ``cues``: dimension -> label -> cue texts. A label without cues never lacks one; a blank quote is in no document and never counts as
    quoted twice. A span of an unknown document is not in it.
    """
    q = T.norm(F.coalesce(F.col("quote"), F.lit("")))
    lexicon = [(d, label, " ".join(w.lower().split())) for d, labels in cues.items() for label, words in labels.items() for w in words if w.strip()]
    rows = spans.sparkSession.createDataFrame(lexicon, "dimension string, label string, cue string")
    known = rows.groupBy("dimension", "label").agg(F.sort_array(F.collect_set("cue")).alias("cues"))  # a fixed vocabulary
    held = F.exists("cues", lambda c: F.contains(q, c))
    twice = (q != "") & (F.count("*").over(Window.partitionBy("doc_id", q)) > 1)
    joined = spans.join(docs.select("doc_id", "text"), "doc_id", "left").join(F.broadcast(known), ["dimension", "label"], "left")
    absent = ~F.coalesce(T.contains_quote(F.col("text"), F.col("quote")), F.lit(False))
    return joined.select("doc_id", "dimension", "label", "quote", absent.alias("not_in_document"), F.coalesce(~held, F.lit(False)).alias("no_cue_overlap"), twice.alias("quoted_twice"))


def document_flags(members: DataFrame, flagged: DataFrame) -> DataFrame:
    """(doc_id, label, is_flagged): any span of the label has a flag, or it has no span."""
    bad = flagged.groupBy("doc_id", "label").agg(F.bool_or(F.expr("not_in_document or no_cue_overlap or quoted_twice")).alias("bad"))
    return members.join(bad, ["doc_id", "label"], "left").select("doc_id", "label", F.coalesce("bad", F.lit(True)).alias("is_flagged"))


def select_quotes(candidates: DataFrame, *, limit: int = 4) -> DataFrame:
    """Per theme up to ``limit`` quotes: one of each source first, then the rest, by cue overlap, severity, source, document.

    ``candidates``: theme, source, doc_id, quote, overlap, severity. Quotes are shown redacted, escaped and truncated; equal ones count once.
    """
    shown = T.truncate(T.escape_markdown(T.redact_shown(F.col("quote"))))
    rows = candidates.withColumn("quote", shown)
    best = [F.desc("overlap"), F.desc("severity"), F.asc("source"), F.asc("doc_id")]
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("theme", "quote").orderBy(*best))).where("rn = 1")
    rows = rows.withColumn("rs", F.row_number().over(Window.partitionBy("theme", "source").orderBy(*best)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("theme").orderBy(F.desc(F.col("rs") == 1), *best))).where(F.col("place") <= limit).drop("rn", "rs")


def contained(quotes: DataFrame, docs: DataFrame, *, words: int = 6) -> DataFrame:
    """(item_id, doc_id) where a document has the whole normalised quote.

    A quote's first and last word may begin or end within a word of the document; those between are whole words there. So candidates share a
    run of up to ``words`` inner words: of a quote's runs the one that the fewest quotes have. Quotes of one or two words have no inner word: they are
    looked up in the vocabulary (``_short``). Blank quotes are in none; null texts hold nothing.
    """
    flat = lambda c: F.split(T.norm(F.col(c)), " ")
    run = lambda w, at, n: F.xxhash64(F.array_join(F.slice(w, at, n), " "))
    q = checkpointed(quotes.select("item_id", T.norm(F.col("text")).alias("quote"), flat("text").alias("w")).where("quote <> ''"))
    q = q.withColumn("n", F.least(F.lit(words), F.size("w") - 2))
    runs = q.where("n > 0").select("item_id", "n", F.posexplode(F.transform(F.sequence(F.lit(2), F.size("w") - F.col("n")), lambda i: run(F.col("w"), i, F.col("n")))).alias("pos", "run"))
    counted = runs.groupBy("run").agg(F.count("*").alias("times"))
    rare = checkpointed(runs.join(counted, "run").groupBy("item_id", "n").agg(F.min_by("run", F.struct("times", "pos")).alias("run")))
    sizes = [r["n"] for r in rare.select("n").distinct().collect()]  # at most ``words``
    texts = docs.where("text is not null")
    d = texts.select("doc_id", flat("text").alias("w"))
    every = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: run(F.col("w"), i, n)))
    own = [d.select("doc_id", F.explode(F.array_distinct(every(n))).alias("run"), F.lit(n).alias("n")) for n in sizes]
    hits = [x.join(rare, ["run", "n"]).select("doc_id", "item_id") for x in own]
    full = [h.distinct().join(texts.select("doc_id", "text"), "doc_id").join(q.select("item_id", "quote"), "item_id") for h in hits]
    few = q.where("n <= 0").select("item_id", "w")
    none = q.sparkSession.createDataFrame([], quotes.select("item_id").schema).join(docs.select("doc_id").limit(0), how="cross")
    found = [f.where(F.contains(T.norm(F.col("text")), F.col("quote"))).select("item_id", "doc_id") for f in full]
    if not few.isEmpty():
        found.append(_short(few, d))
    return reduce(DataFrame.unionByName, found, none.select("item_id", "doc_id"))


def _short(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) of quotes of one or two words (item_id, w) in documents (doc_id, w).

    One word may lie anywhere within a word of the document; of two the first ends one and the second begins the next. So quotes meet the vocabulary
    first: its words list their parts, ends or beginnings of the lengths that quotes have, and join on them. The words found then meet the postings:
    a word and the one after it, once for each document that has them. A word that very many documents have is one of many keys of a plain
    equi-join, whose large partitions are split as the query runs.
    """
    pairs = docs.select("doc_id", F.explode(F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.struct(a.alias("one"), b.alias("next")))).alias("x")).where("x.one is not null").select("doc_id", "x.one", "x.next").distinct()
    pairs = checkpointed(pairs)
    vocabulary = checkpointed(pairs.select(F.col("one").alias("word")).distinct())

    def words(column: Column, parts: str) -> DataFrame:
        """(item_id, word): vocabulary that holds the quotes' word as its part, end or beginning."""
        asked = quotes.select("item_id", column.alias("part")).where("part is not null")
        sizes = F.array(*[F.lit(r[0]) for r in asked.select(F.char_length("part")).distinct().collect()]).cast("array<int>")  # lengths of words
        fits = F.filter(sizes, lambda n: n <= F.char_length("word"))
        cut = {
            "any": lambda n: F.transform(F.sequence(F.lit(1), F.char_length("word") - n + 1), lambda i: F.substr("word", i, n)),
            "end": lambda n: F.array(F.right("word", n)),
            "begin": lambda n: F.array(F.left("word", n)),
        }[parts]
        keys = vocabulary.select("word", F.explode(F.array_distinct(F.flatten(F.transform(fits, cut)))).alias("part"))
        return asked.join(keys, "part").select("item_id", "word")

    one, two = F.when(F.size("w") == 1, F.get("w", F.lit(0))), lambda i: F.when(F.size("w") == 2, F.get("w", F.lit(i)))
    alone = words(one, "any").join(pairs.select("doc_id", F.col("one").alias("word")).distinct(), "word")
    first = words(two(0), "end").withColumnRenamed("word", "one").join(pairs, "one")
    both = first.join(words(two(1), "begin").withColumnRenamed("word", "next"), ["item_id", "next"])
    return alone.select("item_id", "doc_id").union(both.select("item_id", "doc_id")).distinct()


def select_in_turn(candidates: DataFrame, themes: list[str], *, limit: int = 4) -> list[dict]:
    """Quotes of ``themes`` in their order, where no theme shows a quote that one before it showed; within a theme as ``select_quotes`` picks.

    Earlier themes can take at most ``limit`` quotes each, so of each theme and source the first ``limit`` times the number of themes decide;
    only those reach the driver (themes and sources are fixed vocabularies).
    """
    shown = T.truncate(T.escape_markdown(T.redact_shown(F.col("quote"))))
    best = [F.desc("overlap"), F.desc("severity"), F.asc("source"), F.asc("doc_id")]
    rows = candidates.where(F.col("theme").isin(themes)).withColumn("quote", shown)
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("theme", "quote").orderBy(*best))).where("rn = 1")
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("theme", "source").orderBy(*best))).where(F.col("rn") <= limit * len(themes))
    found = [r.asDict() for r in rows.drop("rn").collect()]
    used: set[str] = set()
    out = []
    for theme in themes:
        own = sorted((r for r in found if r["theme"] == theme and r["quote"] not in used), key=lambda r: (-r["overlap"], -r["severity"], r["source"], r["doc_id"]))
        heads: dict[str, dict] = {}
        for r in own:
            heads.setdefault(r["source"], r)
        first = list(heads.values())
        picked = [*first, *(r for r in own if heads[r["source"]] is not r)][:limit]
        used.update(r["quote"] for r in picked)
        out += [{**r, "place": i} for i, r in enumerate(picked, 1)]
    return out


def appendix_lines(quotes: DataFrame) -> DataFrame:
    """(theme, place, line): quotes (theme, place, source, doc_id, url, quote) as the lines of an appendix; ``listings.read_appendix`` reads them back."""
    ident = F.concat(F.lit("`"), F.col("doc_id").cast("string"), F.lit("`"))
    cite = F.when(F.col("url").isNotNull(), F.concat(F.lit("["), ident, F.lit("]("), F.col("url"), F.lit(")"))).otherwise(ident)
    return quotes.select("theme", "place", F.concat(F.lit("- **"), F.col("source"), F.lit("** "), cite, F.lit(": "), F.col("quote")).alias("line"))
