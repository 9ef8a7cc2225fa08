"""SpotSigs document fingerprints: chains of content words that follow common-word anchors. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._base import text_or_empty, written

# Common words (articles, prepositions, forms of "be") of English, German, French and Spanish that serve as anchors.
ANCHORS = (
    "a an and are as at be by for from had has have in is it of on or that the this to was were with "
    "auf das dem den der des die ein eine im ist mit nicht sich und von zu "
    "au dans des du en est et la le les par pour que qui un une "
    "al como con de del el es las los no por se su y"
).split()
#: Signs that end a sentence, a line or a cell; a run of them is an anchor too, and so is the start of a text.
BOUNDS = ".!?:;|\n\r\u2026^"


def with_signatures(df: DataFrame, text: str, out: str, chain: int = 2) -> DataFrame:
    """Adds ``out``, the sorted set of 32-bit signatures of the column ``text``.

    A signature is the hash of an anchor (a common word, a run of ``BOUNDS``, the text's start) and the next ``chain`` content words after it,
    whatever anchors stand between; at a text's end the chain has the words that are left. The rule is the same for every text: one without
    common words has its start and bounds, one without words the signature of the bare start, so the set is never empty.
    """
    anchor = "|".join(sorted(set(ANCHORS), key=lambda w: (-len(w), w)))
    bounded = F.concat(F.lit("^"), F.translate(F.lower(text), BOUNDS, "^" * len(BOUNDS)), F.lit("^"))
    words = F.regexp_replace(F.regexp_replace(bounded, r"[^\p{L}\p{N}^]+", " "), r" ?\^[\^ ]*", " ^ ")
    # An anchor is tied to the word before it by a hash sign: what is between blanks is then a content word with the anchors after it.
    df = df.withColumn("__marked", F.regexp_replace(words, rf" (?=(?:{anchor}|\^) )", "#"))
    spots = F.regexp_extract_all("__marked", F.lit(rf"(?=#([^ #]+[^ ]*(?: [^ #]+[^ ]*){{0,{chain}}}))"), F.lit(1))
    df = df.withColumn("__found", F.array_distinct(F.transform(spots, lambda s: F.crc32(F.regexp_replace(s, "#[^ ]*", "")))))
    # The bound after the last word has no words to chain; it stands for a text without any.
    some = F.when(F.size("__found") > 1, F.array_remove("__found", F.crc32(F.lit("^")))).otherwise(F.col("__found"))
    return df.withColumn(out, F.sort_array(some)).drop("__marked", "__found")


def packed(sigs: Column) -> Column:
    """The fingerprint: the signatures of a set as hexadecimal digits, eight each, in order."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.hex(s), 8, "0")), "")


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def next_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next document in descending doc_id order, the first after the last, without a global sort in one task.

    Ids are range-partitioned; within a partition a window gives the next, and the edges of partitions (a row per partition, whose number the
    session sets) are closed with a small join. Null ids have no place in the order and are left out; repeated ids count once.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    placed = written(ids.repartitionByRange(F.desc("doc_id")).withColumn("part", F.spark_partition_id()), "next-ids")
    edges = placed.groupBy("part").agg(F.max("doc_id").alias("high"))
    one = Window.orderBy("part")  # a row per partition
    follow = F.coalesce(F.lead("high").over(one), F.first("high").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    first_after = edges.select("part", follow.alias("follow"))
    within = placed.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.desc("doc_id"))))
    return within.join(F.broadcast(first_after), "part").select("doc_id", F.coalesce("next_id", "follow").alias("next_id"))


def compare_edited(docs: DataFrame, *, chain: int = 2) -> DataFrame:
    """Fingerprints each text and its edited text, whose last floor(n/2) code points are replaced by the first as many of the next document's.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts are empty. Rows that repeat a
    doc_id each give a row; where the next id repeats, its greatest text is taken. A row without doc_id has no next document: its edited text
    keeps its first half and its near_next is null. An empty table gives an empty result.
    """
    # Renamed, so that the plans of both joins have the same projection and share one exchange of the texts.
    body = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    sizes = body.groupBy("id").agg(F.max(F.char_length("text")).alias("size"))
    order = written(next_documents(docs).withColumnRenamed("doc_id", "id").join(sizes, "id"), "next-order")
    ask = order.select(F.col("id").alias("asker"), F.col("next_id").alias("id"), F.floor(F.col("size") / 2).cast("int").alias("need"))
    placed = body.where("id is not null").repartition("id")
    given = (
        with_signatures(placed.join(ask.hint("merge"), "id"), "text", "a", chain)
        .select(F.col("asker").alias("id"), F.struct(F.col("text").substr(F.lit(1), F.col("need")).alias("head"), F.col("a").alias("sigs")).alias("given"))
        .groupBy("id").agg(F.max("given").alias("given"))
    )
    n = F.char_length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    alone = body.where("id is null").withColumn("given", F.lit(None).cast(given.schema["given"].dataType))
    both = with_signatures(placed.join(given.hint("merge"), "id", "left").unionByName(alone), "text", "a", chain).select(
        F.col("id").alias("doc_id"), n.alias("n_chars"), "a", F.col("given.sigs").alias("next_sigs"),
        F.concat(F.col("text").substr(F.lit(1), (n - half).cast("int")), F.coalesce(F.col("given.head").substr(F.lit(1), half), F.lit(""))).alias("edited"),
    )
    sigs = with_signatures(both, "edited", "b", chain)
    return sigs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("a")).alias("fingerprint"), packed(F.col("b")).alias("edited_fingerprint"), jaccard(F.col("a"), F.col("b")).alias("near_edited"), jaccard(F.col("a"), F.col("next_sigs")).alias("near_next"))


def near_pairs(docs: DataFrame, *, threshold: float = 0.8, chain: int = 2) -> DataFrame:
    """(a, b, similarity): pairs of fingerprint classes, each named by its smallest doc_id, whose signature sets have Jaccard >= threshold.

    Equal sets form one class first. Sets meet through the rarest signatures of their prefix (a pair over the threshold shares one of the
    first n - ceil(threshold * n) + 1 signatures in a global rarest-first order) within neighbouring length partitions, whose bounds grow by
    1 / threshold; the length bound prunes before sets are compared. A class without doc_id is left out. Empty input gives no pairs.
    """
    sets = with_signatures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), "text", "sigs", chain).where("doc_id is not null")
    sets = written(sets.groupBy("sigs").agg(F.min("doc_id").alias("doc_id")), "spot-sets")
    n = F.size("sigs")
    rare = sets.select("doc_id", n.alias("n"), F.explode("sigs").alias("sig"))
    df = rare.groupBy("sig").agg(F.count("*").alias("n_sets"))
    ranked = rare.join(df, "sig").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("n_sets", "sig"))).alias("ranked"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    bucket = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)))
    heads = ranked.select("doc_id", "n", bucket.alias("bucket"), F.explode(F.transform(F.slice("ranked", 1, keep.cast("int")), lambda s: s["sig"])).alias("sig"))
    probe = heads.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)))
    found = (
        heads.alias("x").join(probe.alias("y"), (F.col("x.sig") == F.col("y.sig")) & (F.col("x.bucket") == F.col("y.bucket")))
        .where("x.doc_id <> y.doc_id")
        .where(F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * threshold)
        .select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    )
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("sigs").alias(f"{c}_sigs"))
    return found.join(side("a"), "a").join(side("b"), "b").withColumn("similarity", jaccard(F.col("a_sigs"), F.col("b_sigs"))).where(F.col("similarity") >= threshold).select("a", "b", "similarity")
