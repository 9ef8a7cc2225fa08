"""Hand-collected sources: files of unknown encoding, threads, directive files, embedded product reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def decoded(content: Column) -> Column:
    """Text of a file's bytes by its byte-order mark (UTF-32, UTF-16, UTF-8), else UTF-8 with bad bytes replaced; the mark itself goes."""
    head = F.hex(F.substring(content, 1, 4))
    utf8 = F.decode(content, "UTF-8")
    text = F.when(head.isin("FFFE0000", "0000FEFF"), F.decode(content, "UTF-32")).when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(content, "UTF-16")).otherwise(utf8)
    return F.regexp_replace(text, r"^\x{FEFF}", "")


def read_files(spark: SparkSession, folder: str, suffix: str = "txt") -> DataFrame:
    """(file, text) of a folder's files, without README files and names that begin with ``_`` or ``.``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(folder).select(F.col("path").alias("file"), "content")
    return files.where(~F.col("file").rlike(r"(?i)/(?:readme[^/]*|[._][^/]*)$")).select("file", decoded(F.col("content")).alias("text"))


def split_thread(df: DataFrame, *, min_chars: int = 40) -> DataFrame:
    """(file, question, pos, answer): the first paragraph that ends in a question mark, and later paragraphs of at least ``min_chars``."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    rows = df.select("file", parts.alias("p")).withColumn("question", F.get(F.filter("p", lambda p: p.endswith("?")), F.lit(0)))
    out = rows.select("file", "question", F.posexplode("p").alias("pos", "answer"))
    return out.where((F.col("answer") != F.coalesce("question", F.lit(""))) & (F.char_length("answer") >= min_chars))


def directive_blocks(df: DataFrame) -> DataFrame:
    """(file, product, kind, block, body) of files with ``product:`` lines and ``[reviews]`` / ``[qa]`` heads, blocks parted by empty lines.

    Product and kind carry forward; a block without either is passed over.
    """
    lines = df.select("file", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    product = F.regexp_extract("line", r"(?i)^\s*product:\s*(\S+)\s*$", 1)
    kind = F.lower(F.regexp_extract("line", r"(?i)^\s*\[(reviews?|qa)\]\s*$", 1))
    lines = lines.withColumn("product", F.last(F.when(product != "", product), ignorenulls=True).over(w)).withColumn("kind", F.last(F.when(kind != "", F.when(kind == "qa", "qa").otherwise("review")), ignorenulls=True).over(w))
    lines = lines.withColumn("block", F.sum((F.trim("line") == "").cast("int")).over(w)).where((F.trim("line") != "") & (product == "") & (kind == ""))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return lines.where("product is not null and kind is not null").groupBy("file", "product", "kind", "block").agg(body.alias("body"))


def review_block(body: Column) -> Column:
    """rating, text, author and date of a block such as ``4/5 Fits well.\\nby A. Name, 3 March 2024``."""
    rating = F.regexp_extract(body, r"^\s*([1-5])\s*(?:/\s*5|stars?)", 1).try_cast("int")
    tail = r"(?im)^\s*by\s+([^,\n]+)(?:,\s*(.+))?\s*$"
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, tail, ""), r"(?i)^\s*[1-5]\s*(?:/\s*5|stars?)\s*[:.-]?\s*", ""), r"^\s+|\s+$", "")
    return F.struct(rating.alias("rating"), text.alias("text"), F.nullif(F.regexp_extract(body, tail, 1), F.lit("")).alias("author"), F.nullif(F.regexp_extract(body, tail, 2), F.lit("")).alias("date"))


def json_ld_reviews(html: Column) -> Column:
    """Review texts and ratings of schema.org scripts of a page."""
    scripts = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    review = "array<struct<reviewBody:string,reviewRating:struct<ratingValue:string>,author:struct<name:string>,datePublished:string>>"
    return F.flatten(F.transform(scripts, lambda s: F.coalesce(F.from_json(s, f"struct<review:{review}>")["review"], F.array().cast(review))))


def first_list(payload: Column, keys: list[str], element: str) -> Column:
    """The first list under one of ``keys``, at the top or under ``data`` or ``result``."""
    paths = [f"$.{p}{k}" for p in ("", "data.", "result.") for k in keys]
    return F.coalesce(*[F.from_json(F.get_json_object(payload, p), f"array<{element}>") for p in paths])


def latest_manifest(manifests: DataFrame) -> DataFrame:
    """The newest manifest of each source (source, run_date, status, records)."""
    return manifests.groupBy("source").agg(F.max_by(F.struct("run_date", "status", "records"), F.struct("run_date", "records")).alias("m")).select("source", "m.*")
