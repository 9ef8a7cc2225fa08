"""A training corpus from raw documents: toxic documents go, repeated lines go, near copies go, domains are mixed, what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again for the next. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import chosen_path, lines, mixing, packing, toxicity
from corpusloom.llm._base import nested, unnested, written
from corpusloom.llm.queries import TOKENIZERS, domains_of, table


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with n_chars as the text now has it."""
    return df.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in like.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores 0.7 or more go. Null and empty texts stay; each row of a repeated id is judged by its text; an empty table
    stays empty; rows without label, or with a null one, teach nothing."""
    lex = toxicity.fit_lexicon(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    scored = toxicity.score_documents(docs.select(nested(docs), "text"), lex)
    return scored.where("score < 0.7").select(*unnested(docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 or more code points that three or more documents hold stay in the largest doc_id alone; every row stays. Null texts become
    empty; rows of one doc_id are one document, rows without id another; an empty table stays empty."""
    return _columns(lines.dedup_lines(docs), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays (five words, similarity 0.8), that of the smallest doc_id. Null and empty texts are copies
    of each other; texts without words are near to equal ones alone; of rows with equal id and text one stays; an empty table stays empty."""
    return chosen_path.keep_one(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated until the domains' expected tokens are as the power 0.7 of what they were; rates are 1 at least, so none is lost. Repeats
    are wanted: they are equal rows, and each is packed. Null texts have no tokens and the rate of their posterior; without labels all rates
    are 1; an empty table stays empty."""
    return mixing.mix(docs, domains_of(docs, table(spark, sf_dir, "labels")), min_rate=1.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence of at most 1024 tokens and its offset there. Null and empty texts have their end id; equal
    rows are packed each; an empty table gives no rows."""
    return packing.pack_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_copies), ("mixing", mix_domains), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
