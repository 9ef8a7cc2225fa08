"""Language identification: a naive Bayes classifier over hashed character n-grams, learnt from rows whose language is known."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from corpusloom.sources.tables import bounded_batches

#: N-grams of these lengths fall into so many buckets, whatever the corpus, so a model has a fixed size.
ORDERS, BUCKETS = (1, 2, 3, 4), 1 << 14
#: Code points that are worked off at once.
BLOCK = 1 << 18
#: Languages that a model may have: a closed vocabulary.
MOST = 256
GUESS = StructType([StructField("lang", StringType()), StructField("p", DoubleType())])


def letters(text: Column) -> Column:
    """Letters in lower case; anything between them is one blank. Digits, marks and punctuation say nothing of a language."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]+", " "))


def _blocks(texts: list[str | None]):
    """(texts, code points) in blocks of about ``BLOCK`` code points, as (index of the text, piece) lists; pieces of a long text overlap so far that every n-gram
    that begins in a piece ends in it. What begins after its ``own`` code points is the next piece's."""
    held, size = [], 0
    for i, text in enumerate(texts):
        t = text or ""
        for at in range(0, len(t), BLOCK):
            piece = t[at : at + BLOCK + max(ORDERS) - 1]
            held.append((i, piece, min(BLOCK, len(t) - at)))
            size += len(piece)
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _grams(texts: list[str | None]):
    """(text, bucket) of every n-gram of every text, by blocks and orders: the arrays at hand do not grow with the texts."""
    for block in _blocks(texts):
        sizes = [len(t) for _, t, _ in block]
        codes = np.frombuffer("".join([t for _, t, _ in block]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        piece, ends = np.repeat(np.arange(len(block)), sizes), np.cumsum(sizes)
        of = np.array([i for i, _, _ in block])[piece]
        first = np.arange(len(codes)) < (ends - sizes + np.array([n for *_, n in block]))[piece]
        for n in ORDERS:
            size = len(codes) - n + 1
            if size <= 0:
                break
            h = np.full(size, n, np.int64)
            for j in range(n):
                h = h * 31 + codes[j : j + size]
            inside = (piece[:size] == piece[n - 1 :]) & first[:size]
            yield of[:size][inside], h[inside] % BUCKETS


@dataclass(frozen=True)
class Model:
    """``weights``: log-likelihoods, a row per bucket and a column per language."""

    langs: list[str]
    weights: np.ndarray

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        """A row per text. Orders of n-grams say much the same, so a text's log-likelihood is their mean."""
        scores = np.zeros((len(texts), len(self.langs)))
        for of, at in _grams(texts):
            low = int(of[0]) if len(of) else 0
            for k in range(len(self.langs) if len(of) else 0):
                sums = np.bincount(of - low, self.weights[at, k])
                scores[low : low + len(sums), k] += sums
        scores /= len(ORDERS)
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)


def fit(rows: DataFrame, *, text: str = "text", lang: str = "lang") -> Model:
    """Counts n-grams of all ``rows`` with a language. Each task sums its own; the driver sees a row per bucket and language."""

    def run(batches):
        seen = {}
        for b in batches:
            names = b.column(1).to_pylist()
            vocabulary = sorted(set(names))
            which = np.searchsorted(vocabulary, names)
            sums = np.zeros(len(vocabulary) * BUCKETS, np.int64)
            for of, at in _grams(b.column(0).to_pylist()):
                sums += np.bincount(which[of] * BUCKETS + at, minlength=len(sums))
            for name, n in zip(vocabulary, sums.reshape(-1, BUCKETS), strict=True):
                seen[name] = seen.get(name, 0) + n
            if len(seen) > MOST:
                raise ValueError(f"over {MOST} languages")
        for name, n in seen.items():
            keys = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int32()), pa.array(n[keys], pa.int64())], ["lang", "bucket", "n"])

    bounded_batches(rows.sparkSession)
    known = rows.where(F.col(lang).isNotNull()).select(letters(F.col(text)).alias("t"), F.col(lang).cast("string").alias("lang"))
    counts = known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = counts.column("lang").to_pylist()
    langs = sorted(set(names))
    if len(langs) > MOST:
        raise ValueError(f"over {MOST} languages")
    sums = np.ones((BUCKETS, len(langs)))
    if langs:
        np.add.at(sums, (counts.column("bucket").to_numpy(), np.searchsorted(langs, names)), counts.column("n").to_numpy())
    return Model(langs, np.log(sums / sums.sum(axis=0)))


def identify(text: Column, model: Model) -> Column:
    """(lang, p): the likeliest language of a text and its posterior; nulls for texts without letters, or where the model knows no language."""
    if not model.langs:
        return F.lit(None).cast(GUESS)

    @F.pandas_udf(GUESS)
    def guess(texts: pd.Series) -> pd.DataFrame:
        some = texts.str.strip().ne("").to_numpy()
        p = model.posteriors(texts.tolist())
        best = p.argmax(axis=1)
        return pd.DataFrame({"lang": [model.langs[i] if x else None for i, x in zip(best, some, strict=True)], "p": np.where(some, p.max(axis=1), np.nan)})

    out = guess(letters(text))
    return F.when(out["lang"].isNotNull(), out)


def language(text: Column, model: Model, *, confidence: float = 0.7) -> Column:
    """The language of a text where it is sure enough, else null."""
    guess = identify(text, model)
    return F.when(guess["p"] >= confidence, guess["lang"])


def sql(train: str, confidence: float = 0.7) -> str:
    """The same as SQL: common tables up to ``spoken``, which is ``documents``' other columns with that language, learnt from the rows that the condition ``train`` picks."""
    gram = lambda n: "lambda i: " + "(" * n + str(n) + "".join(f" * 31 + c[i{f' + {j}' if j else ''}])" for j in range(n)) + f" % {BUCKETS}"
    each = ", ".join(f"list_transform(range(1, len(c) + {2 - n}), {gram(n)})" for n in ORDERS)
    return rf"""grams AS MATERIALIZED (
  SELECT doc_id, bucket, count(*) AS n FROM (
    SELECT doc_id, unnest(flatten([{each}])) AS bucket
    FROM (SELECT doc_id, list_transform(string_split(lower(regexp_replace(text, '[^\p{{L}}]+', ' ', 'g')), ''), lambda x: ord(x)::bigint) AS c FROM documents WHERE text <> '')
  ) GROUP BY ALL
), seen AS (SELECT lang, bucket, sum(n) AS n FROM grams JOIN documents d USING (doc_id) WHERE lang IS NOT NULL AND ({train}) GROUP BY ALL),
totals AS (SELECT lang, sum(n) + {BUCKETS} AS total FROM seen GROUP BY lang),
likely AS (SELECT lang, bucket, ln((coalesce(n, 0) + 1) / total) AS w FROM totals CROSS JOIN (SELECT unnest(range({BUCKETS})) AS bucket) LEFT JOIN seen USING (lang, bucket)),
scored AS (SELECT doc_id, lang, sum(n * w) / {len(ORDERS)} AS s FROM grams JOIN likely USING (bucket) GROUP BY ALL),
weighed AS (SELECT *, exp(s - max(s) OVER (PARTITION BY doc_id)) AS e FROM scored),
guess AS (SELECT doc_id, arg_max(lang, e) AS lang, max(e) / sum(e) AS p FROM weighed GROUP BY doc_id),
spoken AS (SELECT documents.* EXCLUDE (lang), CASE WHEN p >= {confidence} AND regexp_matches(text, '\p{{L}}') THEN guess.lang END AS lang FROM documents LEFT JOIN guess USING (doc_id))"""
