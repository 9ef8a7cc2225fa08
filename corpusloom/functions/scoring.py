"""Ids, fingerprints, intervals and scores as expressions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import for_fingerprint

ANONYMOUS = "__anonymous__"


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def doc_id(source: Column, native: Column) -> Column:
    return short_hash(F.concat_ws("|", source, native))


def author_hash(source: Column, author: Column, salt: str) -> Column:
    handle = F.coalesce(F.nullif(F.trim(author), F.lit("")), F.lit(ANONYMOUS))
    return short_hash(F.concat(source, F.lit("|"), handle, F.lit(salt)))


def content_id(text: Column) -> Column:
    flat = for_fingerprint(text)
    return F.when(flat == "", F.raise_error(F.lit("a text without words has no content id")).cast("string")).otherwise(short_hash(flat))


def cache_key(doc: Column, text: Column, model: str, taxonomy: str, prompt: str) -> Column:
    return content_id(F.concat_ws(" ", F.lit(model), F.lit(taxonomy), F.lit(prompt), doc, text))


def _bits(texts: list[str | None], digest: str) -> np.ndarray:
    """Simhashes of normalised texts. Bit sums are exact: whole counts, by unpacked bits of a block of digests."""
    make = (lambda g: hashlib.blake2b(g, digest_size=8).digest()) if digest == "blake2b" else (lambda g: hashlib.md5(g).digest()[:8])
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        words = (text or "").encode().split()
        if not words:
            continue
        grams = words if len(words) <= 2 else [a + b" " + b for a, b in zip(words, words[1:])]  # noqa: B905
        ones = np.zeros(64, np.int64)
        for at in range(0, len(grams), 1 << 14):
            raw = np.frombuffer(b"".join(map(make, grams[at : at + (1 << 14)])), np.uint8).reshape(-1, 8)
            ones += np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
        out[k] = int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big")
    return out


def simhash(df: DataFrame, key: str, text: str = "text", out: str = "fingerprint", *, digest: str = "blake2b") -> DataFrame:
    """(key, out): 64-bit simhash over word bigrams (texts of up to two words: the words), a row per row of ``df``.

    Bigrams are hashed by eight bytes of ``digest`` (blake2b, or the first of md5). A text's counters are summed where the text is, in Arrow
    batches, so nothing is shuffled; a long text is worked off in blocks of bigrams. Texts without words, null ones too, get 0.
    """

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_bits(b.column(1).to_pylist(), digest).view(np.int64))], [key, out])

    rows = df.select(key, for_fingerprint(F.col(text)).alias("flat"))
    return rows.mapInArrow(run, T.StructType([df.schema[key], T.StructField(out, T.LongType())]))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def recency_weight(age_days: Column, half_life: float = 365.0) -> Column:
    if half_life <= 0:
        raise ValueError("the half-life must be positive")
    return F.when(age_days <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age_days / half_life))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """(share, low, high); zeros where ``n`` is not positive."""
    p = successes / F.nullif(n, F.lit(0))
    denom = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / denom
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    zero = lambda c: F.when(n <= 0, 0.0).otherwise(c)
    return zero(p), zero(F.greatest(F.lit(0.0), mid - half)), zero(F.least(F.lit(1.0), mid + half))


def sample_size_factor(share: Column, low: Column) -> Column:
    return F.when(share <= 0, 0.0).otherwise(F.least(F.lit(1.0), low / F.nullif(share, F.lit(0.0))))


def min_max(value: Column, by: list[str] | None = None) -> Column:
    """Scaled to 0..1 over the rows of ``by``; 1 where all are equal."""
    w = Window.partitionBy(*(by or []))
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, 1.0).otherwise((value - low) / F.nullif(high - low, F.lit(0)))


def evidence_confidence(mean_confidence: Column, spread: Column, size: Column, attribution: Column, top: float = 100.0) -> Column:
    return mean_confidence / top * spread * size * attribution


def opportunity_score(share_norm: Column, severity: Column, actionability: Column, evidence: Column, *, severity_max: float = 5.0, scale: float = 100.0) -> Column:
    return F.sqrt(share_norm) * (severity / severity_max) * actionability * evidence * scale


def lift(both: Column, a: Column, b: Column, total: Column) -> Column:
    """P(ab) / (P(a) P(b)); null where a marginal is zero."""
    return both * total / F.nullif(a * b, F.lit(0))
