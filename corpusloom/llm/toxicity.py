"""Toxicity by a weighted lexicon: folded text, Aho-Corasick matching, length normalisation, exception phrases."""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._base import WORD, bounded_batches, nested, text_or_empty, unnested, written

# Insults that are in the lexicon before anything is learnt, and phrases in which such a word is not one.
SEEDS = "asshole bastard bitch clown cretin crap disgusting dumb dumbass filth garbage idiot idiotic imbecile jerk loser moron pathetic retard scum shit slut stupid trash vermin whore worthless".split()
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "garbage collection", "garbage collector", "clown fish", "jerk chicken", "dumb terminal", "class clown", "worthless check"]
# Digits and signs written for letters inside words, and letters of other scripts that look like Latin ones.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
HOMOGLYPHS = {
    "а": "a", "в": "b", "г": "r", "е": "e", "ё": "e", "з": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "\u00ad": "", "\u200b": "", "\u200c": "", "\u200d": "", "\u2060": "", "\ufeff": "",
}
#: Labelled rows that the lexicon and its weights are fitted on at most, by a hash of the id. Every row is scored.
TRAIN_ROWS = 20_000
#: Terms of the lexicon at most.
TERMS = 400
_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()}
_LEET = {ord(k): v for k, v in LEET.items()}


def fold(text: str) -> str:
    """Lower case, compatibility forms, look-alike letters as Latin ones, and one blank around and between words.

    Accents stay: they tell words of one language from another's. Digits and signs become letters only in a word that has letters too.
    """
    low = text.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKC", low).translate(_FOLD)
    out = []
    for w in low.split():
        if not w.isalpha():
            core = w.strip(".,;:?!()[]{}\"'*_-#<>/")
            if core.isalpha():
                w = core
            elif any(c.isalpha() for c in core):
                w = core.translate(_LEET)
                w = w if w.isalpha() else " ".join(WORD.findall(w))
            else:
                w = core
        out.append(w)
    return f" {' '.join(out)} "


@dataclass
class Lexicon:
    """Terms (a word with a blank at both ends, or a stem with one before) with weights, and the logistic curve over two features."""

    weights: dict[str, float]
    curve: tuple[float, ...] = (-4.0, 2.0, 6.0)
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, w in self.weights.items():
            found.add_word(term, (len(term), w))
        for phrase in self.exceptions:
            key = f" {phrase} "
            found.add_word(key, (len(key), 0.0))
        found.make_automaton()
        return found

    def features(self, text: str, matcher) -> tuple[float, float]:
        """log(1 + summed weight) and the weight a hundred words; a match inside an exception phrase counts nothing."""
        flat = fold(text)
        hits = [(end - n + 1, end, w) for end, (n, w) in matcher.iter(flat)] if len(matcher) else []
        free = [(a, b) for a, b, w in hits if w == 0.0]
        best: dict[int, float] = {}
        for a, b, w in hits:
            if w and not any(x <= a and b <= y for x, y in free):
                best[a] = max(best.get(a, 0.0), w)  # a stem and the word it begins count once
        total = sum(best.values())
        return float(np.log1p(total)), 100 * total / (flat.count(" ") or 1)

    def score(self, text: str, matcher) -> float:
        total, dense = self.features(text, matcher)
        z = self.curve[0] + self.curve[1] * total + self.curve[2] * float(np.tanh(dense))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _terms(text: str) -> set[str]:
    """Words of a folded text, and their stems of 4 to 7 characters."""
    out = set()
    for w in set(fold(text).split()):
        if 3 <= len(w) <= 30 and w.isalpha():
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in range(4, min(len(w), 8)))
    return out


def _count(batches):
    """Per task: in how many toxic and other texts each term is."""
    both = {0: Counter(), 1: Counter()}
    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            both[y].update(_terms(text))
    terms = [t for t in both[1].keys()]  # a term of no toxic text weighs nothing
    others = [t for t in both[0].keys() - both[1].keys()]
    names = terms + others
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([both[1][t] for t in names], pa.int64()), pa.array([both[0][t] for t in names], pa.int64())], ["term", "toxic", "other"])


def training_rows(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, y) of at most ``rows`` distinct labelled texts, drawn by a hash of doc_id; where labels of a text differ, the larger stands."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    drawn = lab.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(drawn), "doc_id").groupBy("text").agg(F.max("y").alias("y"))


def fit_lexicon(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, terms: int = TERMS, seeds: list[str] | None = None) -> Lexicon:
    """Learns the lexicon's terms, weights and curve from labelled rows.

    Document counts of words and stems are made on the executors; terms at least 20 times as frequent in toxic texts enter by how many toxic
    texts they explain that the terms before them do not. A term's weight is its log odds. The curve is fitted to all of the rows with a
    penalty. Without toxic rows the seeds stand alone. Rows without label, id or text are left out.
    """
    train = written(training_rows(docs, labels, rows=rows), "toxic-train")
    bounded_batches(docs.sparkSession)
    n_toxic, n_other = train.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    weights = {f" {w} ": 3.0 for w in (SEEDS if seeds is None else seeds)}
    if n_toxic and n_other:
        need = max(3, n_toxic // 200)
        odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))
        counts = train.mapInArrow(_count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        strong = counts.where(F.col("toxic") >= need).withColumn("w", odds).where(f"w >= {float(np.log(20))}")
        cand = {r["term"]: r["w"] for r in strong.orderBy(F.desc(F.col("toxic") * F.col("w")), "term").limit(20 * terms).collect()}  # bounded by `terms`
        names = docs.sparkSession.sparkContext.broadcast(frozenset(cand))

        def held(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([sorted(_terms(t) & names.value) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], ["terms"])

        texts = [r[0] for r in train.where("y = 1").select("text").mapInArrow(held, "terms array<string>").collect()]  # within the bound of `rows`
        where = defaultdict(set)
        for i, own in enumerate(texts):
            for t in own:
                where[t].add(i)
        open_ = Counter({i: 2 for i in range(len(texts))})  # a text counts as explained by two terms
        while len(weights) < terms and where:
            gain, _, term = max((sum(open_[i] > 0 for i in own) * min(cand[t], 6.0), -len(t), t) for t, own in where.items())
            if gain < max(3, need) * np.log(20):
                break
            for i in where.pop(term):
                open_[i] -= 1
            weights[term] = float(np.clip(cand[term], 1.0, 6.0))
    lex = Lexicon(weights)
    share = docs.sparkSession.sparkContext.broadcast(lex)

    def measured(batches):
        m = share.value.matcher()
        for b in batches:
            f = np.array([share.value.features(t, m) for t in b.column(0).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1]), b.column(1)], ["a", "b", "y"])

    if n_toxic and n_other:
        got = train.mapInArrow(measured, "a double, b double, y int").groupBy("a", "b", "y").count().collect()  # within the bound of `rows`
        x = np.array([[1.0, r["a"], np.tanh(r["b"])] for r in got])
        y, n = np.array([float(r["y"]) for r in got]), np.array([float(r["count"]) for r in got])
        beta = np.array([-4.0, 2.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad = x.T @ (n * (p - y)) + 0.05 * (beta - [-4.0, 2.0, 0.0])
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), grad)
            beta = beta - step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if beta[1] > 0 and beta[2] > -beta[1]:
            lex.curve = tuple(map(float, beta))
    return lex


def score_documents(docs: DataFrame, lex: Lexicon, *, out: str = "score") -> DataFrame:
    """Adds ``out``, in 0 to 1, to every row of ``docs`` (a column of that name is replaced). Whole texts; null and empty ones match nothing.
    Rows that repeat or lack an id each get their score; other columns may have any name. An empty table gives an empty result."""
    spark = docs.sparkSession
    bounded_batches(spark)
    share = spark.sparkContext.broadcast(lex)

    def run(batches):
        m = share.value.matcher()
        for b in batches:
            s = [share.value.score(t, m) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["row", "score"])

    held = docs.select(nested(docs), text_or_empty().alias("text"))
    scored = held.mapInArrow(run, T.StructType([held.schema["row"], T.StructField("score", T.DoubleType())]))
    return scored.select(*unnested([c for c in docs.columns if c != out]), F.col("score").alias(out))


def held_out() -> Column:
    """Rows that nothing is learnt from: crc32 of the id's digits modulo 3 is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
