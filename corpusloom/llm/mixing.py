"""Mixing to target weights with soft domain membership. DataFrame functions only.

A classifier fitted to labelled rows gives each document a posterior over domains. A nonnegative rate is then fitted to each document, so that
the expected tokens of each domain, sum of rate * tokens * posterior, match the targets: of all such rates those nearest to 1 (the limit of a
projected gradient descent from 1 where no rate is cut), found by Newton steps on one multiplier per domain. Where no rates match, they match
in the least-squares sense.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._base import nested, text_or_empty, unnested, written

# Pieces of text whose frequency tells languages and kinds of text apart.
MARKS = [" ", "\n", ".", ",", " the ", " of ", " der ", " und ", " le ", " que ", " los ", "http", "@", "  "]
#: Domains at most: a pass sums a number for each pair of them. More are refused, none is dropped.
DOMAINS = 256


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with __n (blank-separated tokens) and __x (an array of doubles), of whole texts. Null texts are empty."""
    text = text_or_empty()
    size = F.octet_length(text)
    count = lambda m: (size - F.octet_length(F.replace(text, F.lit(m)))) / float(len(m.encode()))
    raw = docs.select(*keep, F.char_length(text).alias("__c"), size.alias("__b"), F.array(*[count(m) for m in MARKS]).alias("__m"))
    words = F.when(F.col("__c") == 0, 0.0).otherwise(F.col("__m")[0] + F.col("__m")[1] + 1)
    rate = F.transform("__m", lambda c: F.log1p(c / F.greatest(F.col("__b"), F.lit(1)) * 1000.0))
    wide = F.array(F.log1p(F.col("__c").cast("double")), F.col("__b") / F.greatest(F.col("__c"), F.lit(1)))
    return raw.select(*keep, words.cast("long").alias("__n"), F.concat(rate, wide).alias("__x"))


@dataclass
class Mixture:
    """What is fitted, all of it bounded by the number of domains: class means, spreads and priors, targets, and multipliers."""

    domains: list[str]
    priors: list[float]
    means: list[list[float]]
    spreads: list[list[float]]
    temper: float = 4.0
    targets: list[float] = field(default_factory=list)
    lift: list[float] = field(default_factory=list)
    min_rate: float = 0.0
    achieved: list[float] = field(default_factory=list)
    #: Whether every domain is within the tolerance of its target, and the passes that the fit took.
    met: bool = True
    passes: int = 0

    def posterior(self, x: Column) -> Column:
        """Gaussian class densities with a diagonal covariance, tempered, as an array of probabilities in the order of ``domains``."""
        nums = lambda v: F.array(*[F.lit(float(a)) for a in v])
        scores = []
        for prior, mu, sd in zip(self.priors, self.means, self.spreads, strict=True):
            base = F.lit(math.log(prior) - sum(math.log(s) for s in sd) / self.temper)
            dist = F.aggregate(F.zip_with(F.zip_with(x, nums(mu), lambda a, b: a - b), nums(sd), lambda d, s: (d / s) * (d / s)), F.lit(0.0), lambda a, d: a + d)
            scores.append(base - dist / (2 * self.temper))
        return F.array(*scores)

    def raw_rate(self, p: Column) -> Column:
        """What ``rate`` is before it is cut at ``min_rate``."""
        return sum((p[i] * F.lit(float(v)) for i, v in enumerate(self.lift)), F.lit(max(1.0, self.min_rate)))

    def rate(self, p: Column) -> Column:
        """The rate that the fitted multipliers give a document of posterior ``p``."""
        return F.greatest(F.lit(float(self.min_rate)), self.raw_rate(p))


def _softmax(df: DataFrame, scores: str, out: str) -> DataFrame:
    df = df.withColumn("__s", F.transform(scores, lambda s: F.exp(s - F.array_max(scores))))
    df = df.withColumn("__z", F.aggregate("__s", F.lit(0.0), lambda a, v: a + v))
    return df.withColumn(out, F.transform("__s", lambda s: s / F.col("__z"))).drop("__s", "__z", scores)


def with_posterior(df: DataFrame, model: Mixture, out: str = "__p") -> DataFrame:
    return _softmax(df.withColumn("__scores", model.posterior(F.col("__x"))), "__scores", out)


def fit_classifier(found: DataFrame, labelled: DataFrame) -> Mixture:
    """``found``: doc_id, __n, __x; ``labelled``: doc_id, domain. A row per labelled document enters as sums of a few numbers per domain."""
    lab = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    rows = found.join(lab, "doc_id")
    names = [r["domain"] for r in rows.select("domain").distinct().limit(DOMAINS + 1).collect()]
    if not names:
        return Mixture(["all"], [1.0], [[0.0] * (len(MARKS) + 2)], [[1.0] * (len(MARKS) + 2)])
    if len(names) > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains: name coarser ones")
    dims = range(len(MARKS) + 2)
    sums = rows.groupBy("domain").agg(F.count("*").alias("n"), *[F.avg(F.col("__x")[i]).alias(f"m{i}") for i in dims], *[F.var_pop(F.col("__x")[i]).alias(f"v{i}") for i in dims]).orderBy("domain").collect()
    total = sum(r["n"] for r in sums)
    pooled = [sum(r[f"v{i}"] * r["n"] for r in sums) / total for i in dims]
    mean = [[r[f"m{i}"] for i in dims] for r in sums]
    # Few rows say little of a spread: each is shrunk to the pooled one.
    spread = [[max(math.sqrt((r[f"v{i}"] * r["n"] + pooled[i] * 20) / (r["n"] + 20)), 1e-2) for i in dims] for r in sums]
    return Mixture([r["domain"] for r in sums], [r["n"] / total for r in sums], mean, spread)


def _measure(soft: DataFrame, model: Mixture, toward: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray, float]:
    """One pass at the model's multipliers: the dual's sum, expected tokens per domain, their second moments over documents whose rate is not
    cut, and the largest posterior . ``toward`` of a document with tokens."""
    k, low = len(model.domains), float(model.min_rate)
    p, n, raw = F.col("__p"), F.col("__n"), F.col("__raw")
    free, rate = raw >= low, F.greatest(F.lit(low), raw)
    along = sum((p[i] * F.lit(float(v)) for i, v in enumerate(toward)), F.lit(0.0)) if toward is not None else F.lit(0.0)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    moment = [F.sum(F.when(free, n * p[i] * p[j]).otherwise(0.0)).alias(f"g{i}_{j}") for i, j in cells]
    value = F.sum(n * F.when(free, raw * raw / 2).otherwise(raw * low - low * low / 2)).alias("value")
    row = soft.select("__n", "__p", model.raw_rate(p).alias("__raw")).agg(value, F.max(F.when(n > 0, along)).alias("top"), *[F.sum(rate * n * p[i]).alias(f"t{i}") for i in range(k)], *moment).first()
    gram = np.zeros((k, k))
    for i, j in cells:
        gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
    model.passes += 1
    return row["value"] or 0.0, np.array([row[f"t{i}"] or 0.0 for i in range(k)]), gram, row["top"] or 0.0


def fit_rates(soft: DataFrame, model: Mixture, *, weights: dict[str, float] | None = None, alpha: float = 0.7, budget: float | None = None, min_rate: float = 0.0, rounds: int = 500, tolerance: float = 1e-3) -> Mixture:
    """Adds targets and multipliers. ``soft``: __n, __p, a row per document.

    ``weights``: a share for each domain; by default the expected tokens to the power ``alpha``. ``budget``: tokens of the result; by default
    the corpus's own, or, with ``min_rate`` over 0, what lets every domain keep ``min_rate`` of its tokens. Ends when every domain is within
    ``tolerance`` of its target (a target of 0: of the mean target), or, with a warning and ``met`` false, when the residual is proven to be
    within 1 % of the least that any rates leave. Each step is a pass that sums some numbers per pair of domains; if ``rounds`` passes do
    neither, it raises.
    """
    k = len(model.domains)
    if weights and not set(weights) <= set(model.domains):
        raise ValueError(f"weights name domains that no label has: {sorted(set(weights) - set(model.domains))}")
    model.min_rate, model.lift = min_rate, [0.0] * k
    value, now, gram, _ = _measure(soft, model)
    if now.sum() <= 0:
        return model
    base = now / max(1.0, min_rate)
    share = np.array([weights.get(d, 0.0) for d in model.domains]) if weights else base**alpha
    share = share / share.sum()
    if budget is None:
        on = share > 0
        budget = float((base[on] / share[on]).max() * min_rate) if min_rate > 0 else float(base.sum())
    target = share * budget
    model.targets = target.tolist()
    slack = tolerance * np.where(target > 0, target, target.mean())
    # A proximal term keeps the steps finite where targets cannot be met; its centre moves and it shrinks, so the limit is the exact fit.
    lift = centre = np.zeros(k)
    prox = 1e-6 * float(np.linalg.eigvalsh(gram).max())
    loss = lambda v, x: v - target @ x + prox / 2 * float((x - centre) @ (x - centre))
    while (np.abs(target - now) > slack).any():
        gap, grad = target - now, now - target + prox * (lift - centre)
        if np.linalg.norm(grad) <= 1e-3 * np.linalg.norm(gap):
            # Along a direction that no posterior has a positive part of, rates above the least only lose: a bound on what any rates leave.
            way = gap - max(_measure(soft, model, gap)[3], 0.0)
            if way @ (target - min_rate * base) >= 0.99 * np.linalg.norm(gap) * np.linalg.norm(way):
                model.met = False
                warnings.warn(f"targets cannot be met; nearest totals per domain: {dict(zip(model.domains, (now / np.where(target > 0, target, 1)).round(4).tolist(), strict=True))} of target", stacklevel=2)
                break
            centre, prox = lift, prox / 10
            grad = now - target
        step, size, was = np.linalg.solve(gram + prox * np.eye(k), -grad), 1.0, loss(value, lift)
        while True:
            if model.passes >= rounds:
                raise RuntimeError(f"rates did not settle in {rounds} passes; shares of targets: {dict(zip(model.domains, (now / np.where(target > 0, target, 1)).tolist(), strict=True))}")
            model.lift = (lift + size * step).tolist()
            value, now, gram, _ = _measure(soft, model)
            if loss(value, lift + size * step) <= was + 1e-4 * size * float(grad @ step) + 1e-12 * abs(was):
                break
            size /= 2
        lift = lift + size * step
    model.achieved = now.tolist()
    return model


def fit_mixture(docs: DataFrame, labelled: DataFrame, **how) -> tuple[Mixture, DataFrame]:
    """The fitted mixture and the narrow table doc_id, __n, __p that it was fitted on (rows in any order, ids may repeat or be null)."""
    found = written(features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]), "mix-features")
    model = fit_classifier(found, labelled)
    soft = written(with_posterior(found, model).select("doc_id", "__n", "__p"), "mix-posteriors")
    return fit_rates(soft, model, **how), soft


def rates(docs: DataFrame, labelled: DataFrame, **how) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), p_domain, posterior (map), rate: a row per row of ``docs``.

    Null and empty texts have no tokens, hence no say in the fit; their rate is that of their posterior. Without labels there is one domain,
    "all", and every rate is 1. An empty table gives an empty result.
    """
    model, soft = fit_mixture(docs, labelled, **how)
    names = F.array(*[F.lit(d) for d in model.domains])
    at = F.array_position("__p", F.array_max("__p")).cast("int")
    return soft.select("doc_id", F.col("__n").alias("n_tokens"), F.element_at(names, at).alias("domain"), F.array_max("__p").alias("p_domain"), F.map_from_arrays(names, F.col("__p")).alias("posterior"), model.rate(F.col("__p")).alias("rate"))


def mix(docs: DataFrame, labelled: DataFrame, *, seed: int = 17, copy: str | None = None, **how) -> DataFrame:
    """``docs`` with each row repeated by its rate: the whole part always, once more with the probability of the fraction. ``copy``: a column
    of this name numbers the copies of a row from 1 on.

    The draw is a hash of doc_id and text, so it is the same in every run and on every executor. Rate 1 keeps a row as it is; with
    ``min_rate=1`` no row is lost. All columns stay, whatever their names. Null texts are empty; rows without id are drawn by their text; rows
    that repeat id and text are drawn alike. An empty table gives an empty result.
    """
    model, _ = fit_mixture(docs, labelled, **how)
    held = features(docs.select(nested(docs), text_or_empty().alias("text")), ["row"])
    soft = with_posterior(held, model).withColumn("__rate", model.rate(F.col("__p")))
    draw = F.pmod(F.xxhash64("row.doc_id", "row.text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("__rate") + F.when(draw < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)
    repeated = soft.withColumn("__copy", F.explode(F.sequence(F.lit(0), copies.cast("int")))).where("__copy > 0")
    number = [F.col("__copy").cast("long").alias(copy)] if copy else []
    return repeated.select(*unnested([c for c in docs.columns if c != copy]), *number)
