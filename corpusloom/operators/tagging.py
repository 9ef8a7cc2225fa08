"""Tag rows: parsing and validation of model output, version guards, cross references to product aggregates, snapshots."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LISTS = ["wishlist_motivation", "blocker_type", "uncertainty_type", "info_sought_elsewhere", "segment_cue"]
TAGS = (
    "struct<doc_id:string,is_relevant:boolean," + "".join(f"{c}:array<string>," for c in LISTS)
    + "intent_class:string,outcome_mentioned:string,severity:int,actionability_non_monetary:int,confidence_pct:int,evidence:array<struct<tag:string,quote:string>>>"
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it: a lambda's variable is never replaced by its expression, so steps that
    are put inside one another stay as long as their sum."""
    return F.transform(F.array(value), use)[0]


def parse_tags(raw: Column) -> Column:
    """A tag blob as a struct; null where it is no JSON object or a bounded number is out of its range."""

    def checked(t: Column) -> Column:
        fits = F.coalesce(t["severity"].between(1, 5), F.lit(True)) & F.coalesce(t["actionability_non_monetary"].isin(0, 1), F.lit(True)) & F.coalesce(t["confidence_pct"].between(0, 100) & (t["confidence_pct"] % 10 == 0), F.lit(True))
        return F.when(fits, t)

    return bound(bound(raw, lambda x: F.from_json(F.when(x.rlike(r"^\s*\{"), x), TAGS)), checked)


def tags_blob(tags: Column) -> Column:
    """The coding as JSON, without the document that it is of; ``parse_tags`` reads it back."""
    return bound(tags, lambda t: F.when(t.isNotNull(), F.to_json(t.dropFields("doc_id"))))


def evidenced(tags: Column) -> Column:
    """The struct's label lists with only those labels that a span with a quote that is not blank supports, without repeats."""

    def supported(t: Column) -> Column:
        spans = F.filter(F.coalesce(t["evidence"], F.array()), lambda e: F.trim(F.coalesce(e["quote"], F.lit(""))) != "")
        lists = lambda seen: {c: F.array_intersect(F.coalesce(t[c], F.array().cast("array<string>")), seen) for c in LISTS}
        fields = [part.split(":")[0] for part in re.sub(r"<(?:[^<>]|<[^<>]*>)*>", "", TAGS.removeprefix("struct<")[:-1]).split(",")]
        whole = lambda seen: F.struct(*[lists(seen).get(c, t[c]).alias(c) for c in fields])
        return F.when(t.isNotNull(), bound(F.transform(spans, lambda e: e["tag"]), whole))

    return bound(tags, supported)


def parse_response(df: DataFrame, column: str = "response") -> DataFrame:
    """Rows of an envelope ``{"documents": [...]}``; bad envelopes and bad documents are passed over."""
    rows = df.select(F.explode(F.from_json(column, f"struct<documents:array<{TAGS}>>")["documents"]).alias("t")).where("t.doc_id is not null")
    return rows.select(evidenced(F.col("t")).alias("t")).select("t.*")


def one_version(tags: DataFrame, keys: tuple[str, ...] = ("taxonomy_version", "prompt_version", "model")) -> DataFrame:
    """``tags`` unless they mix versions: then the query fails when it runs, with both versions named. One row decides."""
    v = F.struct(*keys)
    bounds = tags.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    guard = F.when(F.col("__lo").eqNullSafe(F.col("__hi")), True).otherwise(F.raise_error(F.concat(F.lit("mixed tag versions: "), F.to_json("__lo"), F.lit(" and "), F.to_json("__hi"))).cast("boolean"))
    return tags.join(F.broadcast(bounds), how="cross").where(guard).drop("__lo", "__hi")


def verdicts(survivors: DataFrame, cache: DataFrame, *, tokens_per_doc: int = 56, batch: int = 20, budget: int = 200_000) -> DataFrame:
    """Tier 2: (doc_id, is_relevant, state). Cached verdicts stand; the others are asked in batches while the budget lasts, an omitted verdict
    counts as true; rows beyond the budget stay open. Batches are numbered by a rank within hash buckets, so no task ranks all rows.
    """
    rows = survivors.select("doc_id").join(cache.select("doc_id", F.col("is_relevant").alias("known")), "doc_id", "left")
    state = F.when(F.col("known").isNotNull(), "cached")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    rows = rows.withColumn("open", F.col("known").isNull()).withColumn("bucket", bucket)
    sizes = rows.where("open").groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("bucket", "base")
    rows = rows.join(F.broadcast(before), "bucket", "left").withColumn("rn", F.coalesce("base", F.lit(0)) + F.row_number().over(Window.partitionBy("bucket", "open").orderBy("doc_id")) - 1)
    asked = (F.floor(F.col("rn") / batch) + 1) * batch * tokens_per_doc <= budget
    return rows.select("doc_id", F.when(F.col("known").isNotNull(), F.col("known")).when(asked, True).alias("is_relevant"), state.when(asked, "asked").otherwise("beyond budget").alias("state"))


def cross_reference(themes: DataFrame, products: DataFrame, hints: dict[str, list[str]]) -> DataFrame:
    """(theme, kind, n_products, mean_share): each theme with the product aggregate its words hint at (fit, quality), or none.

    ``themes``: theme; ``products``: misfit, bad_quality (shares or null). Both roll-ups are one row, so nothing is multiplied.
    """
    roll = products.agg(F.count("misfit").alias("n_fit"), F.round(F.avg("misfit"), 1).alias("fit"), F.count("bad_quality").alias("n_quality"), F.round(F.avg("bad_quality"), 1).alias("quality"))
    kind = F.lit("none")
    for name, words in reversed(list(hints.items())):
        kind = F.when(F.lower("theme").rlike("|".join(words)), name).otherwise(kind)
    out = themes.withColumn("kind", kind).join(F.broadcast(roll), how="cross")
    pick = lambda a, b: F.when(F.col("kind") == "fit", F.col(a)).when(F.col("kind") == "quality", F.col(b))
    return out.select("theme", "kind", F.coalesce(pick("n_fit", "n_quality"), F.lit(0)).alias("n_products"), pick("fit", "quality").alias("mean_share"))


def segment_hits(rows: DataFrame, matrix: DataFrame, *, lift: float = 2.0) -> DataFrame:
    """(rank, segment, lift): for ranked rows with an array ``members``, the segments whose lift with a member is material."""
    own = rows.select("rank", F.explode("members").alias("blocker"))
    return own.join(matrix.withColumn("key", F.lower("blocker")).drop("blocker"), F.lower("blocker") == F.col("key")).where(F.col("lift") >= lift).groupBy("rank", "segment").agg(F.max("lift").alias("lift"))


def snapshot(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON text of report rows without ids of documents; ``rows`` is a report, a row per label."""
    return rows.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*columns)))).alias("snapshot"))


class TooLarge(Exception):
    """The model refused a request for its size."""


class Rejected(Exception):
    """The model's answer did not fit the schema; another try may."""


class SchemaRefused(Exception):
    """The schema itself was refused: no retry helps."""


def repairing(call: Callable[[list[tuple[Any, str]], str | None], Iterable], *, repairs: int = 3, cuts: int = 8):
    """A tagger for ``evaluation.tag_with`` around ``call(batch, error to fix)``.

    A batch that is too large is halved, one document that is too large loses the second half of its text, at most ``cuts`` times, and no
    error text is added, which would only make it larger. A rejected batch is halved, a rejected document is sent again with the error, at most
    ``repairs`` times along a branch. What cannot be tagged yields nothing and stays a cache miss; a refused schema ends the job.
    """

    def tag(batch):
        waiting = [(list(batch), 0, 0, None)]
        while waiting:
            docs, tries, halved, error = waiting.pop()
            if not docs:
                continue
            middle = len(docs) // 2
            try:
                got = list(call(docs, error))
            except TooLarge:
                if middle:
                    waiting += [(docs[middle:], tries, halved, None), (docs[:middle], tries, halved, None)]
                elif halved < cuts and len(docs[0][1]) > 1:
                    doc, text = docs[0]
                    half = text[: len(text) // 2]
                    waiting.append(([(doc, half[: half.rfind(" ")] if " " in half.strip() else half)], tries, halved + 1, None))
            except Rejected as e:
                if tries < repairs:
                    parts = [docs[:middle], docs[middle:]] if middle else [docs]
                    waiting += [(p, tries + 1, halved, str(e)) for p in reversed(parts)]
            else:
                yield from got

    return tag


def response_schema(labels: dict[str, list[str]]) -> dict:
    """The strict JSON schema of a tagging response; ``labels``: the vocabulary of each list column. Numbers are listed, as a decoder does not keep to
    ranges; the document's id comes first."""
    text, one_of = {"type": "string"}, lambda values: {"type": "integer", "enum": list(values)}
    span = {"type": "object", "properties": {"tag": text, "quote": text}, "required": ["tag", "quote"], "additionalProperties": False}
    fields = {"doc_id": text, "is_relevant": {"type": "boolean"}, **{c: {"type": "array", "items": {"type": "string", "enum": labels[c]} if labels.get(c) else text} for c in LISTS}}
    fields |= {"intent_class": text, "outcome_mentioned": text, "severity": one_of(range(1, 6)), "actionability_non_monetary": one_of((0, 1)), "confidence_pct": one_of(range(0, 101, 10)), "evidence": {"type": "array", "items": span}}
    doc = {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}
    return {"type": "object", "properties": {"documents": {"type": "array", "items": doc}}, "required": ["documents"], "additionalProperties": False}


# Keywords of JSON schema that strict decoding refuses.
REFUSED = """
    minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern format minItems maxItems uniqueItems contains
    minContains maxContains minProperties maxProperties patternProperties propertyNames unevaluatedItems unevaluatedProperties default
""".split()


def schema_violations(schemas: DataFrame, *, key: str = "schema_id", raw: str = "schema") -> DataFrame:
    """(key, path, problem, name): why strict decoding would refuse each JSON schema of ``schemas``, a row per place. No row: it is strict.

    Schemas are walked by a recursive query over their parts as variants, all schemas at once, level by level: properties and definitions by name,
    items and alternatives by place. Problems: ``unsupported keyword``, ``mixed enum`` (whole and fractional numbers), ``open object`` (other keys are not
    forbidden), ``not required`` and ``no such property``; what is no JSON object has the problem ``no object``.
    """
    spark, view = schemas.sparkSession, f"schemas_{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # rows of a level grow with the table
    schemas.select(F.col(key).alias("id"), F.try_parse_json(F.col(raw)).alias("node")).createOrReplaceTempView(view)
    nodes = spark.sql(f"""
        WITH RECURSIVE parts(id, path, node, kind) AS (
          SELECT id, '$', node, 'schema' FROM {view}
          UNION ALL
          SELECT p.id, CASE WHEN p.kind = 'list' THEN concat(p.path, '[', c.pos, ']') ELSE concat(p.path, '.', c.key) END, c.value,
                 CASE WHEN p.kind <> 'schema' THEN 'schema' WHEN c.key IN ('properties', '$defs') THEN 'names' WHEN schema_of_variant(c.value) LIKE 'ARRAY%' THEN 'list' ELSE 'schema' END
          FROM parts p, LATERAL variant_explode(p.node) c
          WHERE p.kind = 'names' AND c.key IS NOT NULL OR p.kind = 'list' AND c.key IS NULL
             OR p.kind = 'schema' AND c.key IN ('properties', '$defs', 'items', 'anyOf', 'allOf', 'oneOf', 'prefixItems')
        ) SELECT id, path, node, to_json(node) AS json FROM parts WHERE kind = 'schema'""")
    none = F.array().cast("array<string>")
    names = lambda json: F.coalesce(F.json_object_keys(json), none)
    problem = lambda what, found: F.transform(found, lambda n: F.struct(F.lit(what).alias("problem"), n.cast("string").alias("name")))
    keys, own = names(F.col("json")), names(F.get_json_object("json", "$.properties"))
    required = F.coalesce(F.try_variant_get("node", "$.required", "array<string>"), none)
    is_object = F.coalesce(F.try_variant_get("node", "$.type", "string") == "object", F.lit(False)) | F.array_contains(keys, "properties")
    closed = F.coalesce(F.to_json(F.try_variant_get("node", "$.additionalProperties", "variant")) == "false", F.lit(False))
    numbers = F.filter(F.coalesce(F.try_variant_get("node", "$.enum", "array<variant>"), F.array().cast("array<variant>")), lambda v: F.schema_of_variant(v).rlike("BIGINT|DECIMAL|DOUBLE|FLOAT"))
    whole = lambda v: F.variant_get(v, "$", "double") == F.floor(F.variant_get(v, "$", "double"))
    mixed = F.exists(numbers, whole) & F.exists(numbers, lambda v: ~whole(v))
    one = lambda what, holds: F.when(holds, problem(what, F.array(F.lit(None)))).otherwise(problem(what, none))
    within = lambda found: F.when(is_object, found).otherwise(none)
    odd = F.coalesce(~F.schema_of_variant("node").startswith("OBJECT"), F.lit(True))
    found = F.when(odd, F.when(F.col("path") == "$", problem("no object", F.array(F.lit(None)))).otherwise(problem("", none))).otherwise(F.concat(
        problem("unsupported keyword", F.array_intersect(keys, F.array(*map(F.lit, REFUSED)))), one("mixed enum", mixed), one("open object", is_object & ~closed),
        problem("not required", within(F.array_except(own, required))), problem("no such property", within(F.array_except(required, own)))))
    return nodes.select(F.col("id").alias(key), "path", F.explode(found).alias("x")).select(key, "path", "x.problem", "x.name")
