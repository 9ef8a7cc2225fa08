"""A Merkle manifest of a dataset: node store by level, built and read by scans in the order of coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm._base import bounded_batches, scratch, written

ARITY = 3
#: Levels that one pass over the store adds: a block of ARITY ** LEVELS nodes is what a task holds at once.
LEVELS = 7
_NODE = "s string, i long, h binary, level int"


def field(value: Column) -> Column:
    """A value as text that shows where it ends: ``-`` for null, else its UTF-8 bytes' count, a colon, and it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """SHA-256 of the fields in order, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class Manifest:
    """``leaves``: (s, i, h, claimed, doc_id), s the source's key, i the place among its leaves. ``nodes``: the folder of the levels above, a Parquet
    partition each. ``groups``: (s, top, h, path) of each source, the path from its subroot to the root."""

    spark: SparkSession
    leaves: DataFrame
    nodes: str
    groups: DataFrame
    root: str | None
    steps: int

    def level(self, level: int) -> DataFrame:
        if level == 0:
            return self.leaves.select("s", "i", "h")
        return self.spark.read.schema(_NODE).parquet(self.nodes).where(F.col("level") == level).select("s", "i", "h")


# ---- places ------------------------------------------------------------------------------------------------------------------------------


def _count(batches):
    """Adds the run (the task) and the place among the rows of equal s in it; rows come sorted by s."""
    run, last, n = TaskContext.get().partitionId(), None, 0
    for b in batches:
        s = b.column("s")
        new = np.ones(len(s), bool)
        if len(s) > 1:
            new[1:] = pc.not_equal(s[1:], s[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        place = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
        if len(s) and s[0].as_py() == last:
            head = int(starts[1]) if len(starts) > 1 else len(s)
            place[:head] += n
        if len(s):
            last, n = s[-1].as_py(), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(s), run), pa.int32()), pa.array(place, pa.int64())], [*b.schema.names, "run", "place"])


def numbered(rows: DataFrame, order: list[str], tag: str) -> DataFrame:
    """``rows`` with i, the place of a row among those of equal s in ``order``. Sorted runs are counted by themselves; then each run's first s is moved
    by what earlier runs hold of it. That is at most a row a run, and all that is broadcast."""
    ranged = rows.repartitionByRange("s", *order).sortWithinPartitions("s", *order)
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, run int, place long"
    runs = written(ranged.mapInArrow(_count, schema), tag)
    held = runs.groupBy("run", "s").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("s").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    moved = held.withColumn("before", F.sum("n").over(earlier)).where("before > 0").select("run", "s", "before")
    return runs.join(F.broadcast(moved), ["run", "s"], "left").withColumn("i", F.col("place") + F.coalesce("before", F.lit(0))).drop("run", "place", "before")


# ---- up ----------------------------------------------------------------------------------------------------------------------------------


def _blocks(batches, *keys: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that follow each other with equal keys."""
    now, held = None, []
    for b in batches:
        for row in b.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(row)
    if held:
        yield now, held


def _raise(base: int, m: int):
    def run(batches):
        for (s, block), rows in _blocks(batches, "s", "block"):
            nodes = [r["h"].hex() for r in rows]
            out: list[tuple] = []
            for up in range(1, m + 1):
                if len(nodes) == 1 and block == 0:  # the whole source has one node
                    break
                nodes = [_hash("".join(nodes[x : x + ARITY])) for x in range(0, len(nodes), ARITY)]
                first = block * ARITY ** (m - up)
                out += [(s, first + x, bytes.fromhex(h), base + up) for x, h in enumerate(nodes)]
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int32())], ["s", "i", "h", "level"])

    return run


def _grow(spark: SparkSession, leaves: DataFrame, tag: str, m: int) -> tuple[str, int]:
    """(folder of the levels above ``leaves``, passes): each pass reads the last level of the one before in order and streams out ``m`` more."""
    path, base = scratch(spark, tag), 0
    store = lambda: spark.read.schema(_NODE).parquet(path)
    now = leaves.select("s", "i", "h")
    while True:
        block = F.floor(F.col("i") / F.lit(ARITY**m)).cast("long")
        ordered = now.withColumn("block", block).repartition("s", "block").sortWithinPartitions("s", "block", "i")
        ordered.mapInArrow(_raise(base, m), _NODE).write.mode("append").partitionBy("level").parquet(path)
        base += m
        now = store().where(F.col("level") == base).select("s", "i", "h")
        if now.where("i > 0").isEmpty():
            return path, base // m


def _tops(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(s, top, h): the last node of each s and its level."""
    ends = leaves.where("i = 0").select("s", F.lit(0).alias("level"), "h").union(nodes.where("i = 0").select("s", "level", "h"))
    return ends.groupBy("s").agg(F.max("level").alias("top"), F.max_by("h", "level").alias("h"))


# ---- down --------------------------------------------------------------------------------------------------------------------------------

_STEP = "s string, block long, kind int, level int, i long, h binary, top int, path array<string>, subroot binary"
_PATH = "s string, i long, path array<string>, subroot binary"


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give; ``path``: what stands left and right of the node, level by level."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        leaf = _hash(left + leaf + right)
    return leaf


def _walk(base: int, m: int, proofs: bool):
    """Blocks in order of coordinates: first the path above (kind 0), then nodes by level, leaves last; a path for each node of level ``base``."""

    def run(batches):
        for (s, block), rows in _blocks(batches, "s", "block"):
            if rows[0]["kind"] != 0:
                continue  # this source ends below
            above = rows[0]
            levels: dict[int, list[dict]] = {}
            for r in rows[1:]:
                levels.setdefault(r["level"], []).append(r)
            # Paths of the nodes of one level, from the top down.
            paths = [above["path"]]
            for level in range(above["top"] - 1, base, -1):
                paths = list(_down([r["h"].hex() for r in levels[level]], paths))
            last = levels[base]
            ends = [above["path"]] if above["top"] == base else list(_down([r["h"].hex() for r in last], paths))
            if not proofs:
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(last), pa.string()), pa.array([r["i"] for r in last], pa.int64()), pa.array(ends, pa.list_(pa.string())), pa.array([above["subroot"]] * len(last), pa.binary())], ["s", "i", "path", "subroot"])
                continue
            hashes = [r["h"].hex() for r in last]
            claims = [r["claimed"].hex() for r in last]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["doc_id"] for r in last], pa.int64()), pa.array(hashes), pa.array([above["subroot"].hex()] * len(last), pa.string()), pa.array([_hash("".join(p)) for p in ends]), pa.array([fold(c, p) for c, p in zip(claims, ends, strict=True)])],
                ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"],
            )

    return run


def _down(nodes: list[str], above: list[list[str]]) -> Iterator[list[str]]:
    for i, _ in enumerate(nodes):
        first = i - i % ARITY
        yield ["".join(nodes[first:i]), "".join(nodes[i + 1 : first + ARITY]), *above[i // ARITY]]


def _descend(spark: SparkSession, leaves: DataFrame, nodes: str, steps: int, groups: DataFrame, m: int, proofs: bool) -> DataFrame:
    """Merge-scans of the store from the top pass down: nodes of a block meet the path above it. ``groups``: (s, top, path, subroot)."""
    store, above, more = spark.read.schema(_NODE).parquet(nodes), None, ["claimed", "doc_id"] if proofs else []
    none = lambda kind: F.lit(None).cast(kind)
    for step in reversed(range(steps)):
        base, last = step * m, step == 0
        own = groups.where((F.col("top") > base) & (F.col("top") <= base + m) | (F.col("top") == 0) & F.lit(last))
        heads = own.select("s", F.lit(0).cast("long").alias("block"), "top", "path", "subroot")
        if above is not None:
            heads = heads.union(above.select("s", F.col("i").alias("block"), F.lit(base + m).alias("top"), "path", "subroot"))
        rows = heads.select("s", "block", F.lit(0).alias("kind"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("i"), none("binary").alias("h"), "top", "path", "subroot")
        inner = store.where((F.col("level") >= max(base, 1)) & (F.col("level") < base + m))
        if last:
            inner = inner.unionByName(leaves.withColumn("level", F.lit(0)), allowMissingColumns=True)
        block = F.floor(F.col("i") / F.pow(F.lit(float(ARITY)), F.lit(m) + base - F.col("level"))).cast("long")
        scan = inner.select("s", block.alias("block"), F.lit(1).alias("kind"), "level", "i", "h", none("int").alias("top"), none("array<string>").alias("path"), none("binary").alias("subroot"), *(more if last else []))
        both = rows.unionByName(scan, allowMissingColumns=True)
        ordered = both.repartition("s", "block").sortWithinPartitions("s", "block", "kind", F.desc("level"), "i")
        if last and proofs:
            return ordered.mapInArrow(_walk(base, m, True), "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
        above = ordered.mapInArrow(_walk(base, m, False), _PATH)
        if not last:
            above = written(above, "merkle-paths")
    return above


# ---- manifest ----------------------------------------------------------------------------------------------------------------------------


def build(docs: DataFrame, *, claimed_text: Column | None = None, levels: int = LEVELS) -> Manifest:
    """The manifest of documents: a leaf per row, a tree per source, a tree over the sources' roots.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Leaves of a source ascend by doc_id (nulls first; rows of equal id by their
    digests); every ``ARITY`` that follow each other are the children of a node, until one is left. Subroots in the order of their sources (null
    first, bytewise) have a tree of their own, with the root. ``claimed_text`` is what verification finds in place of text.
    Nulls count as such in the digest, so a null and an empty text differ; repeated rows are a leaf each; other columns are not looked at. An
    empty table has no root.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    # A table without a column has nulls there.
    col = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    head = [col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    key = F.coalesce(F.concat(F.lit("1"), col("source").cast("string")), F.lit(""))
    claimed = digest(*head, claimed_text if claimed_text is not None else col("text"))
    hashed = written(docs.select(key.alias("s"), F.col("doc_id").cast("long").alias("doc_id"), digest(*head, col("text")).alias("h"), claimed.alias("claimed"), F.monotonically_increasing_id().alias("tie")), "merkle-leaves")
    leaves = written(numbered(hashed, ["doc_id", "h", "tie"], "merkle-runs").select("s", "i", "h", "claimed", "doc_id"), "merkle-level")
    nodes, steps = _grow(spark, leaves, "merkle-nodes", levels)
    tops = written(_tops(leaves, spark.read.schema(_NODE).parquet(nodes)), "merkle-tops")

    source = numbered(tops.select(F.lit("").alias("s"), F.col("s").alias("name"), "h"), ["name"], "merkle-source-runs")
    source = written(source, "merkle-sources")
    above, above_steps = _grow(spark, source.select("s", "i", "h"), "merkle-top-nodes", levels)
    end = _tops(source, spark.read.schema(_NODE).parquet(above))
    root = end.select(F.lower(F.hex("h"))).first()
    one = end.select("s", "top", F.array().cast("array<string>").alias("path"), F.col("h").alias("subroot"))
    paths = _descend(spark, source.select("s", "i", "h"), above, above_steps, one, levels, False)
    named = source.select("i", F.col("name"), F.col("h").alias("subroot")).join(paths.select("i", "path"), "i").select(F.col("name").alias("s"), "path", "subroot")
    groups = written(tops.select("s", "top").join(named, "s"), "merkle-groups")
    return Manifest(spark, leaves, nodes, groups, root[0] if root else None, steps)


def proofs(manifest: Manifest, *, levels: int = LEVELS) -> DataFrame:
    """A row per leaf: doc_id, leaf, subroot, root, ``proof_sha256`` of its siblings up to the root, ``folded_root`` that the claimed leaf gives with these
    siblings, and whether that is the root."""
    found = _descend(manifest.spark, manifest.leaves, manifest.nodes, manifest.steps, manifest.groups, levels, True)
    root = F.lit(manifest.root)
    return found.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
