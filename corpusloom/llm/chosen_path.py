"""N-gram Jaccard join by chosen paths.

Sets of word shingles are split, again and again, on a shingle that the sets of a bucket share by sampling: the one that a random hash puts
first in each set (two sets agree on it with the probability of their Jaccard similarity). A bucket of at most ``LEAF`` sets is compared by
brute force; a larger one is split by the next sampled shingle. As many independent runs are made as the target recall takes (``RUNS``). What meets is then compared exactly.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._base import WORD, bounded_batches, components, find, hot_split, nested, text_or_empty, unnested, written

#: Recall that the runs are to reach for a pair at similarity 0.8 whose bucket takes ``LEVELS`` sampled shingles to get small.
TARGET, LEVELS = 0.995, 3
#: Independent runs until that recall (8: a run keeps such a pair together with probability 0.8 ** 3), sampled shingles of a path at most, and
#: sets that a bucket is compared by brute force up to.
RUNS, DEPTH, LEAF = math.ceil(math.log(1 - TARGET) / math.log(1 - 0.8**LEVELS)), 8, 128
#: Sketches of this much agreement join a component, whose members are then compared exactly: 0.8 less four standard deviations.
LOOSE = 0.6
#: Sets, and shingles, of a block of an exact comparison at most (a set of more shingles is a block of its own).
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Bytes of shingle sets that a worker gathers before it hands them on.
SET_BYTES = 2 << 20

_RNG = np.random.default_rng(20240607)
_MUL = _RNG.integers(1, 1 << 63, RUNS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, RUNS * DEPTH, dtype=np.uint64)
_HASHES: dict[str, int] = {}


def shingles(text: str, n: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's runs of ``n`` lower-cased words; under ``n`` words, of the words as one run."""
    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    if len(_HASHES) > 300_000:
        _HASHES.clear()
    got = _HASHES.get
    out = []
    for w in words:
        h = got(w)
        if h is None:
            h = _HASHES[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    h = np.array(out, np.uint64)
    k = min(n, len(h))
    mixed = np.full(len(h) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            mixed = (mixed ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def sketch(s: np.ndarray) -> np.ndarray:
    """The sampled shingles: for each of RUNS * DEPTH random hashes, 32 bits of the least value over the set."""
    low = np.full(RUNS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 2048):
            h = s[i : i + 2048, None] * _MUL + _ADD
            low = np.minimum(low, (h ^ h >> np.uint64(32)).min(0))
    return (low >> np.uint64(16)).astype(np.uint32)


def _profiles(n: int):
    def run(batches):
        for b in batches:
            keys, sizes, sigs = [], [], []
            for text in b.column(2).to_pylist():
                s = shingles(text, n)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"=" + xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
                sizes.append(len(s))
                sigs.append(sketch(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "th", "key", "size", "sig"])

    return run


def _runs(table_batches, column: int):
    """Consecutive rows of equal ``column`` as one table, whatever batches they come in."""
    held: list[pa.RecordBatch] = []
    for b in table_batches:
        if not b.num_rows:
            continue
        keys = b.column(column).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        bounds = [0, *cuts.tolist(), b.num_rows]
        if held and held[0].column(column)[0].as_py() != keys[0]:
            yield held
            held = []
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            if i:
                yield held
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield held


def _leaf_edges(batches):
    """Brute force over the sketches of a bucket; of the links found, the edges of a spanning forest."""
    for rows in _runs(batches, 0):
        ids = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in rows])
        if len(ids) < 2:
            continue
        sigs = np.frombuffer(b"".join(x for b in rows for x in b.column(2).to_pylist()), np.uint32).reshape(len(ids), -1)
        need = LOOSE * sigs.shape[1]
        parent, a, c = list(range(len(ids))), [], []
        for i in range(len(ids) - 1):
            for j in np.flatnonzero((sigs[i + 1 :] == sigs[i]).sum(1) >= need) + i + 1:
                x, y = find(parent, i), find(parent, int(j))
                if x != y:
                    parent[y] = x
                    a.append(ids[i])
                    c.append(ids[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])


def _compare(num: int, den: int):
    """Exact comparison within a unit: rows (unit, comp, key, block, weight, shingles, crossed) to (comp, key, links, root key of its local class)."""

    def run(batches):
        for rows in _runs(batches, 0):
            seen: dict[bytes, int] = {}
            comp, crossed = rows[0].column(1)[0].as_py(), rows[0].column(6)[0].as_py()
            keys, blocks, weights, sets = [], [], [], []
            for b in rows:
                for key, block, w, s in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                    if key not in seen:  # a text that repeated rows brought twice
                        seen[key] = len(keys)
                        keys.append(key)
                        blocks.append(block)
                        weights.append(w)
                        sets.append(np.frombuffer(s, np.uint64))
            m = len(keys)
            sizes, block, weight = np.array([len(s) for s in sets]), np.array(blocks), np.array(weights)
            both = np.zeros((m, m), np.float64)
            flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
            _, at, df = np.unique(flat, return_inverse=True, return_counts=True)
            shared = df > 1
            number = np.cumsum(shared) - 1
            keep = shared[at]
            at, owner = number[at[keep]], owner[keep]
            order = np.argsort(at, kind="stable")
            at, owner = at[order], owner[order]
            width = max(256, (4 << 20) // max(m, 1) // 4)
            total = int(shared.sum())
            for low in range(0, total, width):
                i, j = np.searchsorted(at, [low, low + width])
                part = np.zeros((m, min(width, total - low)), np.float32)
                part[owner[i:j], at[i:j] - low] = 1
                both += part @ part.T
            near = both * (num + den) >= num * (sizes[:, None] + sizes[None, :])
            np.fill_diagonal(near, False)
            if crossed:  # pairs within a block are the business of the block's own unit, also where the other block is empty
                near &= block[:, None] != block[None, :]
            parent = list(range(m))
            for i, j in zip(*np.nonzero(np.triu(near)), strict=True):
                x, y = find(parent, int(i)), find(parent, int(j))
                if x != y:
                    parent[max(x, y)] = min(x, y)
            links = (near * weight[None, :]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array([comp] * m, pa.int64()), pa.array(keys, pa.binary()), pa.array(links.astype(np.int64)), pa.array([keys[find(parent, i)] for i in range(m)], pa.binary())], ["comp", "key", "links", "root"])

    return run


_UNITS = {"unit": pa.int64(), "comp": pa.int64(), "key": pa.binary(), "block": pa.int64(), "weight": pa.int64(), "sets": pa.binary(), "crossed": pa.bool_()}


def _unit_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), _UNITS.values(), strict=True)], list(_UNITS))


def _sets(n: int):
    def run(batches):
        rows, held = [], 0
        for b in batches:
            for text, key, c, nb, w in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                s = shingles(text, n).tobytes()
                own = int.from_bytes(key[:8], "little") % nb
                for other in range(nb):
                    lo, hi = sorted((own, other))
                    rows.append((xxhash.xxh64_intdigest(f"{c}:{lo}:{hi}") - (1 << 63), c, key, own, w, s, lo != hi))
                    held += len(s)
                    if held >= SET_BYTES:  # a set of many blocks is as many rows: they leave in batches of bounded size
                        yield _unit_rows(rows)
                        rows, held = [], 0
        if rows:
            yield _unit_rows(rows)

    return run


_KID = "cast(conv(hex(substring(key, 1, 8)), 16, -10) as long)"


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """(a, b): spanning edges of what chosen paths bring together. ``nodes``: kid, key, sig."""
    rows = nodes.select("kid", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("run"), "sig").select("kid", "run", F.expr(f"substring(sig, 1 + run * {4 * DEPTH}, {4 * DEPTH})").alias("path"))
    path = lambda d: F.xxhash64("run", F.expr(f"substring(path, 1, {4 * d})"))
    leaves, open_, total = [], rows, RUNS * nodes.count()
    for d in range(1, DEPTH + 1):
        open_ = open_.withColumn("bucket", path(d))
        sizes = written(open_.groupBy("bucket").agg(F.count("*").alias("n"), F.min("kid").alias("low")).where("n > 1"), "bucket-sizes")
        # A bucket may hold a third of all sets: rows of hot ones stay where they are, the others are shuffled.
        hot, rest, cold = hot_split(open_, sizes, ["bucket"], total)
        met = written(hot.unionByName(rest.join(cold, "bucket")), "paths")
        leaves.append(met.where(f"n <= {LEAF}").select("bucket", "kid"))
        open_ = met.where(f"n > {LEAF}").select("kid", "run", "path")
        if open_.isEmpty():
            break
    else:
        # DEPTH sampled shingles in common: all but certain to be near; they join their bucket's first set and are compared exactly below.
        stars = met.where(f"n > {LEAF}").select(F.col("low").alias("a"), F.col("kid").alias("b"))
        leaves.append(None)
    small = [x for x in leaves if x is not None]
    one = small[0]
    for x in small[1:]:
        one = one.unionByName(x)
    full = one.join(nodes.select("kid", "sig"), "kid").select("bucket", "kid", "sig")
    edges = full.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_leaf_edges, "a long, b long")
    return edges.union(stars) if leaves[-1] is None else edges


def near_classes(docs: DataFrame, *, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """A row per row of ``docs``: doc_id, class_id, n_links, class_size, th (xxhash64 of the text) and keeps (true for one text of each class).

    Two texts are linked when the Jaccard similarity of their sets of ``n``-word shingles (words: ``\\w+``, lower-cased; shorter texts: all
    words as one shingle) is at least ``threshold``. ``class_id`` is the smallest doc_id of the connected texts, ``n_links`` the number of
    other rows that a row is linked to, copies included. Equal sets collapse first and stand in the join once. Null texts are empty; texts
    without words are linked to equal texts alone. Rows may repeat ids or lack one. An empty table gives an empty result.

    Components of loosely agreeing sketches are compared exactly, all pairs of a component, in blocks: only counts and the edges of spanning
    forests leave a task, never the pairs, and a large component is many tasks.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))
    prof = written(body.select("doc_id", "th", "text").mapInArrow(_profiles(n), "doc_id long, th long, key binary, size long, sig binary"), "profiles")
    nodes = prof.groupBy("key").agg(F.count("*").alias("weight"), F.max("size").alias("size"), F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "th")).alias("rep"), F.max("sig").alias("sig"))
    nodes = written(nodes.withColumn("kid", F.expr(_KID)), "nodes")
    comp = components(candidate_edges(nodes.where("size > 0").select("kid", "sig")), "comp")

    member = nodes.drop("sig").join(comp.withColumnRenamed("node", "kid"), "kid")
    stats = member.groupBy("component").agg(F.count("*").alias("m"), F.sum("size").alias("total"))
    blocks = stats.where("m > 1").select("component", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("long").alias("nb"))
    member = written(member.join(blocks, "component").select("rep.doc_id", "rep.th", "key", F.col("component").alias("comp"), "nb", "weight"), "members")
    # Members grow with the input: they are never broadcast, so the join is planned alike at every size.
    texts = body.join(member.withColumnRenamed("doc_id", "rep_id").withColumnRenamed("th", "rep_th").hint("merge"), (F.col("doc_id").eqNullSafe(F.col("rep_id"))) & (F.col("th") == F.col("rep_th")))
    th = Fraction(str(threshold))
    units = texts.select("text", "key", "comp", "nb", "weight").mapInArrow(_sets(n), "unit long, comp long, key binary, block long, weight long, sets binary, crossed boolean")
    found = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_compare(th.numerator, th.denominator), "comp long, key binary, links long, root binary")
    found = written(found, "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))

    # Components of one block have their classes; those of several blocks join theirs by the roots that blocks gave a text.
    kid = lambda c: F.expr(_KID.replace("key", c))
    several = found.join(member.where("nb > 1").select("comp").distinct(), "comp", "left_semi").where("key <> root").select(kid("key").alias("a"), kid("root").alias("b"))
    joined = components(several, "classes")
    single = found.join(member.where("nb > 1").select("comp").distinct(), "comp", "left_anti").select(kid("key").alias("kid"), kid("root").alias("class"))
    classes = single.union(joined.select("node", "component"))
    graph = nodes.select("kid", "key", "weight", "low", "rep").join(classes, "kid", "left").join(links, "key", "left").withColumn("class", F.coalesce("class", "kid"))
    whole = graph.groupBy("class").agg(F.min("low").alias("class_id"), F.sum("weight").alias("class_size"), F.min("rep").alias("first"))
    result = graph.join(whole, "class").select("key", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "first")
    result = written(result, "class-nodes")
    rows = prof.select("doc_id", "th", "key").join(result, "key")
    return rows.select("doc_id", "class_id", "n_links", "class_size", "th", F.struct("doc_id", "th").eqNullSafe(F.col("first")).alias("keeps"))


def keep_one(docs: DataFrame, *, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one row of each class of ``near_classes``: that of the smallest doc_id (a row without id only
    where no row of the class has one; of equal ids and texts any row). All columns stay as they are, whatever their names; null texts are empty.
    An empty table gives an empty result."""
    kept = written(near_classes(docs, n=n, threshold=threshold).where("keeps").select(F.col("doc_id").alias("id"), "th"), "kept")
    first = kept.groupBy("id", "th").agg(F.count("*").alias("times"))
    repeated = not first.where("times > 1").isEmpty()
    first = first.select(F.col("id").alias("first_id"), F.col("th").alias("first_th"))
    marked = docs.select(nested(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("th"))
    held = marked.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th")))
    return (held.dropDuplicates(["id", "th"]) if repeated else held).select(*unnested(docs.columns))
