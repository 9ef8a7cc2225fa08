"""Graphs of near rows: pairs of fingerprints block by block, components, the greedy pass over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusloom.sources.tables import checkpointed

#: Fingerprints of a block, about; a task holds two blocks at a time. Tasks that the pairs of blocks are dealt to, at most.
CROWD, UNITS = 1 << 15, 1024
#: Edges of a component that one task settles in order; larger components are settled by rounds.
SMALL = 1 << 18


def _tile(held: list[pa.RecordBatch], bits: int, schema: pa.Schema):
    """Near pairs of one unit: the fingerprints of its first block against those of its second, or of one block against those behind them."""
    rows = pa.Table.from_batches(held).combine_chunks()
    second = rows.column("second").to_numpy()
    left, right = (rows, rows) if not second.any() else (rows.filter(pa.array(~second)), rows.filter(pa.array(second)))
    within = left is right
    mine, theirs = (t.column("print").to_numpy().view(np.uint64) for t in (left, right))
    found, many = [], 0

    def batch():
        at = np.repeat([i for i, _ in found], [len(x) for _, x in found]).astype(np.int64)
        to = np.concatenate([x for _, x in found])
        one, other = left.column("id").take(pa.array(at)).combine_chunks(), right.column("id").take(pa.array(to)).combine_chunks()
        less = pc.less(one, other)
        far = np.bitwise_count(mine[at] ^ theirs[to]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pc.if_else(less, one, other), pc.if_else(less, other, one), pa.array(far, pa.int32())], schema=schema)

    for i in range(len(mine)):
        start = i + 1 if within else 0
        near = np.flatnonzero(np.bitwise_count(theirs[start:] ^ mine[i]) <= bits)
        if len(near):
            found.append((i, near + start))
            many += len(near)
            if many >= 1 << 15:
                yield batch()
                found, many = [], 0
    if found:
        yield batch()


def _tiles(bits: int, schema: pa.Schema):
    """Units follow each other; one is held at a time."""

    def run(batches):
        now, held = None, []
        for b in batches:
            units = b.column("unit").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(units)) + 1).tolist(), len(units)] if len(units) else []
            for at, to in zip(cuts, cuts[1:]):  # noqa: B905
                if held and units[at] != now:
                    yield from _tile(held, bits, schema)
                    held = []
                now = units[at]
                held.append(b.slice(at, to - at))
        if held:
            yield from _tile(held, bits, schema)

    return run


def near_pairs(prints: DataFrame, *, key: str = "doc_id", bits: int = 12, blocks: int = 24, crowd: int | None = None) -> DataFrame:
    """(a, b, distance) of 64-bit fingerprints within ``bits``, a < b; equal fingerprints meet once, under their smallest key.

    At such a distance about one in a hundred pairs of random fingerprints shares any key that would have to bring near ones together, so all pairs are compared
    instead, at two to three nanoseconds each: distinct fingerprints are dealt to blocks of at most about ``crowd`` (``blocks`` of them where there are enough
    fingerprints), and each two blocks are a unit. A task holds a unit at a time; what is shuffled grows with fingerprints times blocks,
    the comparisons with the square of the fingerprints. Null keys and fingerprints are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    crowd = CROWD if crowd is None else crowd
    one = checkpointed(prints.where(F.col(key).isNotNull() & F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.min(key).alias("id")))
    n = one.count()
    parts = max(-(-n // crowd), min(blocks, -(-n // 512)), 1)
    dealt = one.select("id", F.col("fingerprint").alias("print"), F.pmod(F.xxhash64("fingerprint"), F.lit(parts)).alias("block"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    units = each.select((F.least("block", "other") * parts + F.greatest("block", "other")).alias("unit"), (F.col("block") > F.col("other")).alias("second"), "print", "id")
    schema = StructType([StructField("a", one.schema["id"].dataType), StructField("b", one.schema["id"].dataType), StructField("distance", IntegerType())])
    met = units.repartition(min(parts * (parts + 1) // 2, UNITS), "unit").sortWithinPartitions("unit")
    return met.mapInArrow(_tiles(bits, to_arrow_schema(schema)), schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of edges (a, b), named by their smallest node. Nulls and loops are left out.

    Rounds of two steps: every node hands its larger neighbours, then its smaller ones, to the smallest node that it knows; each is a grouped
    minimum and an equi-join. Rounds end when no edge changes; their number grows with the logarithm of the nodes.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = checkpointed(e), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return checkpointed(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def _in_order(batches):
    """(node, root) of rows with smaller neighbours. Edges come by component in order of (b, a): a row joins the smallest row near it that did not join
    another itself. The joined rows of one component at a time are held."""
    now, joined, taken, last = object(), set(), None, None
    kind = None
    for batch in batches:
        kind = batch.schema.field("a").type
        nodes, found = [], []
        for c, a, b in zip(*(batch.column(x).to_pylist() for x in ("component", "a", "b")), strict=True):
            if (c, b) != (now, last):
                if last is not None:
                    nodes.append(last)
                    found.append(last if taken is None else taken)
                if taken is not None:
                    joined.add(last)
                if c != now:
                    joined = set()
                now, last, taken = c, b, None
            if taken is None and a not in joined:
                taken = a
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(found, kind)], ["node", "root"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([last if taken is None else taken], kind)], ["node", "root"])


def _by_rounds(pairs: DataFrame) -> DataFrame:
    """(node, root) of components too large for a task. A round accepts rows without an open smaller neighbour and without an accepted one, and settles
    those beside an accepted one. A row with one open smaller neighbour alone is the opposite of it: such chains are followed by doubling, so a
    chain of n rows takes log(n) steps of one round."""
    pairs = checkpointed(pairs.select("a", "b").where("a < b").distinct())
    state = checkpointed(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while not state.where("kept is null").isEmpty():
        smaller = state.select(F.col("node").alias("a"), F.col("kept").alias("ka"))
        seen = pairs.join(smaller, "a").groupBy(F.col("b").alias("node")).agg(F.count_if("ka").alias("accepted"), F.count_if(F.col("ka").isNull()).alias("open"), F.max(F.when(F.col("ka").isNull(), F.col("a"))).alias("to"))
        rows = state.join(seen, "node", "left").select("node", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("accepted", F.lit(0)) > 0, False).when(F.coalesce("open", F.lit(0)) == 0, True).alias("kept"), F.when(F.col("open") == 1, F.col("to")).alias("to"))
        # What a row waits for, and whether it is the opposite.
        step = checkpointed(rows.withColumn("to", F.when(F.col("kept").isNull(), F.col("to"))).withColumn("flip", F.col("to").isNotNull()))
        while True:
            over = step.select(F.col("node").alias("to"), F.col("kept").alias("k2"), F.col("to").alias("t2"), F.col("flip").alias("f2"))
            met = step.join(over, "to", "left")
            went = F.col("to").isNotNull() & (F.col("k2").isNotNull() | F.col("t2").isNotNull())
            step = checkpointed(met.select("node", F.when(F.col("kept").isNull() & F.col("k2").isNotNull(), F.col("k2") != F.col("flip")).otherwise(F.col("kept")).alias("kept"),
                                           F.when(F.col("k2").isNull() & went, F.col("t2")).when(F.col("k2").isNull(), F.col("to")).alias("to"), F.when(F.col("k2").isNull() & went, F.col("flip") != F.col("f2")).otherwise(F.col("flip")).alias("flip"), went.alias("went")))
            if step.where("went").isEmpty():
                break
            step = step.drop("went")
        state = step.select("node", "kept")
    kept = state.where("kept").select(F.col("node").alias("a"))
    beside = pairs.join(kept, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return state.join(beside, "node", "left").select("node", F.when(F.col("kept"), F.col("node")).otherwise(F.col("root")).alias("root"))


def first_accepted(vertices: DataFrame, pairs: DataFrame, *, key: str = "doc_id", small: int | None = None) -> DataFrame:
    """(key, root): the greedy pass in key order. A row joins the smallest accepted row near it; if there is none it is accepted (root = key).

    Components do not touch each other: one of up to ``small`` edges is settled in order by one task, larger ones by rounds.
    """
    pairs = checkpointed(pairs.where("a < b").select("a", "b"))
    held = checkpointed(pairs.join(components(pairs).withColumnRenamed("node", "b"), "b"))
    large = held.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > (SMALL if small is None else small)).select("component")
    kind = pairs.schema["a"].dataType.simpleString()
    few = held.join(large, "component", "left_anti").repartition("component").sortWithinPartitions("component", "b", "a")
    roots = few.mapInArrow(_in_order, f"node {kind}, root {kind}")
    many = checkpointed(held.join(large, "component", "left_semi"))
    if not many.isEmpty():
        roots = roots.unionByName(_by_rounds(many))
    return vertices.select(key).join(roots.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("root", key).alias("root"))
