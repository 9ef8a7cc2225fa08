"""Sequence packing by minimum bin slack: subset-sum dynamic programming on bit sets over the multiset of remaining lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._base import bounded_batches, nested, text_or_empty, unnested, written
from corpusloom.llm.tokens import encoder, share_tokenizer


def best_fill(counts: dict[int, int], window: int) -> list[int]:
    """The multiset of lengths whose sum is closest to ``window`` without passing it, of those that hold the longest length.

    Reachable sums are the bits of an integer; a length with count c enters as groups of 1, 2, 4, ... copies. The bit sets after each group
    are kept and walked back to the counts.
    """
    longest = max(counts)
    room, reach, trail = window - longest, 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        k = 1
        while left > 0 and not reach >> room & 1:
            take = min(k, left)
            trail.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left, k = left - take, k * 2
    at, picked = reach.bit_length() - 1, [longest]
    for length, take, before in reversed(trail):
        if not before >> at & 1:
            at -= length * take
            picked += [length] * take
    return picked


def plan(counts: dict[int, int], window: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences) that use up ``counts``. Its size depends on the window, not on the input.

    A filling found for one sequence is repeated as often as the remaining counts allow, so each step uses up a length or halves it.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    while left:
        picked = best_fill(left, window)
        need: dict[int, int] = {}
        for length in picked:
            need[length] = need.get(length, 0) + 1
        times = min(left[k] // n for k, n in need.items())
        out.append((picked, times))
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def tokenized_pieces(docs: DataFrame, tokenizer: str, *, end_id: int, window: int) -> DataFrame:
    """(row, doc_id, doc_tokens, start, length, ids_crc32): whole windows cut from each document's start, then what remains."""
    spark = docs.sparkSession
    bounded_batches(spark)
    json = share_tokenizer(spark, tokenizer)

    def run(batches):
        enc, end = encoder(json.value), np.array([end_id], "<u4").tobytes()
        for b in batches:
            doc, total, start, length, crc = [], [], [], [], []
            for i, ids in zip(b.column(0).to_pylist(), enc.encode_many(b.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, window):
                    part = ids[4 * s : 4 * (s + window)]
                    doc.append(i)
                    total.append(n)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, total, start, length, crc)], ["doc_id", "doc_tokens", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, doc_tokens long, start long, length long, ids_crc32 long")


def padded_length(filled: int, window: int = 1024) -> int:
    """The length a sequence is stored at: its own where that is a power of two, else the window."""
    return filled if filled & (filled - 1) == 0 else window


def pack(pieces: DataFrame, *, window: int = 1024) -> DataFrame:
    """Adds sequence_id, offset and padded_length (the sequence's) to rows with ``length`` (1 to ``window``), filling sequences by minimum bin slack.

    Only the histogram of lengths (at most ``window`` numbers) and the plan made from it reach the driver. A piece's rank among those of its
    length is its rank in its partition plus those of earlier partitions; the plan maps (length, rank) to a place. No length is gathered in
    a task, so a length that a third of all pieces share does no harm. Repeated rows are pieces of their own; columns of the added names are
    replaced. Sequences are padded to ``window`` unless their sum is a power of two. An empty table gives an empty result.
    """
    keys = [c for c in ("doc_id", "start", "ids_crc32") if c in pieces.columns] or ["length"]
    rows = written(pieces.select(nested(pieces), F.col("length").cast("long").alias("length"), F.struct(*keys).alias("at"), F.spark_partition_id().alias("part")), "pieces")
    local = written(rows.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in local.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = plan(counts, window)

    # For each length: first ranks of its slots, and what follows from them: first sequence, offsets in it, its padded length.
    seq, used, slots = 0, dict.fromkeys(counts, 0), {k: [] for k in counts}
    for lengths, times in made:
        offsets: dict[int, list[int]] = {}
        at = 0
        for length in lengths:
            offsets.setdefault(length, []).append(at)
            at += length
        for length, offs in offsets.items():
            slots[length].append((used[length], seq, offs, padded_length(at, window)))
            used[length] += times * len(offs)
        seq += times
    shared = pieces.sparkSession.sparkContext.broadcast(slots)

    # Counts by partition and length grow with the input: they meet the pieces in the exchange that ranks these anyway.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = local.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")).hint("merge")
    within = Window.partitionBy("part", "length").orderBy("at")
    ranked = rows.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)

    def run(batches):
        starts = {k: np.array([s[0] for s in v]) for k, v in shared.value.items()}
        for b in batches:
            ids, offs, padded = [], [], []
            for length, rank in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                first, at, inside, size = shared.value[length][int(np.searchsorted(starts[length], rank, "right")) - 1]
                q, r = divmod(rank - first, len(inside))
                ids.append(at + q)
                offs.append(inside[r])
                padded.append(size)
            yield pa.RecordBatch.from_arrays([b.column(2), *[pa.array(x, pa.int64()) for x in (ids, offs, padded)]], ["row", *added])

    added = ["sequence_id", "offset", "padded_length"]
    schema = T.StructType([rows.schema["row"], *[T.StructField(c, T.LongType()) for c in added]])
    return ranked.select("length", "rank", "row").mapInArrow(run, schema).select(*unnested([c for c in pieces.columns if c not in added]), *added)


def pack_documents(docs: DataFrame, tokenizer: str, *, end_id: int = 0, window: int = 1024) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length: a row per piece of a document. Null texts are empty;
    rows that repeat a doc_id or have none are documents of their own; of other columns none is read."""
    return pack(tokenized_pieces(docs, tokenizer, end_id=end_id, window=window), window=window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length")
