"""Chroma audio fingerprints: integral-image filters over pitch-class frames, packed integers, offset histograms, alignment by bit errors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._base import bounded_batches, written

FRAME, HOP = 1024, 256
#: Two bits of each of sixteen filters: (shape, first pitch class, pitch classes, frames), made by a rule.
FILTERS = [(i % 4, (5 * i) % 9, 3 + (i % 2), 4 + 2 * (i % 3)) for i in range(16)]
#: A filter's log ratio is cut at these values.
CUTS = (-0.25, 0.0, 0.25)
WIDTH = max(f[3] for f in FILTERS)
#: Changes from one integer to the next that both prints of an alignment must have where they meet, and the share of bit errors it may have.
MIN_TURNS, MAX_ERROR = 4, 0.2
#: Integers (a second of sound) that must meet; of a shorter print, all.
MIN_MEET = 16
#: Halves of an integer (by filters: the first, the last, every other one) that vote, and votes of one offset that make it a candidate. With 20 %
#: random bit errors a clip of 38 integers has 4.3 votes to expect at its place, with 15 % it has 11.
MASKS, VOTES = (0xFFFF0000, 0x0000FFFF, 0xCCCCCCCC, 0x33333333), 2
#: Votes that a worker holds at once, about.
VOTES_AT_ONCE = 1 << 20
#: Bytes of prints in a block of queries and in one of stored prints.
QUERY_BLOCK, STORED_BLOCK = 256 << 10, 64 << 10


def chroma(pcm: np.ndarray, rate: int) -> np.ndarray:
    """Frames of twelve pitch-class energies, each scaled to length one (silence: zeros)."""
    if len(pcm) < FRAME:
        return np.zeros((0, 12))
    n = 1 + (len(pcm) - FRAME) // HOP
    frames = np.lib.stride_tricks.as_strided(pcm, (n, FRAME), (pcm.strides[0] * HOP, pcm.strides[0]))
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = (hz >= 55) & (hz <= 3520)
    pitch = np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12
    out = power[:, use] @ np.eye(12)[pitch]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 1e-9, out / np.maximum(size, 1e-9), 0.0)


def fingerprint(pcm: np.ndarray, rate: int) -> np.ndarray:
    """Packed 32-bit integers, one for each place of the widest filter; none for a recording that is shorter."""
    image = chroma(np.ascontiguousarray(pcm, np.float64), rate)
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    whole = np.zeros((len(image) + 1, 13))
    whole[1:, 1:] = image.cumsum(0).cumsum(1)
    t = np.arange(n)
    area = lambda a, b, low, high: whole[b, high] - whole[a, high] - whole[b, low] + whole[a, low]
    out = np.zeros(n, np.uint32)
    for shape, low, high, wide in FILTERS:
        top, end, mid, half = low + high, t + wide, low + high // 2, t + wide // 2
        total = area(t, end, low, top)
        part = [area(t, half, low, top), area(t, end, low, mid), area(t, half, low, mid) + area(half, end, mid, top), area(t + wide // 4, t + wide - wide // 4, low, top)][shape]
        ratio = np.log1p(part) - np.log1p(total - part)
        level = np.searchsorted(CUTS, ratio)
        out = out << np.uint32(2) | (level ^ level >> 1).astype(np.uint32)
    return out


def align(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """Share of unequal bits where ``a`` lies over ``b`` from ``offset`` on; 1.0 where they do not meet."""
    i, j = max(0, -offset), min(len(a), len(b) - offset)
    if j - i < MIN_TURNS:
        return 1.0
    return float(np.bitwise_count(a[i:j] ^ b[i + offset : j + offset]).mean() / 32)


def fingerprints(recordings: DataFrame, rate: int) -> DataFrame:
    """(id, print): packed integers as little-endian bytes, of rows (id, pcm) with 16-bit little-endian mono samples. Null, empty or short samples:
    no integers; a row per row, whatever its id; recordings of any length, whole, one at a time."""

    def run(batches):
        for b in batches:
            prints = [fingerprint(np.frombuffer(x[: len(x) // 2 * 2], "<i2"), rate).astype("<u4").tobytes() if x else b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.binary())], ["id", "print"])

    bounded_batches(recordings.sparkSession)
    return recordings.select("id", "pcm").mapInArrow(run, "id long, print binary")


def _packed_rows(prints: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All integers one after another, the row and the time of each, and the begins and sizes of the rows."""
    sizes = np.array([len(p) for p in prints], np.int64)
    begin = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(prints)), sizes)
    return np.concatenate([*prints, np.empty(0, np.uint32)]).astype(np.uint32), row, np.arange(sizes.sum()) - begin[row], begin, sizes


def _histogram(asked: list[np.ndarray], prints: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, r, offset) of each place with at least ``VOTES`` votes: a pair of integers that agree under one of ``MASKS`` votes for its offset."""
    flat, row, time, _, _ = _packed_rows(asked)
    other, owner, at, _, sizes = _packed_rows(prints)
    if not len(flat) or not len(other):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    longest, span = int(time.max()) + 1, int(time.max()) + int(at.max()) + 2
    sides = []
    for mask in MASKS:
        order = np.argsort(flat & np.uint32(mask), kind="stable")
        keys = (flat & np.uint32(mask))[order]
        low = np.searchsorted(keys, other & np.uint32(mask), "left")
        sides.append((order, low, np.searchsorted(keys, other & np.uint32(mask), "right") - low))
    # Whole recordings at a time, about so many votes that they stay within some tens of MB.
    weight = np.bincount(owner, sum(n for _, _, n in sides), len(sizes))
    group = (np.cumsum(weight) // VOTES_AT_ONCE).astype(np.int64)[owner]
    found = []
    for g in np.unique(group):
        here, codes = np.flatnonzero(group == g), []
        for order, low, n in sides:
            n = n[here]
            own = np.repeat(here, n)
            q = order[np.repeat(low[here] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            codes.append((row[q] * len(sizes) + owner[own]) * span + at[own] - time[q] + longest)
        code, votes = np.unique(np.concatenate(codes), return_counts=True)
        found.append(code[votes >= VOTES])
    code = np.concatenate(found)
    return code // span // len(sizes), code // span % len(sizes), code % span - longest


def _matches(asked: list[np.ndarray], prints: list[np.ndarray]) -> list[tuple[int, int, int, float]]:
    """(a, r, offset, bit_error) of each pair that aligns: of the voted offsets of at most ``MAX_ERROR`` bit errors the one with the most bits
    agreeing beyond that bound (of equals, the nearest to 0, then the smallest)."""
    all_a, all_r, all_offset = _histogram(asked, prints)
    flat, _, _, begin, sizes = _packed_rows(asked)
    other, _, _, start, lengths = _packed_rows(prints)
    # Held notes and silence tell little: where the two meet, both must change often enough.
    turns = lambda x: np.r_[0, 0, np.cumsum(x[1:] != x[:-1])]
    turned, turned_other = turns(flat), turns(other)
    kept = []
    for k in range(0, len(all_a), 1 << 18):
        a, r, offset = (x[k : k + (1 << 18)] for x in (all_a, all_r, all_offset))
        low, high = np.maximum(0, -offset), np.minimum(sizes[a], lengths[r] - offset)
        wrong = np.zeros(len(a), np.int64)
        for i in range(int(high.max(initial=0))):
            on = np.flatnonzero((i >= low) & (i < high))
            wrong[on] += np.bitwise_count(flat[begin[a[on]] + i] ^ other[start[r[on]] + offset[on] + i])
        both = high - low
        # Changes within the part that meets: the step into its first integer is none of them.
        t = [f[b + high] - f[np.minimum(b + low + 1, b + high)] for f, b in ((turned, begin[a]), (turned_other, start[r] + offset))]
        good = np.flatnonzero((both >= np.minimum(MIN_MEET, np.minimum(sizes[a], lengths[r]))) & (wrong <= MAX_ERROR * 32 * both) & (t[0] >= MIN_TURNS) & (t[1] >= MIN_TURNS))
        kept.append((a[good], r[good], offset[good], MAX_ERROR * 32 * both[good] - wrong[good], wrong[good] / (32 * np.maximum(both[good], 1))))
    if not kept:
        return []
    a, r, offset, spare, error = map(np.concatenate, zip(*kept, strict=True))
    order = np.lexsort((offset, np.abs(offset), -spare.round(6), r, a))
    first = order[np.unique((a * (len(prints) + 1) + r)[order], return_index=True)[1]]
    return [(int(a[x]), int(r[x]), int(offset[x]), float(error[x])) for x in first]


def _aligned(batches):
    for b in batches:
        for asked, stored in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got = _matches([np.frombuffer(x["print"], "<u4") for x in asked], [np.frombuffer(x["print"], "<u4") for x in stored])
            cols = [pa.array([asked[a]["id"] for a, *_ in got], pa.int64()), pa.array([stored[r]["id"] for _, r, *_ in got], pa.int64()), pa.array([o for _, _, o, _ in got], pa.int64()), pa.array([e for *_, e in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["q", "r", "offset", "bit_error"])


def _blocks(classes: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
    """(block, name): the prints of a class each in lists of about ``size`` bytes, and the number of blocks."""
    held = classes.where(F.octet_length("print") > 0)
    total = held.agg(F.sum(F.octet_length("print"))).first()[0] or 0
    n = 1 + total // size
    return held.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(f"{name}b")).agg(F.collect_list(F.struct("id", "print")).alias(name)), n


def _alignments(qcl: DataFrame, cls: DataFrame) -> DataFrame:
    """(q, r, offset, bit_error): the classes of query prints against all stored ones, in pairs of blocks of bounded size."""
    bounded_batches(qcl.sparkSession)
    (q, n_q), (r, n_r) = _blocks(qcl, "q", QUERY_BLOCK), _blocks(cls, "r", STORED_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    met = q.withColumn("rb", every(n_r)).join(r.withColumn("qb", every(n_q)).hint("shuffle_hash"), ["qb", "rb"])
    return met.select("q", "r").mapInArrow(_aligned, "q long, r long, offset long, bit_error double")


def _named(prints: DataFrame) -> DataFrame:
    """(id, print) of the rows that have an id; a null print is empty."""
    return prints.where("id is not null").select("id", F.coalesce("print", F.lit(b"")).alias("print"))


def _classes(prints: DataFrame) -> DataFrame:
    """(print, id, n): the distinct prints of named rows, each with the smallest id that has it and how many rows do."""
    return prints.groupBy("print").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def members(stored: DataFrame) -> DataFrame:
    """(id, class_id): every recording and the smallest id of those with its print, which is what ``matches`` calls match_id. Rows without id
    are left out."""
    stored = _named(stored)
    return stored.join(_classes(stored).select("print", F.col("id").alias("class_id")), "print").select("id", "class_id")


def matches(queries: DataFrame, stored: DataFrame) -> DataFrame:
    """(query_id, match_id, offset, bit_error, n_copies): a row per query print and class of recordings that align, all of them.

    Both sides have (id, print). Equal prints form a class first, under its smallest id, so a recording with many copies is aligned once;
    ``members`` has the copies. Integers that agree in half of their bits vote for the offset between their times; offsets with ``VOTES`` votes
    are aligned bit by bit. Two prints match when at such an offset ``MIN_MEET`` integers meet, both change ``MIN_TURNS`` times there and at
    most ``MAX_ERROR`` of the bits differ. A query that matches nothing has one row of nulls and 0 copies; so has a print without integers (null, empty or
    short samples). Rows without id are left out, a repeated query id has the rows of each of its prints, empty tables give no rows or rows
    without match. Recordings of any length take part whole; the work grows with queries times recordings, in blocks.
    """
    queries, stored = _named(queries), _named(stored)
    qcl, cls = written(_classes(queries), "query-prints"), written(_classes(stored), "prints")
    found = _alignments(qcl, cls).join(cls.select(F.col("id").alias("r"), "n"), "r")
    asked = queries.select(F.col("id").alias("query_id"), "print").join(qcl.select("print", F.col("id").alias("q")), "print").select("query_id", "q")
    rows = asked.join(found, "q", "left")
    return rows.select("query_id", F.col("r").alias("match_id"), "offset", F.round("bit_error", 6).alias("bit_error"), F.coalesce("n", F.lit(0)).alias("n_copies"))


def search(queries: DataFrame, stored: DataFrame) -> DataFrame:
    """(query_id, match_id, offset, bit_error, n_matches, matches): ``matches`` with a row per query: the best class (least bit error; of equals,
    the smallest id), how many recordings align, and all classes that do, best first, as structs. A list has a few numbers per class of equal
    prints, not per recording."""
    hit = F.when(F.col("match_id").isNotNull(), F.struct("bit_error", "match_id", "offset", "n_copies"))
    rows = matches(queries, stored).groupBy("query_id").agg(F.sort_array(F.array_distinct(F.collect_list(hit))).alias("matches"))
    total = F.aggregate("matches", F.lit(0).cast("long"), lambda n, m: n + m["n_copies"])
    best = lambda name: F.try_element_at("matches", F.lit(1))[name].alias(name)
    return rows.select("query_id", best("match_id"), best("offset"), best("bit_error"), total.alias("n_matches"), "matches")


def sonify(vectors: DataFrame, rate: int, *, clip: tuple[float, float] | None = None) -> DataFrame:
    """(id, pcm) from (id, vector): a deterministic melody, two tones an eighth of a second, whose pitches are the vector's values cut to twelve
    steps. ``clip``: only these seconds of it. Null or empty vectors are silent; null values are 0. A row per row, whatever its id."""

    def run(batches):
        slot = rate // 8
        t = np.arange(slot) / rate
        fade = np.minimum(1, np.minimum(np.arange(slot), slot - np.arange(slot)) / (slot / 16))
        tones = np.array([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) * fade for k in range(24)])
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                v = np.nan_to_num(np.array([x or 0.0 for x in v or []], np.float64))
                v = v[: len(v) // 2 * 2]
                step = np.clip((v * 24 + 6).astype(int), 0, 11)
                wave = (tones[step[::2]] + tones[step[1::2] + 12] * 0.7).ravel() if len(v) else np.zeros(0)
                pcm = (wave * 12000).astype("<i2")
                out.append((pcm[int(clip[0] * rate) : int(clip[1] * rate)] if clip else pcm).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "pcm"])

    bounded_batches(vectors.sparkSession)
    return vectors.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(run, "id long, pcm binary")
