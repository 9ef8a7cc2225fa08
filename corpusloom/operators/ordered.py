"""What depends on the rows before: places, carried values, next-fit batches, as scans of sorted runs. A group of any size is shared by tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from corpusloom.sources.tables import checkpointed


def _earlier():
    return Window.partitionBy("__by").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)


def _fresh(column: pa.Array, last) -> np.ndarray:
    """Whether a row's value differs from that of the row before; ``last`` is the value before the first row."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        out[1:] = pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
    out[0] = last is None or column[0].as_py() != last[0]
    return out


def _scan(values: list[str]):
    """Adds the task, the place in it among rows of equal group, and what ``values`` last were there."""

    def run(batches):
        task, last, n, held = TaskContext.get().partitionId(), None, 0, dict.fromkeys(values)
        for b in batches:
            if not len(b):
                continue
            group = b.column("__by")
            keys = pc.struct_field(group, [0]) if pa.types.is_struct(group.type) else group
            # Two nulls are one group.
            fresh = _fresh(keys, last)
            empty = pc.is_null(keys).to_numpy(zero_copy_only=False)
            fresh[1:] &= ~(empty[1:] & empty[:-1])
            rows = np.arange(len(b))
            begin = np.maximum.accumulate(np.where(fresh, rows, 0))
            goes_on = np.cumsum(fresh) == 0
            place = np.where(goes_on, rows + n, rows - begin)
            cols, names = [*b.columns], [*b.schema.names]
            for v in values:
                at = names.index(v)
                seen = np.maximum.accumulate(np.where(pc.is_valid(b.column(v)).to_numpy(zero_copy_only=False), rows, -1))
                filled = b.column(v).take(pa.array(np.where(seen >= begin, seen, 0), mask=(seen < begin) | (seen < 0)))
                before = pa.scalar(held[v], b.column(v).type)
                cols[at] = pc.if_else(pa.array(goes_on & (seen < 0)), before, filled)
                held[v] = cols[at][-1].as_py()
            last, n = (keys[-1].as_py(),), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(b), task), pa.int32()), pa.array(place, pa.int64())], [*names, "__run", "__place"])

    return run


def _scanned(rows: DataFrame, by: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Rows sorted by range, with ``__by``, ``__run``, ``__place`` and the carried ``values``, as a table."""
    own = rows.withColumns({"__by": F.struct(*by) if by else F.struct(F.lit(0).alias("all")), **values})
    if len(by) > 1:
        own = own.withColumn("__by", F.struct(F.to_json("__by", {"ignoreNullFields": "false"}).alias("all")))
    ranged = own.repartitionByRange("__by", *order).sortWithinPartitions("__by", *order)
    schema = StructType([*own.schema.fields, StructField("__run", IntegerType()), StructField("__place", LongType())])
    return checkpointed(ranged.mapInArrow(_scan(list(values)), schema))


def _spanning(runs: DataFrame) -> DataFrame:
    """Groups that earlier runs hold too. A run begins with at most one of them, so there is at most a row a run, and it is broadcast."""
    return F.broadcast(runs.where("__before is not null"))


def with_place(rows: DataFrame, *, by: list[str], order: list[str], out: str) -> DataFrame:
    """Adds ``out``, the place (from 0) among the rows of equal ``by`` in ``order``."""
    runs = _scanned(rows, by, order, {})
    counts = runs.groupBy("__by", "__run").agg(F.count("*").alias("n"))
    before = counts.withColumn("__before", F.sum("n").over(_earlier())).select("__by", "__run", "__before")
    met = runs.join(_spanning(before), ["__by", "__run"], "left")
    return met.withColumn(out, F.col("__place") + F.coalesce("__before", F.lit(0))).drop("__by", "__run", "__place", "__before")


def carried(rows: DataFrame, values: dict[str, Column], *, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``values``, each as it last was (not null) in this row or before it among the rows of equal ``by`` in ``order``.

    A scan within each sorted run, then one over the last values of the runs, then the rows again: no window over all rows. Rows that are equal in
    ``order`` have no order among them. Without ``by`` all rows are one group.
    """
    names = {f"__v{i}": v for i, v in enumerate(values.values())}
    runs = _scanned(rows, by, order, names)
    ends = runs.groupBy("__by", "__run").agg(*[F.max_by(v, "__place").alias(v) for v in names])
    held = [F.last(v, ignorenulls=True).over(_earlier()).alias(f"{v}_before") for v in names]
    before = ends.select("__by", "__run", *held, F.count("*").over(_earlier()).alias("n")).where("n > 0").drop("n")
    met = runs.join(F.broadcast(before), ["__by", "__run"], "left")
    out = met.withColumns({name: F.coalesce(v, f"{v}_before") for name, v in zip(values, names, strict=True)})
    return out.drop("__by", "__run", "__place", *names, *[f"{v}_before" for v in names])


def running_max(rows: DataFrame, *, by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds ``out``, the largest ``value`` up to and with a row among those of equal ``by`` in ``order``: within a run, then what earlier runs have."""
    runs = _scanned(rows.withColumn("__v", value), by, order, {})
    within = Window.partitionBy("__by", "__run").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    most = runs.groupBy("__by", "__run").agg(F.max("__v").alias("m"))
    before = most.withColumn("__before", F.max("m").over(_earlier())).select("__by", "__run", "__before")
    met = runs.withColumn(out, F.max("__v").over(within)).join(_spanning(before), ["__by", "__run"], "left")
    return met.withColumn(out, F.greatest(out, "__before")).drop("__by", "__run", "__place", "__v", "__before")


def paced(rows: DataFrame, *, by: str, order: list[str], at: str, gap: int, out: str = "starts") -> DataFrame:
    """Adds ``out``: when each request may start so that those of one ``by`` (a host) are at least ``gap`` apart, in ``order``, none before its ``at`` (both in
    one unit). The i-th starts at the largest of ``at - gap * j`` over j up to i, plus ``gap * i``; so hosts with very many requests are shared by tasks.
    """
    placed = with_place(rows, by=[by], order=order, out="__i")
    late = running_max(placed, by=[by], order=["__i"], value=F.col(at) - F.lit(gap) * F.col("__i"), out=out)
    return late.withColumn(out, F.col(out) + F.lit(gap) * F.col("__i")).drop("__i")


# ---- next-fit ----------------------------------------------------------------------------------------------------------------------------

_WAYS = "exits array<int>, batches array<int>"


def _by_chunk(batches, use):
    """``use`` over the rows of each chunk, which follow each other."""
    now, held = None, []
    for b in batches:
        for row in b.to_pylist():
            key = (row["__by"], row["__chunk"])
            if held and key != now:
                yield from use(held)
                held = []
            now = key
            held.append(row)
    if held:
        yield from use(held)


def _ways(schema: pa.Schema, size: int, most: int, budget: int):
    """For each row of a chunk that may begin a batch: where in the next chunk the first batch begins that follows from it, and how many begin here. A row's
    pointer is to the beginning of the batch after its own, from sums of tokens; pointers are followed from the end."""

    def use(rows):
        own = sum(1 for r in rows if r["__i"] // size == r["__chunk"])
        total = np.concatenate([[0], np.cumsum([r["__t"] for r in rows])])
        at = np.arange(own)
        after = np.minimum(np.searchsorted(total, total[:own] + budget, side="right") - 1, at + most).tolist()
        exits, n = [0] * own, [0] * own
        for i in range(own - 1, -1, -1):
            to = after[i]
            exits[i], n[i] = (to - own, 1) if to >= own else (exits[to], n[to] + 1)
        first = min(most, own)
        yield pa.RecordBatch.from_pylist([{"__by": rows[0]["__by"], "__chunk": rows[0]["__chunk"], "exits": exits[:first], "batches": n[:first]}], schema=schema)

    return lambda batches: _by_chunk(batches, use)


def _entries(schema: pa.Schema):
    """Chunks of a group in order: the row where the first batch begins, and its number."""

    def run(batches):
        now, entry, base, any_ = None, 0, 0, False
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if not any_ or r["__by"] != now:
                    now, entry, base, any_ = r["__by"], 0, 0, True
                rows.append({"__by": now, "__chunk": r["__chunk"], "__entry": entry, "__base": base})
                entry, base = r["exits"][entry], base + r["batches"][entry]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _numbered(size: int, most: int, budget: int):
    def run(batches):
        now, batch, count, used = None, 0, 0, 0
        for b in batches:
            out = []
            for by, chunk, i, t, entry, base in zip(*(b.column(c).to_pylist() for c in ("__by", "__chunk", "__i", "__t", "__entry", "__base")), strict=True):
                if (by, chunk) != now:
                    now, batch, count, used = (by, chunk), base - 1, most, 0
                place = i - chunk * size
                if place == entry or (place > entry and (count >= most or used + t > budget)):
                    batch, count, used = batch + 1, 0, 0
                if place >= entry:
                    count, used = count + 1, used + t
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "batch"])

    return run


def next_fit(rows: DataFrame, *, by: str, order: str, tokens: str, max_count: int, budget: int, chunk: int | None = None) -> DataFrame:
    """``rows`` with ``batch``: next-fit batches within each ``by`` in ``order``; one closes at ``max_count`` rows or where the next would pass ``budget`` tokens.
    A row of more tokens counts as ``budget``, one without as none.

    Rows are numbered and cut into chunks. A batch has ``max_count`` rows at most, so the first that begins in a chunk begins at one of its first
    ``max_count`` rows: for each of these a chunk tells, by pointers, where the next chunk is entered. These few numbers are followed from chunk to
    chunk; then every chunk numbers its batches by itself. A task holds a chunk, however many rows a group has.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    size = max(4096, 4 * max_count) if chunk is None else max(chunk, max_count)
    placed = with_place(rows, by=[by], order=[order], out="__i")
    placed = checkpointed(placed.withColumns({"__by": F.struct(F.col(by).alias("all")), "__t": F.least(F.coalesce(F.col(tokens), F.lit(0)), F.lit(budget)).cast("long"), "__chunk": F.floor(F.col("__i") / size).cast("long")}))
    light = placed.select("__by", "__i", "__t", "__chunk")
    # A chunk sees how the next one begins.
    seen = light.union(light.where((F.col("__chunk") > 0) & (F.col("__i") % size < max_count)).withColumn("__chunk", F.col("__chunk") - 1))
    key = [placed.schema["__by"], placed.schema["__chunk"]]
    ways = StructType([*key, *StructType.fromDDL(_WAYS).fields])
    told = seen.repartition("__by", "__chunk").sortWithinPartitions("__by", "__chunk", "__i").mapInArrow(_ways(to_arrow_schema(ways), size, max_count, budget), ways)
    entries = StructType([*key, StructField("__entry", IntegerType()), StructField("__base", LongType())])
    entered = checkpointed(told.repartition("__by").sortWithinPartitions("__by", "__chunk").mapInArrow(_entries(to_arrow_schema(entries)), entries))
    # A broadcast or split join leaves a chunk's rows in several tasks, so they are brought together after it.
    met = placed.join(entered, ["__by", "__chunk"]).repartition("__by", "__chunk").sortWithinPartitions("__by", "__chunk", "__i")
    done = met.mapInArrow(_numbered(size, max_count, budget), StructType([*met.schema.fields, StructField("batch", LongType())]))
    return done.select(*rows.columns, "batch")
