"""Repair of conversations by weighted finite-state composition: the cheapest edits that give roles a legal order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._base import bounded_batches, written

#: Rows and bytes of a piece of a long conversation.
PIECE_ROWS, PIECE_BYTES = 4096, 4 << 20
_SPACE = " \t\n\x0b\x0c\r"
_BETWEEN = {"su", "ua", "au"}

# ---- machines ----------------------------------------------------------------------------------------------------------------------------

#: The role grammar (s?(ua)+)? as an acceptor of role initials: what each state reads, and where it goes.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ACCEPTS = (START, ASSISTANT)
#: Runs of inserts that the edit transducer allows: more of them pass a state of the grammar twice, which costs and gains nothing.
INSERTS = 2

Symbol = tuple[str, bool, bool]  # role initial, must go, truncated
Weight = tuple[int, str]  # cost and edits; smaller is better, and the best of two sums is a sum of bests


def edits(symbol: Symbol | None, inserted: int) -> Iterator[tuple[bool, int, str, str]]:
    """The edit transducer's arcs: (reads the row, cost, edit, role initial written). Without a symbol the input has ended."""
    if inserted < INSERTS:
        for role in "ua":
            yield False, 2, "I", role
    if symbol is None:
        return
    initial, must_go, truncated = symbol
    yield True, 3, "D", ""
    if not must_go:
        yield True, int(truncated), "K", initial
        for role in "ua":
            yield True, 2 + truncated, "R", role


def _best(into: dict, key, weight: Weight) -> None:
    if key not in into or weight < into[key]:
        into[key] = weight


@cache
def step(symbol: Symbol | None, state: int) -> dict[int, Weight]:
    """The best way over one row from a state of the grammar to each other: the edit transducer and the grammar composed from there on, state by state,
    in the order of the inserts. For the end of input: the best ways through inserts alone."""
    out: dict[int, Weight] = {}
    layer: dict[int, Weight] = {state: (0, "")}
    for inserted in range(INSERTS + 1):
        after: dict[int, Weight] = {}
        for q, (cost, said) in layer.items():
            if symbol is None:
                _best(out, q, (cost, said))
            for reads, more, edit, role in edits(symbol, inserted):
                to = q if role == "" and edit == "D" else GRAMMAR[q].get(role)
                if to is not None:
                    _best(out if reads else after, to, (cost + more, said + edit))
        layer = after
    return out


def shortest(symbols: list[Symbol], start: int = START) -> dict[int, Weight]:
    """The best weight of reaching each state of the grammar from ``start`` over all rows. Edits that read as many rows and end with one are never
    a beginning of one another, so sums keep the order of weights and pieces of a conversation can be summed by themselves."""
    best: dict[int, Weight] = {start: (0, "")}
    for x in symbols:
        after: dict[int, Weight] = {}
        for q, (cost, said) in best.items():
            for to, (more, edit) in step(x, q).items():
                _best(after, to, (cost + more, said + edit))
        best = after
    return best


def ended(best: dict[int, Weight]) -> Weight:
    """The best weight of a legal whole: what is still missing is inserted."""
    return min((cost + more, said + tail) for q, (cost, said) in best.items() for to, (more, tail) in step(None, q).items() if to in ACCEPTS)


def applied(said: str, rows: list[tuple[str, str]], state: int = START) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each row that the edits leave or insert."""
    at = iter(rows)
    for edit in said:
        role, text = next(at) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit in "RI":
            role = "assistant" if state == USER else "user"
        state = GRAMMAR[state][role[:1]]
        yield edit, role, text


# ---- rows --------------------------------------------------------------------------------------------------------------------------------


def _symbol(role: str, text: str, seen: bool) -> tuple[Symbol, str]:
    """What the machines read of a row, and its first fault."""
    inner = text.strip(_SPACE)
    fault = "blank" if not inner else "duplicate" if seen else "truncated" if inner[-1] not in ".!?" else ""
    return (role[:1], fault in ("blank", "duplicate"), fault == "truncated"), fault


class _Sums:
    """Counts of rows in order; pieces add up."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, role: str, turn: int | None, fault: str) -> None:
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.illegal += self.last is not None and self.last + role[:1] not in _BETWEEN
        self.first = role[:1] if self.first is None else self.first
        self.last = role[:1]
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def join(self, x: _Sums) -> None:
        """``x`` comes after."""
        for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, k, getattr(self, k) + getattr(x, k))
        self.illegal += self.last is not None and x.first is not None and self.last + x.first not in _BETWEEN
        self.turns -= self.high is not None and self.high == x.low
        self.first, self.last = self.first if self.first is not None else x.first, x.last if x.last is not None else self.last
        self.low, self.high = self.low if self.low is not None else x.low, x.high if x.high is not None else self.high

    def report(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_DONE = f"{', '.join(f'{c} long' for c in _REPORT)}, audit string, repaired_sha256 string"
_HELD = "run int, piece int, held array<struct<turn: long, role: string, text: string, seen: boolean, mark: binary>>"


def _typed(kind: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", kind), *T._parse_datatype_string(rest).fields])


def _batch(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _scan(out: pa.Schema, piece_rows: int, piece_bytes: int):
    """Rows in order. A conversation that begins and ends within the task, and is no longer than a piece, is repaired here; of others, pieces go on."""

    def run(batches):
        task = TaskContext.get().partitionId()
        now, held, size, seen, piece, opened, any_ = None, [], 0, set(), 0, True, False

        def part():
            nonlocal held, size, piece
            row = {"conv_id": now, "run": task, "piece": piece, "held": held}
            held, size, piece = [], 0, piece + 1
            return row

        def whole():
            sums, symbols = _Sums(), []
            for r in held:
                symbol, fault = _symbol(r["role"], r["text"], r["seen"])
                symbols.append(symbol)
                sums.add(r["role"], r["turn"], fault)
            cost, said = ended(shortest(symbols))
            lines = "\n".join(f"{role}:{text}" for _, role, text in applied(said, [(r["role"], r["text"]) for r in held]))
            sha = hashlib.sha256(lines.encode("utf-8", "surrogatepass")).hexdigest()
            return {"conv_id": now, **dict(zip(_REPORT, [*sums.report(), cost], strict=True)), "audit": said, "repaired_sha256": sha}

        for b in batches:
            rows = []
            for conv, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if any_ and conv != now:
                    rows.append(part() if opened or piece else whole())
                    held, size, seen, piece, opened = [], 0, set(), 0, False
                now, any_ = conv, True
                if held and (len(held) >= piece_rows or size >= piece_bytes):
                    rows.append(part())
                mark = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"))
                held.append({"turn": turn, "role": role, "text": text, "seen": mark in seen, "mark": mark})
                seen.add(mark)
                size += len(text)
            yield _batch(out, rows)
        if any_:
            yield _batch(out, [part()])

    return run


def _sum_up(out: pa.Schema):
    """The best weights between all states over a piece, with the order of the edits from each state, and its counts."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                sums, symbols, later = _Sums(), [], set(r["later"] or ())
                for x in r["held"]:
                    symbol, fault = _symbol(x["role"], x["text"], x["seen"] or x["mark"] in later)
                    symbols.append(symbol)
                    sums.add(x["role"], x["turn"], fault)
                ways = []
                for q in GRAMMAR:
                    best = shortest(symbols, q)
                    order = sorted(said for _, said in best.values())
                    ways += [{"start": q, "end": to, "cost": cost, "place": order.index(said), "edits": said} for to, (cost, said) in best.items()]
                rows.append({"conv_id": r["conv_id"], "run": r["run"], "piece": r["piece"], "ways": ways, "rows": [{"role": x["role"], "text": x["text"]} for x in r["held"]], **vars(sums)})
            yield _batch(out, rows)

    return run


def _groups(batches, *keys: str):
    now, held, any_ = None, [], False
    for b in batches:
        for r in b.to_pylist():
            key = tuple(r[k] for k in keys)
            if any_ and key != now:
                yield now, held
                held = []
            now, any_ = key, True
            held.append(r)
    if any_:
        yield now, held


def _choose(out: pa.Schema):
    """The way over each piece of a conversation, from its pieces' costs and orders alone; the sums of the whole stand in its last piece's row."""

    def run(batches):
        for (conv,), pieces in _groups(batches, "conv_id"):
            best, back, sums = {START: (0, 0)}, [], _Sums()
            for p in pieces:
                x = _Sums()
                vars(x).update({k: p[k] for k in vars(x)})
                sums.join(x)
                # A way's edits are ordered by the order of those before the piece, then by the order within it.
                after, told = {}, {}
                for w in p["ways"]:
                    if (had := best.get(w["start"])) is not None:
                        weight = (had[0] + w["cost"], had[1], w["place"])
                        if w["end"] not in after or weight < after[w["end"]]:
                            after[w["end"]], told[w["end"]] = weight, w["start"]
                order = sorted(x[1:] for x in after.values())
                best = {q: (x[0], order.index(x[1:])) for q, x in after.items()}
                back.append(told)
            cost, _, tail, q = min((c + more, place, said, q) for q, (c, place) in best.items() for to, (more, said) in step(None, q).items() if to in ACCEPTS)
            rows = []
            for i in range(len(pieces) - 1, -1, -1):
                start = back[i][q]
                rows.append({"conv_id": conv, "run": pieces[i]["run"], "piece": pieces[i]["piece"], "start": start, "end": q})
                if i == len(pieces) - 1:
                    rows[-1] |= {"tail": tail, **dict(zip(_REPORT, [*sums.report(), cost], strict=True))}
                q = start
            yield _batch(out, rows)

    return run


def _lines(batches):
    """A piece's edits, and what they leave as text."""
    for b in batches:
        said, left = [], []
        for r in b.to_pylist():
            way = next(w["edits"] for w in r["ways"] if w["start"] == r["start"] and w["end"] == r["end"])
            said.append(way)
            state = r["start"]
            lines = [f"{role}:{text}" for _, role, text in applied(way, [(x["role"], x["text"]) for x in r["rows"]], state)]
            state = r["end"]
            for _ in r["tail"] or "":
                lines.append("assistant:" if state == USER else "user:")
                state = ASSISTANT if state == USER else USER
            left.append("\n".join(lines).encode("utf-8", "surrogatepass") if lines else None)
        names = ["conv_id", "run", "piece", "tail", *_REPORT]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(said, pa.string()), pa.array(left, pa.binary())], [*names, "edits", "left"])


def _hashed(out: pa.Schema):
    """The digest of a conversation's text, piece by piece: no more than one piece is held, besides the edits that the report shows."""

    def run(batches):
        any_, now, said, sha, some = False, None, [], hashlib.sha256(), False
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if not any_ or r["conv_id"] != now:
                    any_, now, said, sha, some = True, r["conv_id"], [], hashlib.sha256(), False
                said.append(r["edits"])
                if r["left"] is not None:
                    sha.update((b"\n" if some else b"") + r["left"])
                    some = True
                if r["cost"] is not None:  # the last piece
                    rows.append({"conv_id": now, **{c: r[c] for c in _REPORT}, "audit": "".join(said) + r["tail"], "repaired_sha256": sha.hexdigest()})
            yield _batch(out, rows)

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


_FAULTS = "blank long, duplicate long, truncated long, illegal long, turns long, first string, last string, low long, high long"


def repair(rows: DataFrame, *, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """A row per conversation of ``rows`` (conv_id, turn, role, text): gaps between its turns, rows that are blank, repeat an earlier one or end without
    ``.!?`` (the first of these counts), neighbours whose roles may not follow each other, and the cheapest repair: its cost, its edits in
    order (Keep, Rerole, Delete, Insert; of equal costs the ASCII-least) and the digest of its ``role:text`` lines.

    Rows are in the order of turns, nulls first; rows of one turn in the order of roles, then of their texts' hashes. Null roles and texts are one
    space. Rows without conv_id are one conversation. Repeated rows are duplicates. Other columns are not looked at. An empty table gives no rows.

    Rows are sorted by range, so a long conversation lies in several tasks; its pieces are summed up as weights between the grammar's states, and
    only these meet. Its text and edits are streamed once for the digest.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    flat = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    kind = flat.schema["conv_id"].dataType
    # The last key only parts equal rows, which may be in any order.
    order = ["conv_id", "turn", "role", "th", "tie"]
    flat = flat.withColumn("th", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    ranged = flat.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = _typed(kind, f"{_DONE}, {_HELD}")
    scanned = written(ranged.select("conv_id", "turn", "role", "text").mapInArrow(_scan(_arrow(schema), piece_rows, piece_bytes), schema), "repairs")
    done = scanned.where("held is null").select("conv_id", *[f.name for f in T._parse_datatype_string(_DONE).fields])
    parts = scanned.where("held is not null").select("conv_id", "run", "piece", "held")

    # Rows of a piece that an earlier task has; within a task they are marked.
    at = F.struct("conv_id", "run", "piece").alias("at")  # structs are equal where both have a null
    marks = parts.select(at, F.explode("held").alias("x")).where("not x.seen").select("at", F.struct("at.conv_id", "x.mark").alias("mark"))
    least = marks.groupBy("mark").agg(F.min("at.run").alias("first_run"), F.max("at.run").alias("last_run")).where("first_run < last_run")
    later = marks.join(least, "mark").where("at.run > first_run").groupBy("at").agg(F.collect_set("mark.mark").alias("later"))
    told = parts.select(at, "held").join(later, "at", "left").select("at.*", "held", "later")

    schema = _typed(kind, f"run int, piece int, ways array<struct<start: int, end: int, cost: int, place: int, edits: string>>, rows array<struct<role: string, text: string>>, {_FAULTS}")
    summed = written(told.mapInArrow(_sum_up(_arrow(schema)), schema), "repair-pieces")
    light = summed.withColumn("ways", F.transform("ways", lambda w: w.dropFields("edits"))).drop("rows")
    schema = _typed(kind, f"run int, piece int, start int, end int, tail string, {', '.join(f'{c} long' for c in _REPORT)}")
    way = light.repartition("conv_id").sortWithinPartitions("conv_id", "run", "piece").mapInArrow(_choose(_arrow(schema)), schema)
    way = written(way, "repair-ways")
    chosen = summed.select(at, "ways", "rows").join(way.select(at, "start", "end", "tail", *_REPORT), "at").select("at.*", "ways", "rows", "start", "end", "tail", *_REPORT)
    schema = _typed(kind, f"run int, piece int, tail string, {', '.join(f'{c} long' for c in _REPORT)}, edits string, left binary")
    lines = chosen.mapInArrow(_lines, schema)
    schema = _typed(kind, _DONE)
    long = lines.repartition("conv_id").sortWithinPartitions("conv_id", "run", "piece").mapInArrow(_hashed(_arrow(schema)), schema)
    return done.unionByName(long)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with known faults, to test repairs: by crc32(``conv_id:turn``) % 20 a row goes (0), loses its text (1) or its full stops (2), comes twice
    (3) or becomes the user's (4)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text: Column = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(fault == 4, "user").otherwise(blank("role"))
    times = F.explode(F.when(fault == 0, F.array().cast("array<int>")).when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("copy")
