"""Scans over sorted runs against plain loops: groups that span tasks, nulls, ties, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = [("hot", i, rng.choice([None, None, None, f"h{i}"]), rng.choice([0, 1, 5, 9, 40, None]), "__x") for i in range(3000)]
    out += [(f"g{i % 7}", i, rng.choice([None, f"v{i}"]), rng.choice([1, 2, 30, 99]), "__x") for i in range(60)] + [(None, i, None if i < 3 else "n", 2, "__x") for i in range(9)]
    return spark.createDataFrame(out, "g string, pos long, v string, t long, n string").repartition(9)


def groups(rows):
    by = {}
    for r in sorted(rows.collect(), key=lambda r: r.pos):
        by.setdefault(r.g, []).append(r)
    return by


def test_places(rows):
    want = {(g, r.pos): i for g, own in groups(rows).items() for i, r in enumerate(own)}
    got = ordered.with_place(rows, by=["g"], order=["pos"], out="i")
    assert {(r.g, r.pos): r.i for r in got.collect()} == want and got.columns == [*rows.columns, "i"]
    assert {(r.g, r.pos): r.i for r in ordered.with_place(rows, by=["g", "n"], order=["pos"], out="i").collect()} == want
    assert ordered.with_place(rows.where("false"), by=["g"], order=["pos"], out="i").count() == 0


def test_carried(rows):
    want = {}
    for g, own in groups(rows).items():
        v = t = None
        for r in own:
            v, t = r.v if r.v is not None else v, r.t if r.t is not None and r.t > 5 else t
            want[(g, r.pos)] = (v, t)
    got = ordered.carried(rows, {"last": F.col("v"), "big": F.when(F.col("t") > 5, F.col("t"))}, by=["g"], order=["pos"])
    assert {(r.g, r.pos): (r["last"], r.big) for r in got.collect()} == want
    assert "Window" not in str(ordered.carried(rows, {"last": F.col("v")}, by=[], order=["pos", "g"])._jdf.queryExecution().executedPlan()).split("BroadcastExchange")[0]
    one = {r.pos: r["last"] for r in ordered.carried(rows.where("g = 'hot'"), {"last": F.col("v")}, by=[], order=["pos"]).collect()}
    assert one == {p: v for (g, p), (v, _) in want.items() if g == "hot"}
    assert ordered.carried(rows.where("false"), {"last": F.col("v")}, by=["g"], order=["pos"]).count() == 0


@pytest.mark.parametrize(("most", "budget", "chunk"), [(12, 60, None), (12, 60, 12), (3, 1000, 3), (1, 50, 5), (50, 100, 64), (10_000, 10**9, 1)])
def test_next_fit(rows, most, budget, chunk):
    want = {}
    for g, own in groups(rows).items():
        batch, count, used = -1, most, 0
        for r in own:
            t = min(r.t or 0, budget)
            if count >= most or used + t > budget:
                batch, count, used = batch + 1, 0, 0
            count, used = count + 1, used + t
            want[(g, r.pos)] = batch
    got = ordered.next_fit(rows, by="g", order="pos", tokens="t", max_count=most, budget=budget, chunk=chunk)
    assert {(r.g, r.pos): r.batch for r in got.collect()} == want and got.columns == [*rows.columns, "batch"]


def test_next_fit_of_nothing(rows):
    assert ordered.next_fit(rows.where("false"), by="g", order="pos", tokens="t", max_count=2, budget=9).count() == 0


def test_paced(rows):
    want = {}
    for g, own in groups(rows).items():
        last = None
        for r in own:
            at = r.pos // 10
            last = at if last is None else max(at, last + 7)
            want[(g, r.pos)] = last
    got = ordered.paced(rows.withColumn("at", F.floor(F.col("pos") / 10)), by="g", order=["pos"], at="at", gap=7)
    assert {(r.g, r.pos): r.starts for r in got.collect()} == want
    far = ordered.paced(rows.withColumn("at", F.col("pos") * 100), by="g", order=["pos"], at="at", gap=7)
    assert all(r.starts == r["at"] for r in far.collect())
