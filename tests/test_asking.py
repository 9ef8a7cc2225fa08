"""Asking as a stream: nothing twice, within a day's budget, going on after a stop, after failures, and when a day ends."""

import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import asking, stream


def logging(path, mended):
    """A tagger that writes down what it is asked; it fails at texts with ``bad`` until the file ``mended`` is there."""

    def tag(docs):
        if any("bad" in t for _, t in docs) and not os.path.exists(mended):
            raise RuntimeError("no answer")
        with open(path, "a") as f:
            f.writelines(f"{d} {len(t)}\n" for d, t in docs)
        return [(d, [t[:4]]) for d, t in docs if t != "left out"]

    return tag


@pytest.fixture
def work(spark, tmp_path):
    number = iter(range(100))

    def put(rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{next(number)}")

    def run(budget, buckets=2, batch=3, period=asking.DAY, calls=1000):
        docs = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in/*")
        stream.run_once(asking.ask(docs, logging(f"{tmp_path}/log", f"{tmp_path}/mended"), [asking.Limit(period, calls, budget), asking.Limit(2 * period, 2 * calls, 10 * budget)], buckets=buckets, batch=batch), f"{tmp_path}/out", f"{tmp_path}/ck")
        return spark.read.parquet(f"{tmp_path}/out")

    def asked():
        return [tuple(map(int, x.split())) for x in (tmp_path / "log").read_text().splitlines()] if (tmp_path / "log").exists() else []

    return put, run, asked


def test_nothing_is_asked_twice(work):
    put, run, asked = work
    put([(i, f"text {i}") for i in range(10)])
    run(10_000)
    put([(i, f"text {i}") for i in range(5, 15)])
    out = run(10_000)
    assert Counter(d for d, _ in asked()) == Counter(range(15))
    got = Counter((r.doc_id, r.state) for r in out.collect())
    assert got[("7", "tagged")] == 1 and got[("7", "cached")] == 1 and got[("14", "tagged")] == 1 and sum(got.values()) == 20


def test_the_budget_holds_and_the_rest_is_asked_later(work):
    put, run, asked = work
    put([(i, "x" * 40) for i in range(12)])  # ten tokens each
    run(80)
    assert 0 < len(asked()) <= 8
    first = len(asked())
    put([(100, "y" * 160)])
    run(80)  # stopped and started: the day's budget is used up
    assert sum(n for _, n in asked()) / 4 <= 80 and len(asked()) >= first and max(Counter(d for d, _ in asked()).values()) == 1


def test_waiting_documents_are_asked_when_the_period_ends(work):
    put, run, asked = work
    put([(i, "x" * 40) for i in range(8)])
    period = 4000
    for i in range(5):
        out = run(20, buckets=1, period=period)
        put([(100 + i, "")])
        time.sleep(period / 1000)
    assert {int(r.doc_id) for r in out.where("state = 'tagged'").collect()} >= set(range(8))
    assert max(Counter(d for d, _ in asked()).values()) == 1


def test_calls_are_limited(work):
    put, run, asked = work
    put([(i, "x") for i in range(12)])
    run(10_000, buckets=1, calls=2)
    assert len(asked()) == 6  # two calls of three


def test_failures_wait(work, tmp_path):
    put, run, asked = work
    put([(1, "good"), (2, "bad"), (3, "left out"), (4, None)])
    out = run(10_000, buckets=1, batch=1)
    assert {r.doc_id for r in out.where("state = 'tagged'").collect()} == {"1", "4"}
    (tmp_path / "mended").write_text("")
    put([(5, "more")])
    out = run(10_000, buckets=1, batch=1)
    got = {r.doc_id: r.labels for r in out.where("state = 'tagged'").collect()}
    assert got == {"1": ["good"], "2": ["bad"], "4": [""], "5": ["more"]} and Counter(d for d, _ in asked())[2] == 1
    assert out.select(F.sum("tokens")).first()[0] == 1 + 1 + 0 + 1
