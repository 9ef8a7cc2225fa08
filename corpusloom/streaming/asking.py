"""A stream of documents through a tagger that costs tokens: verdicts are kept as state, a day's budget is never passed, and what must wait is asked later."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.functions import text as T

OUT = "doc_id string, labels array<string>, state string, tokens long"
MINUTE, DAY = 60_000, 86_400_000


class Limit(NamedTuple):
    """So many calls and tokens in a period (milliseconds)."""

    period: int
    calls: int
    tokens: int



Tagger = Callable[[list[tuple[str, str]]], Iterable[tuple[str, list[str]]]]


class Asking(StatefulProcessor):
    """Per bucket of documents: verdicts by document, calls and tokens of each period, documents that wait.

    A micro-batch's state and output are committed together, so a job that is stopped between batches asks nothing twice. A call that fails leaves
    its documents waiting. Waiting documents are asked when the next rows come, or by a timer when a period ends.
    """

    def __init__(self, tagger: Tagger, *, limits: list[Limit], batch: int):
        self.tagger, self.limits, self.batch = tagger, limits, batch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "doc_id string", "labels string")
        self.used = handle.getMapState("used", "period long", "slot long, calls long, tokens long")
        self.waiting = handle.getMapState("waiting", "doc_id string", "text string, tokens long")

    def _spent(self, period: int, now: int) -> tuple[int, int]:
        slot, calls, tokens = self.used.getValue((period,)) if self.used.containsKey((period,)) else (None, 0, 0)
        return (calls, tokens) if slot == now // period else (0, 0)

    def _full(self, now: int, tokens: int) -> list[int]:
        """Periods that have no room for one more call with so many tokens."""
        return [x.period for x in self.limits for calls, spent in [self._spent(x.period, now)] if calls + 1 > x.calls or spent + tokens > x.tokens]

    def _ask(self, now: int) -> Iterator[tuple]:
        """Asks what waits, in order of ids, while no limit is passed."""
        todo = sorted((k[0], v[0], v[1]) for k, v in self.waiting.iterator())
        batch, tokens, full = [], 0, []

        def call():
            nonlocal batch, tokens
            try:
                got = dict(self.tagger([(doc, text) for doc, text, _ in batch]))
            except Exception:  # the tagger's own failure: what it was given waits on, and has cost nothing
                got = None
            for doc, _, n in batch if got is not None else ():
                labels = got.get(doc)
                if labels is None:
                    continue  # left out of the answer: asked again
                self.known.updateValue((doc,), (json.dumps(list(labels)),))
                self.waiting.removeKey((doc,))
                yield doc, list(labels), "tagged", n
            if got is not None:
                for x in self.limits:
                    calls, spent = self._spent(x.period, now)
                    self.used.updateValue((x.period,), (now // x.period, calls + 1, spent + tokens))
            batch, tokens = [], 0

        for row in todo:
            if full := self._full(now, tokens + row[2]):
                break
            batch.append(row)
            tokens += row[2]
            if len(batch) == self.batch:
                yield from call()
        if batch:
            yield from call()
        if next(iter(self.waiting.iterator()), None) is not None:
            period = max(full or [x.period for x in self.limits])
            self.handle.registerTimer((now // period + 1) * period)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc_id", "labels", "state", "tokens"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, now = [], None
        for frame in rows:
            for doc, text, tokens, at in zip(frame["doc_id"], frame["text"], frame["tokens"], frame["now"], strict=True):
                now = int(at) if now is None else max(now, int(at))
                if self.known.containsKey((doc,)):
                    out.append((doc, json.loads(self.known.getValue((doc,))[0]), "cached", 0))
                else:
                    self.waiting.updateValue((doc,), (text, int(tokens)))
        if now is not None:
            out += self._ask(now)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(list(self._ask(timerValues.getCurrentWatermarkInMs())))

    def close(self) -> None:
        pass


def ask(docs: DataFrame, tagger: Tagger, limits: list[Limit], *, batch: int = 20, buckets: int = 16) -> DataFrame:
    """(doc_id, labels, state, tokens) of a stream (doc_id, text): documents that were tagged before are ``cached``, the others ``tagged`` once, as far as
    their bucket's share of each limit lasts. A document that alone is over that share waits for ever. Rows without doc_id are left out. Buckets
    share the work: no task keeps all state, and their shares are the limits at most. Time is that of the micro-batch, which a batch that is run
    again keeps; no row is late.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    text, doc = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    rows = docs.where(doc.isNotNull()).select(F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int").alias("bucket"), doc.alias("doc_id"), text.alias("text"), T.estimate_tokens(text).cast("long").alias("tokens"), F.current_timestamp().alias("ts"))
    rows = rows.withWatermark("ts", "0 seconds").withColumn("now", F.unix_millis("ts"))
    asking = Asking(tagger, limits=[Limit(x.period, x.calls // buckets, x.tokens // buckets) for x in limits], batch=batch)
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=asking, outputStructType=OUT, outputMode="Append", timeMode="EventTime")
