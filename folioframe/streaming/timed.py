"""Stateful streams with timers: exact rolling limits in event time, and calls put together from their deltas.

Both keep, for each key, only what can still matter, and a timer ends what waits too long. They need a state store with
timers, which use_timers() sets for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timers(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _milliseconds(seconds: float) -> int:
    return int(round(seconds * 1000))


class _Limit(StatefulProcessor):
    """Requests wait until the watermark has passed them, so that they are decided in order of time however they came."""

    def __init__(self, seconds: int, limit: int):
        self.seconds, self.limit = seconds, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts double, id long, tokens long")
        self.held = handle.getListState("held", "ts double, tokens long")

    def _wake(self, at: float) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(_milliseconds(at))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting = [tuple(x) for x in self.waiting.get()]
        for part in rows:
            waiting += [(float(r.ts), int(r.id), int(r.tokens)) for r in part.itertuples()]
        self.waiting.put(waiting)
        self._wake(min(t for t, _, _ in waiting))
        yield pd.DataFrame({"key": pd.Series([], dtype=object), "id": pd.Series([], dtype="int64"), "ts": pd.Series([], dtype="float64"), "tokens": pd.Series([], dtype="int64"), "allowed": pd.Series([], dtype=bool)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        waiting, held, out = sorted(tuple(x) for x in self.waiting.get()), [tuple(x) for x in self.held.get()], []
        due = [x for x in waiting if x[0] <= now]
        used, first = sum(n for _, n in held), 0
        for ts, number, tokens in due:
            while first < len(held) and held[first][0] < ts - self.seconds:
                used -= held[first][1]
                first += 1
            allowed = self.limit == 0 or used + tokens <= self.limit
            if allowed:
                held.append((ts, tokens))
                used += tokens
            out.append((key[0], number, ts, tokens, allowed))
        rest = waiting[len(due):]
        held = [x for x in held[first:] if x[0] >= min(now, rest[0][0] if rest else now) - self.seconds]
        for state, left in ((self.waiting, rest), (self.held, held)):
            if left:
                state.put(left)
            else:
                state.clear()
        if rest:
            self._wake(rest[0][0])
        elif held:  # to forget the key when nothing of it counts any more
            self._wake(held[-1][0] + self.seconds + 0.001)
        yield pd.DataFrame(out, columns=["key", "id", "ts", "tokens", "allowed"])

    def close(self) -> None:
        pass


def rolling_limit(log: DataFrame, seconds: int, limit: int, late: str = "0 seconds", by: str = "mode", time: str = "ts") -> DataFrame:
    """(by, id, ts, tokens, allowed): each request of log(by, id, ts, tokens), in order of event time, against the tokens that
    allowed requests used in the seconds before; a limit of 0 allows all. Output mode append.

    A request is decided when the watermark, `late` behind the newest row, has passed it; rows that come later still are
    dropped. The state of a key is the requests that wait and the allowed ones that still count; a timer drops the key
    when neither is left.

    Defined cases: ts is a timestamp; requests of one time go by id; null keys are a key; null tokens count as 0."""
    use_timers(log.sparkSession)
    kind = dict(log.dtypes)[by]
    rows = log.withWatermark(time, late).select(F.col(by).alias("key"), F.col(time).alias("at"), F.col("id").cast("long").alias("id"),
                                               (F.unix_micros(time) / 1e6).alias("ts"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
    found = rows.groupBy("key").transformWithStateInPandas(_Limit(seconds, limit), f"key {kind}, id long, ts double, tokens long, allowed boolean", "Append", "EventTime")
    return found.withColumnRenamed("key", by)


class _Calls(StatefulProcessor):
    """The deltas of a call until all up to its last one are there."""

    def __init__(self, patience: float):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deltas = handle.getMapState("deltas", "seq long", "delta string")
        self.last = handle.getValueState("last", "seq long")

    def _told(self, key, complete: bool) -> pd.DataFrame:
        found = sorted((k[0], v[0]) for k, v in self.deltas.iterator())
        self.deltas.clear()
        self.last.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        return pd.DataFrame({"key": pd.Series([key[0]], dtype=object), "text": ["".join(d or "" for _, d in found)], "n": [len(found)], "complete": [complete]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = 0.0
        for part in rows:
            for r in part.itertuples():
                self.deltas.updateValue((int(r.seq),), (r.delta,))
                newest = max(newest, float(r.ts))
                if r.last:
                    self.last.update((int(r.seq),))
        last = self.last.get() if self.last.exists() else None
        if last is not None and sum(1 for _ in self.deltas.keys()) == last[0] + 1:
            yield self._told(key, True)
        else:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(_milliseconds(newest + self.patience))
            yield pd.DataFrame({"key": pd.Series([], dtype=object), "text": pd.Series([], dtype=object), "n": pd.Series([], dtype="int64"), "complete": pd.Series([], dtype=bool)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._told(key, False)

    def close(self) -> None:
        pass


def joined_calls(events: DataFrame, patience: float = 600, late: str = "0 seconds", by: str = "call_id", time: str = "ts") -> DataFrame:
    """(by, text, n, complete): each call of events(by, seq, delta, last, ts) once, its deltas in order of seq, when its last
    one and all before it from 0 are there; then its state is dropped. A call for which nothing comes for `patience`
    seconds of event time is given up and told as it is, not complete. Output mode append.

    Defined cases: a repeated seq counts once, as it came last; null deltas are empty; what comes after a call was told
    begins it anew."""
    use_timers(events.sparkSession)
    kind = dict(events.dtypes)[by]
    rows = events.withWatermark(time, late).select(F.col(by).alias("key"), F.col(time).alias("at"), F.col("seq").cast("long").alias("seq"), "delta",
                                                  F.coalesce("last", F.lit(False)).alias("last"), (F.unix_micros(time) / 1e6).alias("ts"))
    found = rows.groupBy("key").transformWithStateInPandas(_Calls(patience), f"key {kind}, text string, n long, complete boolean", "Append", "EventTime")
    return found.withColumnRenamed("key", by)
