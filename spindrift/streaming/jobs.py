"""Structured Streaming forms of usage counts, liveness and admission. Batch forms are in operators.state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.scratch import Scratch, setting

#: The state store that processors with timers and lists need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """Watermarks take timestamps with a zone only."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def daily_usage(events: DataFrame, ts: str, key: str, hours: int = 0, late: str = "2 days") -> DataFrame:
    """Uses by day (of a clock so many hours ahead) and key: tumbling windows over a watermark."""
    start = f"{(24 - hours) % 24} hours"
    w = F.window(ts, "1 day", "1 day", start)
    out = timed(events, ts, late).groupBy(w, F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("used"))
    return out.select(F.to_date(F.col("window.start") + F.expr(f"INTERVAL {hours} HOURS")).alias("day"), "key", "used")


def latest_beats(beats: DataFrame, by: list[str], at: str) -> DataFrame:
    return beats.groupBy(*by).agg(F.max(at).alias("at"))


def once_per_key(events: DataFrame, key: str, ts: str, within: str = "60 seconds") -> DataFrame:
    """The first event of a key within a time (an in-flight lock with takeover)."""
    return timed(events, ts, within).dropDuplicatesWithinWatermark([key])


def admitted(events: DataFrame, key: str, ts: str, id_col: str, limit: int, late: str = "1 day") -> DataFrame:
    """Each event with whether its key's uses of that day, in order of arrival and time, are within the limit."""
    schema = f"key string, {id_col} long, day date, nth long, admitted boolean"

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(frames).sort_values([ts, id_col])
        rows = rows.assign(nth=range(n + 1, n + 1 + len(rows)))
        state.update((n + len(rows),))
        yield pd.DataFrame({"key": k[0], id_col: rows[id_col], "day": k[1], "nth": rows["nth"], "admitted": rows["nth"] <= limit})

    rows = timed(events, ts, late).select(F.col(key).cast("string").alias("key"), F.to_date(ts).alias("day"), ts, id_col)
    return rows.groupBy("key", "day").applyInPandasWithState(run, schema, "n long", "append", GroupStateTimeout.NoTimeout)


def stall_alarms(beats: DataFrame, key: str, at: str, gap_ms: int = 60_000, late: str = "1 minute") -> DataFrame:
    """A row for each key whose last beat is more than gap_ms behind event time: an event-time timer in its state."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "last_ms": [last]})
            return
        last = max(int(f[at].max().timestamp() * 1000) for f in frames)
        if state.exists:
            last = max(last, state.get[0])
        state.update((last,))
        if last + gap_ms > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(last + gap_ms)
        else:
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "last_ms": [last]})

    rows = timed(beats, at, late).select(F.col(key).cast("string").alias("key"), at)
    return rows.groupBy("key").applyInPandasWithState(run, "key string, last_ms long", "last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


class LockQueue(StatefulProcessor):
    """A lock for each key: who asks while it is free gets it for hold_ms, others wait and take over in order, each when the one
    before has had its time. A timer in event time takes over for those who wait while nobody asks."""

    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")
        self.waiting = handle.getListState("waiting", "id long, asked_ms long")

    def _load(self) -> tuple[int | None, list[tuple[int, int]]]:
        waiting = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        return (self.until.get()[0] if self.until.exists() else None), waiting

    def _store(self, until: int | None, waiting: list) -> None:
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        if until is None:
            self.until.clear()
            return
        self.until.update((until,))
        self.handle.registerTimer(until)

    def _served(self, now: int, until: int | None, waiting: list, out: list) -> int | None:
        while until is not None and until <= now:
            if not waiting:
                return None
            ask, asked = waiting.pop(0)
            out.append((ask, asked, until))
            until += self.hold_ms
        return until

    def _rows(self, key, out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=["key", "id", "asked_ms", "granted_ms"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until, waiting = self._load()
        out: list = []
        asks = pd.concat(rows).sort_values(["at_ms", "id"])
        for ask, at in zip(asks["id"].tolist(), asks["at_ms"].tolist()):
            until = self._served(at, until, waiting, out)
            if until is None:
                out.append((ask, at, at))
                until = at + self.hold_ms
            else:
                waiting.append((ask, at))
        self._store(until, waiting)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, waiting = self._load()
        out: list = []
        until = self._served(timerValues.getCurrentWatermarkInMs(), until, waiting, out)
        self._store(until, waiting)
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


def lock_grants(events: DataFrame, key: str, id_col: str, ts: str, hold_ms: int = 60_000, late: str = "1 minute") -> DataFrame:
    """key, id, asked_ms, granted_ms of everyone who asked for a key's lock, once they have it; asks come in order of time."""
    rows = timed(events, ts, late)
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("long").alias("id"), F.unix_millis(ts).alias("at_ms"), ts)
    return rows.groupBy("key").transformWithStateInPandas(LockQueue(hold_ms), "key string, id long, asked_ms long, granted_ms long", "append", "EventTime")


class LatestBeat(StatefulProcessor):
    """The latest beat of each key, passed on where it is later than any before; a key that is silent for so long in event time
    is forgotten."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = max(int(f["at_ms"].max()) for f in rows)
        if not self.last.exists() or self.last.get()[0] < at:
            self.last.update((at,))
            self.handle.registerTimer(at + self.ttl_ms)
            yield pd.DataFrame({"key": [key[0]], "at_ms": [at]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[0] + self.ttl_ms <= timerValues.getCurrentWatermarkInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def beat_upserts(beats: DataFrame, key: str, at: str, ttl_ms: int = 7 * 86_400_000, late: str = "1 minute") -> DataFrame:
    """key, at_ms: upserts of the latest beats, a row for a key and batch at most."""
    rows = timed(beats, at, late).select(F.col(key).cast("string").alias("key"), F.unix_millis(at).alias("at_ms"), at)
    return rows.groupBy("key").transformWithStateInPandas(LatestBeat(ttl_ms), "key string, at_ms long", "update", "EventTime")


def run_available(stream: DataFrame, spark: SparkSession, mode: str = "complete", key: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Runs a stream over what is there and gives its result as a stored table: each batch's rows replace (complete) or join
    (append, update) those in the shared folder; of updates the last batch's row of each key counts. With the scratch folder of
    a run before, it goes on where that one ended."""
    scratch = scratch or Scratch(spark)
    path = scratch.path("stream")

    def store(rows: DataFrame, batch: int) -> None:
        to = path if mode == "complete" else f"{path}/batch={batch}"  # a batch that is written again replaces itself
        rows.write.mode("overwrite").parquet(to)

    with setting(spark, spark__sql__streaming__stateStore__providerClass=STORE):
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch.path("progress")).foreachBatch(store).trigger(availableNow=True).start()
        q.awaitTermination()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(path)
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(path)
    if mode == "update":
        rows = rows.groupBy(key).agg(*[F.max_by(c, "batch").alias(c) for c in stream.columns if c != key], F.max("batch").alias("batch"))
    return rows.select(*[c for c in rows.columns if c != "batch"])
