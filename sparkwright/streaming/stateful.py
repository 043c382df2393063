"""Custom state with transformWithState: typed list and map state, timers by event time, and expiry by time to live."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..registry import query
from .events import drained, timed

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark) -> Iterator[None]:
    """The state store that transformWithState asks for, for the streams that start inside; the session's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


#: Milliseconds without an event that end a session.
GAP_MS = 12 * 3_600_000


class Sessions(StatefulProcessor):
    """A user's open sessions as a list of (first, last, n) in milliseconds, merged as events come in any order; each is given out once, when the watermark has passed its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first bigint, last bigint, n bigint")

    def _keep(self, parts: list[tuple[int, int, int]]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if parts:
            self.open.put(parts)
            self.handle.registerTimer(min(last for _, last, _ in parts) + GAP_MS)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [tuple(p) for p in self.open.get()] if self.open.exists() else []
        for r in rows:
            parts += [(int(t), int(t), 1) for t in r["ms"]]
        merged: list[tuple[int, int, int]] = []
        for first, last, n in sorted(parts):
            if merged and first - merged[-1][1] < GAP_MS:
                a, b, m = merged[-1]
                merged[-1] = (a, max(b, last), m + n)
            else:
                merged.append((first, last, n))
        self._keep(merged)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        parts = [tuple(p) for p in self.open.get()] if self.open.exists() else []
        done = [p for p in parts if p[1] + GAP_MS <= now]
        self._keep([p for p in parts if p[1] + GAP_MS > now])
        if done:
            yield pd.DataFrame({"user_id": [key[0]] * len(done), "first_ms": [p[0] for p in done], "n": [p[2] for p in done]})

    def close(self) -> None:
        pass


@query("st_state_timers", f"""WITH a AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_id, coalesce(epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w >= {GAP_MS}, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT user_id, ms, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS no FROM a)
 SELECT user_id, min(ms)::BIGINT AS first_ms, count(*)::BIGINT AS n FROM s GROUP BY user_id, no HAVING max(ms) + {GAP_MS} <= (SELECT max(epoch_us(ts) // 1000) - 3600000 FROM events)""")
def st_state_timers(spark, d) -> DataFrame:
    """Sessions that have ended by the watermark, from list state and timers; those still open stay in the state."""
    s = timed(spark, d).select("user_id", "ts", F.unix_millis("ts").alias("ms"))
    with rocksdb(spark):
        ended = s.groupBy("user_id").transformWithStateInPandas(Sessions(), "user_id bigint, first_ms bigint, n bigint", "append", "eventTime")
        return drained(ended, "sessions")


class SeenOf(StatefulProcessor):
    """What a key has brought lately: a map from item to its count, whose entries go ttl_ms after they were last written."""

    def __init__(self, item: str, ttl_ms: int):
        self.item, self.ttl_ms = item, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "item string", "n bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for r in rows:
            fresh = []
            for item, n in r[self.item].value_counts().items():
                old = self.seen.getValue((item,))[0] if self.seen.containsKey((item,)) else 0
                self.seen.updateValue((item,), (old + int(n),))
                if not old:
                    fresh.append(item)
            if fresh:
                yield pd.DataFrame({"key": [str(key[0])] * len(fresh), "item": sorted(fresh)})

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, key: str, item: str, ttl_ms: int) -> DataFrame:
    """(key, item) when a key brings an item (a string, not null) that it has not brought for ttl_ms of processing time. The state is bounded by what comes in that time; start it under rocksdb()."""
    rows = stream.select(F.col(key).alias("key"), F.col(item).alias("item"))
    return rows.groupBy("key").transformWithStateInPandas(SeenOf("item", ttl_ms), "key string, item string", "append", "processingTime")
