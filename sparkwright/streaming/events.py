"""Streams over the table of events: windows, late data, deduplication, joins and custom state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..registry import query
from ..sources.shared import fresh_path
from ..sources.tables import stream, table


def drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for the input there is now, through a Parquet sink with its own checkpoint in the shared folder."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, f"stream-{name}")
    run = df.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/rows").option(
        "checkpointLocation", f"{path}/checkpoint",
    ).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


def timed(spark, d) -> DataFrame:
    """The events as a stream with an event time, which watermarks want as timestamp."""
    return stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


@query("scan_stream", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def scan_stream(spark, d) -> DataFrame:
    return drained(stream(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id"), "scan")


@query(
    "st_tumbling",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n, round(sum(value::DECIMAL(18,6))::DOUBLE, 3) AS total FROM events GROUP BY ALL",
)
def st_tumbling(spark, d) -> DataFrame:
    """The batch form: the same expression serves both."""
    g = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return g.agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,6)")).cast("double"), 3).alias("total"),
    ).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query(
    "st_sliding",
    """SELECT (time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * i)::TIMESTAMP AS start, count(*)::BIGINT AS n FROM (SELECT ts, unnest([0, 1, 2, 3]) AS i FROM events) GROUP BY ALL""",
)
def st_sliding(spark, d) -> DataFrame:
    g = table(
        spark, d, "events",
    ).groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "n")


@query("st_session", """WITH a AS (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER w >= INTERVAL 12 HOUR, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a) SELECT user_id, min(ts)::TIMESTAMP AS start, count(*)::BIGINT AS n FROM b GROUP BY user_id, s""")
def st_session(spark, d) -> DataFrame:
    g = table(spark, d, "events").groupBy(
        "user_id", F.session_window("ts", "12 hours").alias("w"),
    ).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


@query("st_watermark", """SELECT start, n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS start, count(*)::BIGINT AS n FROM events GROUP BY 1)
 WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def st_watermark(spark, d) -> DataFrame:
    """Days that the watermark has closed; the last one stays open."""
    g = timed(spark, d).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return drained(
        g.select(F.col("w.start").alias("start"), "n"), "watermark",
    ).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("st_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def st_dedup(spark, d) -> DataFrame:
    """Each pair once, by state over the whole stream."""
    return drained(
        stream(spark, d, "events").dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type"), "dedup",
    )


@query("st_join", """SELECT a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR
 WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def st_join(spark, d) -> DataFrame:
    """Clicks and the user's purchases within two hours: two streams, each with a watermark, so state is dropped."""
    a = timed(spark, d).where("event_type = 'click'").select(
        F.col("event_id").alias("click_id"), F.col("user_id").alias("u"), F.col("ts").alias("clicked"),
    )
    b = timed(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", "ts")
    j = a.join(b, F.expr("u = user_id AND ts >= clicked AND ts <= clicked + INTERVAL 2 HOURS"))
    return drained(j.select("click_id", "purchase_id"), "join")


CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(
    "st_tumbling_stream",
    f"""SELECT start, event_type, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL) WHERE start + INTERVAL 1 HOUR <= {CLOSED}""",
)
def st_tumbling_stream(spark, d) -> DataFrame:
    """The hours that the watermark has closed, as a stream appends them."""
    g = timed(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return drained(
        g.select(F.col("w.start").alias("start"), "event_type", "n"), "tumbling",
    ).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("st_sliding_stream", f"""SELECT start, n FROM (SELECT (time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * i)::TIMESTAMP AS start, count(*)::BIGINT AS n FROM (SELECT ts, unnest([0, 1, 2, 3]) AS i FROM events) GROUP BY ALL)
 WHERE start + INTERVAL 1 HOUR <= {CLOSED}""")
def st_sliding_stream(spark, d) -> DataFrame:
    g = timed(spark, d).groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n"))
    return drained(
        g.select(F.col("w.start").alias("start"), "n"), "sliding",
    ).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("st_session_stream", f"""WITH a AS (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER w >= INTERVAL 12 HOUR, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a)
 SELECT user_id, min(ts)::TIMESTAMP AS start, count(*)::BIGINT AS n FROM b GROUP BY user_id, s HAVING max(ts) + INTERVAL 12 HOUR <= {CLOSED}""")
def st_session_stream(spark, d) -> DataFrame:
    g = timed(spark, d).groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return drained(
        g.select("user_id", F.col("w.start").alias("start"), "n"), "session",
    ).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("st_dedup_watermark", "SELECT event_id, user_id FROM events")
def st_dedup_watermark(spark, d) -> DataFrame:
    """A stream that delivers every event twice, each kept once: ids are forgotten when the watermark has passed them, so the state is bounded by the delay."""
    twice = timed(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return drained(twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id"), "dedup-watermark")


#: How long the state of a user who sends nothing is kept, in milliseconds of event time.
IDLE_MS = 60 * 86_400_000


def running(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Events and the largest gap in seconds of a user so far; the state is three numbers, whatever the user's rows, and goes when the user is long idle."""
    if state.hasTimedOut:
        state.remove()
        return
    n, last, gap = state.get if state.exists else (0, 0, 0)
    for b in batches:
        t = b["us"].sort_values().to_numpy()
        if len(t):
            steps = [int(x) for x in t[1:] - t[:-1]] + ([int(t[0]) - last] if n else [])
            gap = max([gap, *steps])
            last = max(last, int(t[-1])) if n else int(t[-1])
            n += len(t)
    state.update((n, last, gap))
    state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + IDLE_MS)
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "gap": [gap // 1_000_000]})


@query("st_stateful")
def st_stateful(spark, d) -> DataFrame:
    """Custom state by applyInPandasWithState: the last word on each user. No SQL; tests/ hold it against a batch version."""
    s = timed(spark, d).select("user_id", "ts", F.unix_micros("ts").alias("us"))
    kind = "user_id bigint, n bigint, gap bigint"
    out = s.groupBy("user_id").applyInPandasWithState(
        running, kind, "n bigint, last bigint, gap bigint", "append", GroupStateTimeout.EventTimeTimeout,
    )
    return drained(out, "stateful").groupBy("user_id").agg(F.max("n").alias("n"), F.max("gap").alias("gap"))
