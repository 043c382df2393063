"""Window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table

@query("win_rank", """SELECT c_custkey, (row_number() OVER w)::INT AS rn, (rank() OVER s)::INT AS rk, (dense_rank() OVER s)::INT AS dr, round(percent_rank() OVER w, 9) AS pr,
 round(cume_dist() OVER w, 9) AS cd, (ntile(4) OVER w)::INT AS nt FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), s AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)""")
def win_rank(spark, d) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    s = Window.partitionBy("c_nationkey").orderBy("c_mktsegment")
    return table(spark, d, "customer").select(
        "c_custkey", F.row_number().over(w).alias("rn"), F.rank().over(s).alias("rk"),
        F.dense_rank().over(s).alias("dr"), F.round(F.percent_rank().over(w), 9).alias("pr"),
        F.round(F.cume_dist().over(w), 9).alias("cd"), F.ntile(4).over(w).alias("nt"),
    )


@query("win_offset", """SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, first_value(event_id) OVER w AS first_id, nth_value(event_id, 2) OVER w AS second_id
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def win_offset(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select(
        "event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2).over(w).alias("after"),
        F.first_value("event_id").over(w).alias("first_id"), F.nth_value("event_id", 2).over(w).alias("second_id"),
    )


@query(
    "win_frame_rows",
    "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM events",
)
def win_frame_rows(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("moving"))


@query(
    "win_frame_range",
    "SELECT event_id, (count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW))::BIGINT AS last_day FROM events",
)
def win_frame_range(spark, d) -> DataFrame:
    """The frame is in microseconds, as a DataFrame's range takes numbers."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    return table(spark, d, "events").select("event_id", "user_id", us.alias("us")).select(
        "event_id", F.count("*").over(w).alias("last_day"),
    )


@query(
    "win_qualify",
    "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) = 1",
)
def win_qualify(spark, d) -> DataFrame:
    """The dearest line of each order: a maximum with partial aggregation, where a window would sort all lines."""
    best = F.max_by(
        F.struct("l_partkey", "l_extendedprice"), F.struct("l_extendedprice", -F.col("l_partkey"), -F.col("l_suppkey")),
    )
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(best.alias("b")).select(
        "l_orderkey", "b.l_partkey", "b.l_extendedprice",
    )


@query(
    "win_running_total",
    "SELECT o_orderkey, (sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))::DOUBLE AS running FROM orders",
)
def win_running_total(spark, d) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select(
        "o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w).cast("double").alias("running"),
    )


@query(
    "dialogue_context",
    """SELECT conv_id, turn, array_to_string(list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), chr(10)) AS context FROM conversations""",
)
def dialogue_context(spark, d) -> DataFrame:
    """Each turn with the two before it, as one text."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 0)
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.array_join(F.collect_list(line).over(w), "\n").alias("context"),
    )
