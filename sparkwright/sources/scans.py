"""Scans, other formats and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from .shared import fresh_path
from .tables import table


@query(
    "scan_parquet",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
)
def scan_parquet(spark, d) -> DataFrame:
    return table(spark, d, "orders")


@query(
    "scan_pruned",
    "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_shipdate >= TIMESTAMP '1998-01-01'",
)
def scan_pruned(spark, d) -> DataFrame:
    """Two columns out and two filters that reach the Parquet reader."""
    wanted = (F.col("l_quantity") >= 45) & (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return table(spark, d, "lineitem").where(wanted).select("l_orderkey", "l_quantity")


def copied(df: DataFrame, kind: str, **options) -> DataFrame:
    """df, written in another format to the shared folder and read again by its own schema."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, f"copy-{kind}")
    df.write.format(kind).options(**options).save(path)
    return spark.read.format(kind).options(**options).schema(df.schema).load(path)


ORDERS_SQL = "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate FROM orders"
ORDER_COLUMNS = ("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")


@query("scan_csv", ORDERS_SQL)
def scan_csv(spark, d) -> DataFrame:
    return copied(table(spark, d, "orders").select(*ORDER_COLUMNS), "csv", header=True)


@query("scan_json", ORDERS_SQL)
def scan_json(spark, d) -> DataFrame:
    return copied(table(spark, d, "orders").select(*ORDER_COLUMNS), "json")


@query("scan_orc", ORDERS_SQL)
def scan_orc(spark, d) -> DataFrame:
    return copied(table(spark, d, "orders").select(*ORDER_COLUMNS), "orc")


@query("scan_text", "SELECT o_orderpriority AS value, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def scan_text(spark, d) -> DataFrame:
    return copied(
        table(spark, d, "orders").select(F.col("o_orderpriority").alias("value")), "text",
    ).groupBy("value").agg(F.count("*").alias("n"))


#: Files of one folder that are written side by side, so that a hot type is not one task.
SALTS = 16


@query(
    "sink_parquet",
    "SELECT event_type, count(*)::BIGINT AS n, min(event_id)::BIGINT AS first_id FROM events WHERE event_type <> 'view' GROUP BY event_type",
)
def sink_parquet(spark, d) -> DataFrame:
    """Written by partition; the filter on the partition column then prunes folders."""
    path = fresh_path(spark, "events-by-type")
    events = table(spark, d, "events").select("event_id", "ts", "event_type")
    events.repartition(
        "event_type", F.pmod(F.xxhash64("event_id"), F.lit(SALTS)),
    ).write.partitionBy("event_type").parquet(path)
    again = spark.read.schema("event_id bigint, ts timestamp_ntz, event_type string").parquet(path)
    return again.where("event_type <> 'view'").groupBy("event_type").agg(
        F.count("*").alias("n"), F.min("event_id").alias("first_id"),
    )


def write_bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """df as a table whose files are dealt and sorted by the key: joins and groupings of such tables on the key need no exchange. Its files lie in the shared folder."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    called = f"sparkwright_{path.rsplit('/', 1)[1].replace('-', '_')}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(called)
    return spark.table(called)


@query(
    "sink_bucketed",
    "SELECT o_orderkey, o_orderpriority, count(*)::BIGINT AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL",
)
def sink_bucketed(spark, d) -> DataFrame:
    """Orders and lines written in buckets of the order, then joined and grouped by it without another exchange."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = write_bucketed(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", buckets, "orders-bucketed")
    li = write_bucketed(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", buckets, "lines-bucketed")
    joined = o.hint("merge").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderpriority").agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"),
    )


@query(
    "join_dynamic_pruning",
    "SELECT o_orderpriority, n_name, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_totalprice > 1000 AND o_orderpriority LIKE '1%') ON o_orderpriority = p GROUP BY ALL",
)
def join_dynamic_pruning(spark, d) -> DataFrame:
    """Orders written in folders by priority; the priorities of a filtered side become a filter on the folders when the query runs."""
    path = fresh_path(spark, "orders-by-priority")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    o.repartition("o_orderpriority", F.pmod(F.xxhash64("o_orderkey"), F.lit(SALTS))).write.partitionBy("o_orderpriority").parquet(path)
    again = spark.read.schema("o_orderkey bigint, o_custkey bigint, o_orderpriority string").parquet(path)
    wanted = table(spark, d, "orders").where("o_totalprice > 1000 AND o_orderpriority LIKE '1%'").select(F.col("o_orderpriority").alias("p")).distinct()
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    kept = again.join(F.broadcast(wanted), F.col("o_orderpriority") == F.col("p"))  # a row for each priority
    return kept.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        "o_orderpriority", "n_name",
    ).agg(F.count("*").alias("n"))


@query("from_json_struct", "SELECT event_id, (props ->> 'k')::BIGINT AS k FROM events")
def from_json_struct(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("from_csv_struct", "SELECT o_orderkey, o_totalprice AS price, o_orderstatus AS status FROM orders")
def from_csv_struct(spark, d) -> DataFrame:
    """Lines of CSV in a column, parsed by a declared schema."""
    o = table(spark, d, "orders")
    line = F.to_csv(F.struct("o_totalprice", "o_orderstatus"))
    return o.select(
        "o_orderkey", F.from_csv(line, "price double, status string").alias("r"),
    ).select("o_orderkey", "r.price", "r.status")


@query("from_xml_struct", "SELECT c_custkey, c_name AS name, c_nationkey AS nation FROM customer")
def from_xml_struct(spark, d) -> DataFrame:
    text = F.concat(
        F.lit("<c><name>"), F.replace("c_name", F.lit("&"), F.lit("&amp;")), F.lit("</name><nation>"),
        F.col("c_nationkey").cast("string"), F.lit("</nation></c>"),
    )
    return table(spark, d, "customer").select(
        "c_custkey", F.from_xml(text, "name string, nation int").alias("r"),
    ).select("c_custkey", "r.name", "r.nation")
