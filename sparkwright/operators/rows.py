"""Projections, filters, sampling, sorting and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.shared import written
from ..sources.tables import table


def money(c) -> F.Column:
    """An exact sum of amounts in cents, as a double."""
    return F.sum(F.col(c).cast("decimal(18,2)") if isinstance(c, str) else c.cast("decimal(18,2)")).cast("double")


@query(
    "project_expr",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 4) AS net, l_quantity / 2 AS half FROM lineitem",
)
def project_expr(spark, d) -> DataFrame:
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", net.alias("net"),
        (F.col("l_quantity") / 2).alias("half"),
    )


@query("filter_pred", """SELECT c_custkey, c_name FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')
 AND c_name LIKE 'Customer%' AND NOT regexp_matches(c_name, '[13579]$') AND c_nationkey IS NOT NULL""")
def filter_pred(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    wanted = F.col("c_acctbal").between(0, 5000) & F.col("c_mktsegment").isin(
        "BUILDING", "MACHINERY",
    ) & F.col("c_name").like("Customer%")
    return c.where(wanted & ~F.col("c_name").rlike("[13579]$") & F.col("c_nationkey").isNotNull()).select(
        "c_custkey", "c_name",
    )


@query(
    "case_when",
    "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 250000 THEN 'medium' ELSE 'large' END AS size FROM orders",
)
def case_when(spark, d) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey", F.when(p < 50000, "small").when(p < 250000, "medium").otherwise("large").alias("size"),
    )


@query(
    "sample_hashed",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 4))::INT < 6554",
)
def sample_hashed(spark, d) -> DataFrame:
    """A tenth of the orders: a sample that any engine draws again."""
    h = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 4), 16, 10).cast("int")
    return table(spark, d, "orders").where(h < 6554).select("o_orderkey", "o_totalprice")


@query(
    "sort_total",
    "SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal DESC NULLS LAST, s_suppkey)::INT AS place FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey",
)
def sort_total(spark, d) -> DataFrame:
    """Places in a total order without a single task: rows are dealt by range, and each range adds the counts of those before it."""
    order = [F.col("s_acctbal").desc_nulls_last(), F.col("s_suppkey").asc()]
    ranged = table(spark, d, "supplier").select("s_suppkey", "s_acctbal").repartitionByRange(*order).withColumn(
        "part", F.spark_partition_id(),
    )
    local = written(ranged, "ranges").withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    counts = local.groupBy("part").agg(F.max("nth").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    starts = counts.select("part", before.alias("start"))
    return local.join(F.broadcast(starts), "part").select(
        "s_suppkey", "s_acctbal", (F.col("start") + F.col("nth")).cast("int").alias("place"),
    ).orderBy(*order)


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.desc("o_totalprice"), "o_orderkey",
    ).limit(25)


@query("topk_group", """SELECT o_custkey, o_orderkey, o_totalprice, rk FROM (SELECT o_custkey, o_orderkey, o_totalprice,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rk FROM orders) WHERE rk <= 3""")
def topk_group(spark, d) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("rk"),
    ).where("rk <= 3")


@query("offset_limit", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 20 OFFSET 40")
def offset_limit(spark, d) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", "p_retailprice",
    ).orderBy("p_retailprice", "p_partkey").offset(40).limit(20)
