"""Joins: equi, outer, semi and anti, range, as-of, interval, lateral and correlated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table
from .rows import money


def small(df: DataFrame, most_rows: int = 100_000, most_bytes: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if it has most_rows rows and most_bytes bytes, as JSON, at most; or else Spark joins by shuffle."""
    rows, size = df.limit(most_rows + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if rows <= most_rows and (size or 0) <= most_bytes else df


@query("join_inner", """SELECT n_name, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue, count(*)::BIGINT AS n FROM lineitem
 JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def join_inner(spark, d) -> DataFrame:
    li, o, c, n = (table(spark, d, x) for x in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(
        n, F.col("c_nationkey") == F.col("n_nationkey"),
    )
    return j.groupBy("n_name").agg(money("l_extendedprice").alias("revenue"), F.count("*").alias("n"))


@query(
    "join_left",
    "SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
)
def join_left(spark, d) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(
        o, F.col("c_custkey") == F.col("o_custkey"), "left",
    ).groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query(
    "join_right",
    "SELECT o_orderkey, l_linenumber FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey AND l_quantity > 48",
)
def join_right(spark, d) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(
        o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_quantity") > 48), "right",
    ).select("o_orderkey", "l_linenumber")


@query("join_full", """SELECT c_nationkey, s_nationkey, n_c, n_s FROM (SELECT c_nationkey, count(*)::BIGINT AS n_c FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
 FULL JOIN (SELECT s_nationkey, count(*)::BIGINT AS n_s FROM supplier WHERE s_acctbal < 2000 GROUP BY 1) ON c_nationkey = s_nationkey""")
def join_full(spark, d) -> DataFrame:
    c = table(spark, d, "customer").where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("n_c"))
    s = table(spark, d, "supplier").where("s_acctbal < 2000").groupBy("s_nationkey").agg(F.count("*").alias("n_s"))
    return c.join(
        s, F.col("c_nationkey") == F.col("s_nationkey"), "full",
    ).select("c_nationkey", "s_nationkey", "n_c", "n_s")


@query(
    "join_broadcast",
    "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def join_broadcast(spark, d) -> DataFrame:
    """Nations and regions are broadcast after their number and bytes were checked."""
    s, n, r = (table(spark, d, x) for x in ("supplier", "nation", "region"))
    places = n.join(small(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.join(small(places), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query(
    "join_shuffle_hash",
    "SELECT p_brand, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
)
def join_shuffle_hash(spark, d) -> DataFrame:
    p = table(spark, d, "part").hint("shuffle_hash")
    return table(spark, d, "lineitem").join(
        p, F.col("l_partkey") == F.col("p_partkey"),
    ).groupBy("p_brand").agg(money("l_quantity").alias("quantity"))


def salted_join(big: DataFrame, other: DataFrame, key: str, other_key: str, salts: int = 8) -> DataFrame:
    """An inner join that spreads each key of big over `salts` tasks, for keys that hold much of the rows; other is repeated so often."""
    left = big.withColumn("salt_", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    right = other.withColumn("salt_", F.explode(F.array(*map(F.lit, range(salts)))))
    return left.join(right, (F.col(key) == F.col(other_key)) & (left["salt_"] == right["salt_"])).drop("salt_")


@query(
    "join_salted",
    "SELECT o_orderpriority, n_items, count(*)::BIGINT AS n FROM orders JOIN (SELECT o_orderpriority AS p, count(*)::BIGINT AS n_items FROM orders GROUP BY 1) ON o_orderpriority = p GROUP BY 1, 2",
)
def join_salted(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    sums = o.groupBy(F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n_items"))
    return salted_join(
        o, sums, "o_orderpriority", "p",
    ).groupBy("o_orderpriority", "n_items").agg(F.count("*").alias("n"))


@query(
    "join_semi",
    "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
)
def join_semi(spark, d) -> DataFrame:
    o = table(spark, d, "orders").where("o_totalprice > 400000")
    return table(spark, d, "customer").join(
        o, F.col("c_custkey") == F.col("o_custkey"), "left_semi",
    ).select("c_custkey", "c_name")


@query(
    "join_anti",
    "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
)
def join_anti(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return table(spark, d, "orders").join(
        li, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti",
    ).select("o_orderkey", "o_custkey")


@query(
    "join_one_row",
    "SELECT c_custkey, round(c_acctbal / t.top, 6) AS share FROM customer, (SELECT max(c_acctbal) AS top FROM customer) t",
)
def join_one_row(spark, d) -> DataFrame:
    """Each row against one row of totals, as a scalar subquery."""
    table(spark, d, "customer").createOrReplaceTempView("sparkwright_customer")
    return spark.sql(
        "SELECT c_custkey, round(c_acctbal / (SELECT max(c_acctbal) FROM sparkwright_customer), 6) AS share FROM sparkwright_customer"
    )


def dyadic_cells(first: Column, last: Column) -> Column:
    """(level, cell) pairs that together cover the whole numbers first ... last, each once: two of a level at most, however long the interval.

    Cells of level k are 2 ** k numbers wide. Those inside the interval are a ... b; an end that the next level's cells do not take in is a cell of the cover.
    """
    def cell(k: Column, c: Column, wanted: Column) -> Column:
        return F.when(wanted, F.struct(k.alias("level"), c.cast("bigint").alias("cell")))

    def of(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        a, b = F.call_function("shiftright", first + width - 1, k), F.call_function("shiftright", last + 1, k) - 1
        odd = (a <= b) & (F.pmod(a, F.lit(2)) == 1)
        return F.array(cell(k, a, odd), cell(k, b, (a <= b) & (F.pmod(b, F.lit(2)) == 0)))  # a is odd and b even, so never one cell twice

    top = F.when(last > first, F.floor(F.log2(last - first + 1)).cast("int") + 1).otherwise(F.lit(0))
    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), top), of)))


def range_join(left: DataFrame, right: DataFrame, at: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Rows of left whose `at` lies in [low, high) of right: an equi-join on cells, not a nested loop. The narrowest cells are `width` wide.

    An interval is cut into cells of doubling widths, O(log) of them even if it spans all values; a row of left is in one cell of each level that the intervals use.
    """
    cells = dyadic_cells(F.floor(low / width), F.floor(high / width))
    right = right.withColumn("cell_", F.explode(cells)).withColumns({"level_": F.col("cell_.level"), "at_": F.col("cell_.cell")}).drop("cell_")
    used = sorted(r[0] for r in right.select("level_").distinct().collect())  # 64 numbers at most
    own = F.array(*(F.struct(F.lit(k).alias("level_"), F.shiftright(F.floor(at / width), k).alias("at_")) for k in used))
    if not used:
        own = F.array().cast("array<struct<level_:int,at_:bigint>>")
    left = left.select("*", F.inline(own))
    return left.join(right, ["level_", "at_"]).where((at >= low) & (at < high)).drop("level_", "at_")


@query(
    "join_theta_range",
    """SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice >= p_retailprice * 200 AND o_totalprice < p_retailprice * 200 + 10""",
)
def join_theta_range(spark, d) -> DataFrame:
    o, p = table(spark, d, "orders"), table(spark, d, "part")
    low = F.col("p_retailprice") * 200
    return range_join(o, p, F.col("o_totalprice"), low, low + 10, 40.0).select("o_orderkey", "p_partkey")


#: Slices of time into which an as-of join cuts each key.
ASOF_SLICES = 64


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str, slices: int = ASOF_SLICES) -> DataFrame:
    """left with the `value` of the latest row of right(key, at, value) of the same key at or before its own `at`; the largest value of equal instants, null if there is none or key or `at` is null.

    Time is cut at quantiles of both sides, and a key's rows of one slice are a group of their own, so a key of half the rows is `slices` tasks. Within a slice one
    window finds the match; rows before their slice's first match take the last one of the slices before, of which a key has at most one for each slice. `at` is a timestamp.
    """
    right = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, value)
    instants = left.select(at).unionAll(right.select(at)).select(F.unix_micros(F.col(at).cast("timestamp")).alias("us"))
    cuts = instants.agg(F.percentile_approx("us", [i / slices for i in range(1, slices)], 1000)).first()[0] or []
    us = F.unix_micros(F.col(at).cast("timestamp"))
    cut = F.array(*map(F.lit, sorted(set(cuts)))).cast("array<bigint>")
    slice_ = F.when(us.isNotNull(), F.size(F.filter(cut, lambda c: c <= us)))
    left, right = left.withColumn("slice_", slice_), right.withColumn("slice_", slice_)

    both = left.withColumn("match_", F.lit(None).cast(right.schema[value].dataType)).withColumn("own_", F.lit(True)).unionByName(
        right.select(key, at, "slice_", F.col(value).alias("match_"), F.lit(False).alias("own_")), allowMissingColumns=True,
    )
    w = Window.partitionBy(key, "slice_").orderBy(at, "own_", "match_").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("match_", F.last_value("match_", ignoreNulls=True).over(w)).where("own_")

    ends = right.groupBy(key, "slice_").agg(F.max(F.struct(at, value))[value].alias("end_"))
    later = Window.partitionBy(key).orderBy("slice_")
    ends = ends.withColumn("upto_", F.coalesce(F.lead("slice_").over(later), F.lit(slices)))  # a key has a row a slice at most
    carried = ends.select(F.col(key).alias("key_"), "end_", F.explode(F.expr("filter(sequence(slice_, upto_), s -> s > slice_)")).alias("to_"))
    out = inside.join(carried, (F.col(key) == F.col("key_")) & (F.col("slice_") == F.col("to_")), "left")
    return out.withColumn(value, F.coalesce("match_", "end_")).select(*(c for c in left.columns if c != "slice_"), value)


@query("join_asof", """SELECT e.event_id, p.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') e
 ASOF LEFT JOIN (SELECT max(event_id) AS event_id, user_id, ts FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def join_asof(spark, d) -> DataFrame:
    """The latest purchase at or before each other event of the user."""
    e = table(spark, d, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    rest = e.where("event_type <> 'purchase'").select("user_id", "ts", "event_id")
    return asof_join(rest, bought, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@query("join_interval", """SELECT a.event_id AS event_id, count(*)::BIGINT AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR
 AND a.event_id <> b.event_id GROUP BY a.event_id""")
def join_interval(spark, d) -> DataFrame:
    """Other events of the user within an hour on either side: equi-join on the user and the hour, with one hour to each side."""
    e = table(spark, d, "events").select(
        "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
    )
    hour = 3_600_000_000
    a = e.withColumn("bucket", F.floor(F.col("us") / hour))
    b = e.select(
        F.col("event_id").alias("b_id"), "user_id", F.col("us").alias("b_us"),
        F.explode(F.sequence(F.floor(F.col("us") / hour) - 1, F.floor(F.col("us") / hour) + 1)).alias("bucket"),
    )
    near = a.join(
        b, ["user_id", "bucket"],
    ).where((F.abs(F.col("us") - F.col("b_us")) <= hour) & (F.col("event_id") != F.col("b_id")))
    return near.groupBy("event_id").agg(F.count("*").alias("n"))


@query(
    "join_lateral",
    "SELECT n_nationkey, t.c_custkey, t.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t",
)
def join_lateral(spark, d) -> DataFrame:
    for t in ("nation", "customer"):
        table(spark, d, t).createOrReplaceTempView(f"sparkwright_{t}")
    return spark.sql("""SELECT n_nationkey, t.c_custkey, t.c_acctbal FROM sparkwright_nation, LATERAL (SELECT c_custkey, c_acctbal FROM sparkwright_customer
      WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t""")


@query(
    "subquery_scalar_corr",
    "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem l WHERE l_quantity > (SELECT 1.5 * avg(l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey)",
)
def subquery_scalar_corr(spark, d) -> DataFrame:
    table(spark, d, "lineitem").createOrReplaceTempView("sparkwright_lineitem")
    return spark.sql(
        "SELECT l_orderkey, l_partkey, l_quantity FROM sparkwright_lineitem l WHERE l_quantity > (SELECT 1.5 * avg(l_quantity) FROM sparkwright_lineitem x WHERE x.l_partkey = l.l_partkey)"
    )
