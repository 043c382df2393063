"""Set operations, distinct rows and recursion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.shared import written
from ..sources.tables import table

C, S = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"


def _keys(spark, d) -> tuple[DataFrame, DataFrame]:
    return table(
        spark, d, "customer",
    ).select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))


@query("union_all", f"{C} UNION ALL {S}")
def union_all(spark, d) -> DataFrame:
    c, s = _keys(spark, d)
    return c.unionByName(s)


@query("union", f"{C} UNION {S}")
def union(spark, d) -> DataFrame:
    c, s = _keys(spark, d)
    return c.union(s).distinct()


@query("intersect", f"{C} INTERSECT {S}")
def intersect(spark, d) -> DataFrame:
    c, s = _keys(spark, d)
    return c.intersect(s)


@query("intersect_all", f"{C} INTERSECT ALL {S}")
def intersect_all(spark, d) -> DataFrame:
    c, s = _keys(spark, d)
    return c.intersectAll(s)


@query("except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def except_(spark, d) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    return p.subtract(table(spark, d, "lineitem").where("l_quantity > 49").select("l_partkey"))


@query("except_all", f"{C} EXCEPT ALL {S}")
def except_all(spark, d) -> DataFrame:
    c, s = _keys(spark, d)
    return c.exceptAll(s)


@query("distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query(
    "drop_duplicates",
    "SELECT l_orderkey, l_linenumber, min(l_extendedprice) AS least FROM lineitem GROUP BY l_orderkey, l_linenumber",
)
def drop_duplicates(spark, d) -> DataFrame:
    """One line for each order and number; which one is stated, not left to chance."""
    return table(spark, d, "lineitem").groupBy(
        "l_orderkey", "l_linenumber",
    ).agg(F.min("l_extendedprice").alias("least"))


@query(
    "drop_duplicates_row",
    """SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def drop_duplicates_row(spark, d) -> DataFrame:
    """The whole row of the latest event of each user and type: a maximum with partial aggregation, where dropDuplicates would leave the row to chance."""
    row = F.struct("event_id", "value")
    return table(spark, d, "events").groupBy(
        "user_id", "event_type",
    ).agg(F.max_by(row, F.struct("ts", "event_id")).alias("r")).select("user_id", "event_type", "r.*")


RECURSION_ROWS = "spark.sql.cteRecursionRowLimit"


@query("cte_recursive", """WITH RECURSIVE m(o_orderkey, step, left_over) AS (SELECT o_orderkey, 0, floor(o_totalprice)::BIGINT FROM orders
 UNION ALL SELECT o_orderkey, step + 1, left_over // 8 FROM m WHERE left_over >= 8) SELECT o_orderkey, max(step)::INT AS digits FROM m GROUP BY o_orderkey""")
def cte_recursive(spark, d) -> DataFrame:
    """Spark ends a recursion at a number of rows (a million, unless it is set) that tables pass; each step here makes an eighth of its number, so that it ends by itself. Written while the setting holds."""
    table(spark, d, "orders").createOrReplaceTempView("sparkwright_orders")
    before = spark.conf.get(RECURSION_ROWS)
    spark.conf.set(RECURSION_ROWS, "-1")
    try:
        return written(spark.sql("""WITH RECURSIVE m(o_orderkey, step, left_over) AS (SELECT o_orderkey, 0, CAST(floor(o_totalprice) AS BIGINT) FROM sparkwright_orders
      UNION ALL SELECT o_orderkey, step + 1, left_over div 8 FROM m WHERE left_over >= 8) SELECT o_orderkey, CAST(max(step) AS INT) AS digits FROM m GROUP BY o_orderkey"""), "digits")
    finally:
        spark.conf.set(RECURSION_ROWS, before)


def closure(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame | None:
    """(start, node) of every node that can be reached from each of starts(start) over edges(src, dst), itself included.

    Semi-naive: a step joins only the pairs that the step before found first, and each step's new pairs are written, so the lineage stays short and
    nothing is found twice. It takes as many steps as the longest of the shortest paths. None, where most is given and there are more pairs than that.
    """
    edges = written(edges.select("src", "dst").distinct(), "edges")
    new = written(starts.select("start", F.col("start").alias("node")).distinct(), "reached")
    seen, pairs = new, 0
    while n := new.count():
        pairs += n
        if most is not None and pairs > most:
            return None
        ahead = new.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        new = written(ahead.join(seen, ["start", "node"], "left_anti"), "reached")
        seen = seen.union(new)
    return seen


#: Nodes of which the best one is the hub; pairs up to which plain steps do; nodes and starts of a lot, starts of a part, and pairs of a task, about.
HUBS, HUB_PAIRS, LOT, STARTS, TASK_PAIRS = 8, 1 << 20, 512, 1 << 16, 1 << 25


def closure_by_hub(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The rows of closure(edges, starts), where most starts reach one of a few large parts of the graph: steps of linear size, though the result is starts times nodes.

    Of HUBS nodes, the hub is the one whose starts times what it reaches are the most. What it reaches (ahead) is closed, so a start that reaches the hub has all of it, and
    steps on from such a start only outside; these rows are made once, at the end. The starts that do not reach the hub take the plain steps, or get another hub if that makes
    more than HUB_PAIRS.
    """
    edges = written(edges.select("src", "dst").distinct(), "edges")
    starts = written(starts.select("start").distinct(), "starts")
    found, near, rest = [], edges, None
    while rest is None:
        tried = near.where("dst IS NOT NULL").select("dst").distinct()
        tried = [r[0] for r in tried.orderBy(F.xxhash64("dst"), "dst").limit(HUBS).collect()]
        ahead, behind = _reached(edges, tried), _reached(edges.toDF("dst", "src"), tried)
        behind = written(behind.withColumnRenamed("node", "start").join(starts, "start", "left_semi"), "behind")
        has = [F.col("hubs").bitwiseAND(1 << i) != 0 for i in range(HUBS)]
        a, b = (df.agg(*(F.count_if(x) for x in has)).first() for df in (ahead, behind))
        i = max(range(HUBS), key=lambda i: a[i] * b[i])
        if a[i] * b[i] < (HUB_PAIRS if found else 1):
            rest = closure(edges, starts)
            break
        ahead, behind = ahead.where(has[i]).drop("hubs"), behind.where(has[i]).drop("hubs")
        ahead_of = lambda c: ahead.select(F.col("node").alias(c))  # noqa: E731, B023
        outer = edges.join(ahead_of("src"), "src", "left_anti").join(ahead_of("dst"), "dst", "left_anti").select("src", "dst")
        found += [_all_pairs(behind, ahead, b[i], a[i]), closure(outer, behind.join(ahead_of("start"), "start", "left_anti"))]
        starts = written(starts.join(behind, "start", "left_anti"), "starts")
        near = edges.join(starts, F.col("src") == F.col("start"), "left_semi")
        rest = closure(edges, starts, HUB_PAIRS)
    return reduce(DataFrame.unionByName, found, rest)


def _reached(edges: DataFrame, tried: list) -> DataFrame:
    """(node, hubs) of the nodes that one of a few others reaches, itself included; bit i of hubs stands for tried[i]. Steps as those of closure(), with a row for each node."""
    nodes = edges.sparkSession.createDataFrame([(x, 1 << i) for i, x in enumerate(tried)], f"node {edges.schema['dst'].dataType.simpleString()}, hubs int")
    seen = new = written(nodes, "reached")
    while not new.isEmpty():
        ahead = new.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.bit_or("hubs").alias("hubs"))
        known = seen.groupBy("node").agg(F.bit_or("hubs").alias("known"))
        fresh = F.col("hubs").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0))))
        new = written(ahead.join(known, "node", "left").select("node", fresh.alias("hubs")).where("hubs <> 0"), "reached")
        seen = seen.union(new)
    return written(seen.groupBy("node").agg(F.bit_or("hubs").alias("hubs")), "reached")


def _all_pairs(starts: DataFrame, nodes: DataFrame, n_starts: int, n_nodes: int) -> DataFrame:
    """(start, node) of all pairs: lots of both meet and are opened last. A task repeats the nodes of a lot for each start, so its Parquet is short: they recur within a page."""

    def lots(df: DataFrame, column: str, n: int) -> DataFrame:
        many = df.groupBy(F.pmod(F.xxhash64(column), F.lit(-(-n // (32 * LOT)))).alias("lot")).agg(F.collect_list(column).alias("all"))
        return many.select(F.explode(F.sequence(F.lit(1), F.size("all"), F.lit(LOT))).alias("at"), "all").select(F.slice("all", F.col("at"), F.lit(LOT)).alias(f"{column}s"))

    parts = -(-n_starts // STARTS)
    tasks = max(int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_starts * n_nodes // TASK_PAIRS) // parts
    left = lots(nodes, "node", n_nodes).repartition(max(1, min(-(-n_nodes // LOT), tasks)))
    met = left.hint("shuffle_replicate_nl").crossJoin(lots(starts, "start", n_starts).repartition(parts))
    return met.select("nodes", F.explode("starts").alias("start")).select("start", F.explode("nodes").alias("node"))
