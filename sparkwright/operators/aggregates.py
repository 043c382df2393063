"""Aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.shared import written
from ..sources.tables import table
from .rows import money


@query("agg_hash", """SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_price,
 min(l_discount) AS min_discount, max(l_tax) AS max_tax, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL""")
def agg_hash(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        money("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_price"),
        F.min("l_discount").alias("min_discount"), F.max("l_tax").alias("max_tax"), F.count("*").alias("n"),
    )


@query(
    "agg_object",
    "SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS segments FROM customer GROUP BY c_nationkey",
)
def agg_object(spark, d) -> DataFrame:
    return table(
        spark, d, "customer",
    ).groupBy("c_nationkey").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("segments"))


@query(
    "agg_sort",
    "SELECT o_orderstatus, max(o_orderpriority) AS top, min(o_orderpriority) AS least FROM orders GROUP BY o_orderstatus",
)
def agg_sort(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.max("o_orderpriority").alias("top"), F.min("o_orderpriority").alias("least"),
    )


@query(
    "agg_distinct",
    "SELECT l_returnflag, count(DISTINCT l_partkey)::BIGINT AS parts, count(DISTINCT l_suppkey)::BIGINT AS suppliers FROM lineitem GROUP BY l_returnflag",
)
def agg_distinct(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"),
    )


LEVELS = "sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, count(*)::BIGINT AS n, grouping(o_orderstatus)::INT AS g1, grouping(o_orderpriority)::INT AS g2 FROM orders GROUP BY"


def _levels(grouped) -> DataFrame:
    return grouped.agg(
        money("o_totalprice").alias("total"), F.count("*").alias("n"),
        F.grouping("o_orderstatus").cast("int").alias("g1"), F.grouping("o_orderpriority").cast("int").alias("g2"),
    )


@query("agg_cube", f"SELECT o_orderstatus, o_orderpriority, {LEVELS} CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, d) -> DataFrame:
    return _levels(table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority"))


@query("agg_rollup", f"SELECT o_orderstatus, o_orderpriority, {LEVELS} ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, d) -> DataFrame:
    return _levels(table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority"))


@query(
    "agg_grouping_sets",
    f"SELECT o_orderstatus, o_orderpriority, {LEVELS} GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
)
def agg_grouping_sets(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return _levels(o.groupingSets(
        [[F.col("o_orderstatus")], [F.col("o_orderpriority")], []], "o_orderstatus", "o_orderpriority",
    ))


@query("agg_pivot", """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS f, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS o,
 count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS p FROM orders GROUP BY o_orderpriority""")
def agg_pivot(spark, d) -> DataFrame:
    wide = table(spark, d, "orders").groupBy("o_orderpriority").pivot(
        "o_orderstatus", ["F", "O", "P"],
    ).count().na.fill(0)
    return wide.select("o_orderpriority", *(F.col(x).alias(x.lower()) for x in "FOP"))


@query(
    "unpivot",
    "SELECT s_suppkey, name, amount FROM (SELECT s_suppkey, s_acctbal AS balance, s_nationkey::DOUBLE AS nation FROM supplier) UNPIVOT (amount FOR name IN (balance, nation))",
)
def unpivot(spark, d) -> DataFrame:
    s = table(spark, d, "supplier").select(
        "s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"),
    )
    return s.unpivot("s_suppkey", ["balance", "nation"], "name", "amount")


def ordered_bits(x: Column) -> Column:
    """A whole number for each double, in the order of the doubles: exponent and mantissa as in its 64 bits, negated for negative ones; NaN above all, both zeros alike.

    Exact, as powers of two divide without rounding. Subnormal numbers count in steps of 2 ** -1074.
    """
    size = F.abs(x.cast("double"))
    two = lambda e: F.pow(F.lit(2.0), e)
    guess = F.floor(F.log2(size))
    power = F.when(size < two(guess), guess - 1).when(size >= two(guess + 1), guess + 1).otherwise(guess)  # log2 may round over a power
    normal = (power + 1023) * F.lit(1 << 52) + ((size / two(power) - 1) * 2.0**52).cast("bigint")
    most = F.lit(2047 << 52)
    bits = (
        F.when(F.isnan(size), most + 1).when(size == float("inf"), most).when(size < 2.0**-1022, (size * 2.0**537 * 2.0**537).cast("bigint")).otherwise(normal)
    )
    return F.when((x < 0) & ~F.isnan(size), -bits).otherwise(bits)


def from_ordered_bits(k: Column) -> Column:
    """The double of a number of ordered_bits."""
    size = F.abs(k)
    power, rest = F.shiftright(size, 52), size.bitwiseAND(F.lit((1 << 52) - 1))
    normal = F.pow(F.lit(2.0), power - 1023) * (1 + rest / 2.0**52)
    x = F.when(size > F.lit(2047 << 52), F.lit(float("nan"))).when(power == 2047, F.lit(float("inf"))).when(
        power == 0, rest * F.pow(F.lit(2.0), F.lit(-1074)),
    ).otherwise(normal)
    return F.when(k < 0, -x).otherwise(x)


#: Bits of a value that each pass leaves for later passes: histograms of 2 ** 22 cells a group at most.
QUANTILE_SHIFTS = (42, 21, 0)


def exact_quantiles(df: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """by, and a column for each of fractions (name: share): the exact interpolated quantile of the non-null values of the group. Groups without a value have no row.

    No task holds a group's values: each pass counts values by the leading bits of their order, finds the cell that holds each wanted rank, and the next pass
    counts the values of those cells alone, by more bits. The last pass's cell is the value. What a group sends is its histogram, summed before the shuffle.
    """
    key = ordered_bits(F.col(value))
    data = df.where(F.col(value).isNotNull()).select(*by, key.alias("key_"))
    names = list(fractions)
    wanted = None
    for shift in QUANTILE_SHIFTS:
        cell = F.shiftright("key_", shift).alias("cell_")
        if wanted is None:
            counts, within = data.groupBy(*by, cell).agg(F.count("*").alias("c_")), list(by)
        else:
            held = F.shiftright("key_", last).alias("held_")
            left, within = data.select(*by, held, cell), [*by, "held_"]
            asked = wanted.select(*(F.col(c).alias(f"{c}_of") for c in within), "ranks_")
            same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in within]
            some = left.join(asked.drop("ranks_"), same, "left_semi")
            counts = some.groupBy(*within, "cell_").agg(F.count("*").alias("c_")).join(asked, same).drop(*(f"{c}_of" for c in within))
        whole = Window.partitionBy(*within)
        counts = counts.withColumn("before_", F.sum("c_").over(whole.orderBy("cell_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c_"))
        if wanted is None:
            counts = counts.withColumn("n_", F.sum("c_").over(whole))
            at = {k: (F.col("n_") - 1) * F.lit(float(p)) for k, p in fractions.items()}
            ranks = [F.struct(F.lit(2 * i + up).alias("i"), r(at[k]).cast("bigint").alias("r"), (at[k] - F.floor(at[k])).alias("part")) for i, k in enumerate(names) for up, r in enumerate((F.floor, F.ceil))]
            counts = counts.withColumn("ranks_", F.array(*ranks))
        here = F.expr("transform(filter(ranks_, x -> x.r >= before_ AND x.r < before_ + c_), x -> named_struct('i', x.i, 'r', x.r - before_, 'part', x.part))")
        wanted = counts.select(*by, F.col("cell_").alias("held_"), here.alias("ranks_")).where(F.size("ranks_") > 0)
        last = shift
        if shift:
            wanted = written(wanted, "ranks")
    found = wanted.select(*by, from_ordered_bits(F.col("held_")).alias("x_"), F.explode("ranks_").alias("rank_"))
    of = lambda i, c: F.max(F.when(F.col("rank_.i") == i, c))
    out = []
    for i, k in enumerate(names):
        low, high, part = of(2 * i, F.col("x_")), of(2 * i + 1, F.col("x_")), of(2 * i, F.col("rank_.part"))
        out.append(F.when(low == high, low).otherwise(low + part * (high - low)).alias(k))
    return found.groupBy(*by).agg(*out)


@query(
    "agg_quantile",
    "SELECT p_brand, round(median(p_retailprice), 6) AS mid, round(quantile_cont(p_retailprice, 0.9), 6) AS p90 FROM part GROUP BY p_brand",
)
def agg_quantile(spark, d) -> DataFrame:
    q = exact_quantiles(table(spark, d, "part"), ["p_brand"], "p_retailprice", {"mid": 0.5, "p90": 0.9})
    return q.select("p_brand", F.round("mid", 6).alias("mid"), F.round("p90", 6).alias("p90"))


@query("agg_approx_distinct")
def agg_approx_distinct(spark, d) -> DataFrame:
    """Estimates; engines differ, so rows only. tests/ holds them within 5 % of the exact counts."""
    return table(
        spark, d, "lineitem",
    ).groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("agg_sketch")
def agg_sketch(spark, d) -> DataFrame:
    """Sketches by day, merged over the month: what a rollup keeps so that no raw row is read again."""
    e = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.hll_sketch_agg("user_id").alias("users"), F.kll_sketch_agg_double("value").alias("amounts"),
    )
    merged = e.groupBy("event_type").agg(
        F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("amounts").alias("amounts"),
    )
    return merged.select(
        "event_type", F.hll_sketch_estimate("users").alias("users"),
        F.kll_sketch_get_quantile_double("amounts", F.lit(0.5)).alias("mid"),
    )


@query("agg_stats", """SELECT l_linestatus, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS var, round(corr(l_quantity, l_extendedprice), 6) AS cor,
 round(covar_samp(l_quantity, l_discount), 6) AS cov, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_linestatus""")
def agg_stats(spark, d) -> DataFrame:
    q = "l_quantity"
    stats = {
        "sd": F.stddev_samp(q), "var": F.var_pop(q), "cor": F.corr(q, "l_extendedprice"),
        "cov": F.covar_samp(q, "l_discount"),
    }
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(
        *(F.round(c, 6).alias(k) for k, c in stats.items()),
        F.round(F.regr_slope("l_extendedprice", q), 4).alias("slope"),
    )


@query("agg_kurtosis", "SELECT event_type, round(kurtosis_pop(value), 5) AS kurt FROM events GROUP BY event_type")
def agg_kurtosis(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.kurtosis("value"), 5).alias("kurt"))


@query(
    "agg_argmax",
    "SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS richest, arg_min(c_custkey, (c_acctbal, c_custkey)) AS poorest FROM customer GROUP BY c_nationkey",
)
def agg_argmax(spark, d) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(
        F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("richest"),
        F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("poorest"),
    )


@query(
    "agg_string",
    "SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey",
)
def agg_string(spark, d) -> DataFrame:
    return table(
        spark, d, "orders",
    ).groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderpriority")), ",").alias("priorities"))


@query(
    "agg_centroid",
    "SELECT label, i::INT AS i, round(avg(x::DOUBLE), 5) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i",
)
def agg_centroid(spark, d) -> DataFrame:
    long = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return long.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query(
    "agg_filtered",
    "SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS bought, bool_or(value > 90) AS large, bit_xor(event_id)::BIGINT AS mark FROM events GROUP BY user_id",
)
def agg_filtered(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("bought"), F.bool_or(F.col("value") > 90).alias("large"),
        F.bit_xor("event_id").alias("mark"),
    )


@query("agg_histogram", "SELECT floor(value / 10)::BIGINT AS bin, count(*)::BIGINT AS n FROM events GROUP BY bin")
def agg_histogram(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").alias("n"))


@query("agg_sketch_sets")
def agg_sketch_sets(spark, d) -> DataFrame:
    """Users by theta sketches of each type and day, united over the month; tests/ hold them within 5 % of the exact counts."""
    e = table(spark, d, "events").groupBy(
        "event_type", F.to_date("ts").alias("day"),
    ).agg(F.theta_sketch_agg("user_id").alias("users"))
    return e.groupBy("event_type").agg(F.theta_sketch_estimate(F.theta_union_agg("users")).alias("users"))


@query("agg_top_k")
def agg_top_k(spark, d) -> DataFrame:
    """The most frequent suppliers by a bounded sketch, estimated counts and all."""
    table(spark, d, "lineitem").createOrReplaceTempView("sparkwright_top_k")
    return spark.sql("SELECT l_returnflag, explode(top) AS t FROM (SELECT l_returnflag, approx_top_k(l_suppkey, 5, 20000) AS top FROM sparkwright_top_k GROUP BY l_returnflag)").select("l_returnflag", F.col("t.item").alias("item"), F.col("t.count").alias("n"))


@query("label_eval", """WITH p AS (SELECT quality, (n_chars >= 300)::INT AS predicted FROM documents JOIN labels USING (doc_id))
 SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE quality = 1 AND predicted = 1)::BIGINT AS tp, count(*) FILTER (WHERE quality = 0 AND predicted = 1)::BIGINT AS fp, count(*) FILTER (WHERE quality = 1 AND predicted = 0)::BIGINT AS fn,
 count(*) FILTER (WHERE quality = 0 AND predicted = 0)::BIGINT AS tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM p""")
def label_eval(spark, d) -> DataFrame:
    """A verdict, here a rule on length, against the labels: the confusion counts and what follows from them."""
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(
        table(spark, d, "labels").select("doc_id", "quality"), "doc_id",
    )
    return evaluated(j.select(
        F.col("quality").alias("label"), (F.col("n_chars") >= 300).cast("int").alias("predicted"),
    ))


def evaluated(pairs: DataFrame) -> DataFrame:
    """One row for pairs(label, predicted) of 0 and 1."""
    counts = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    c = pairs.agg(
        F.count("*").alias("n"),
        *(F.count_if((F.col("label") == a) & (F.col("predicted") == b)).alias(k) for k, (a, b) in counts.items()),
    )
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return c.select(
        "n", *counts, F.round(F.try_divide(tp, tp + fp), 6).alias("precision"),
        F.round(F.try_divide(tp, tp + fn), 6).alias("recall"),
        F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
    )


#: Of a count-min sketch: an estimate is never too low, and over by more than e / BUCKETS of all rows for one item in e ** ROWS.
CM_ROWS, CM_BUCKETS = 4, 1024


def count_min_cells(item: Column, rows: int = CM_ROWS, buckets: int = CM_BUCKETS) -> Column:
    """The (row, bucket) of an item in each row of the sketch, four hex digits of its MD5 each; rows: eight at most."""
    h = F.md5(item.cast("string").cast("binary"))
    bucket = lambda k: F.conv(F.substring(h, 4 * k + 1, 4), 16, 10).cast("int") % buckets
    return F.array(*(F.struct(F.lit(k).alias("row"), bucket(k).alias("bucket")) for k in range(rows)))


def count_min(items: DataFrame, item: str, rows: int = CM_ROWS, buckets: int = CM_BUCKETS) -> DataFrame:
    """(row, bucket, n): the sketch of a column, rows * buckets counts at most. Each task adds up its own before the shuffle."""
    cells = items.where(F.col(item).isNotNull()).select(F.inline(count_min_cells(F.col(item), rows, buckets)))
    return cells.groupBy("row", "bucket").agg(F.count("*").alias("n"))


def count_min_merged(sketches: list[DataFrame]) -> DataFrame:
    """The sketch of the rows of several."""
    return reduce(DataFrame.unionByName, sketches).groupBy("row", "bucket").agg(F.sum("n").alias("n"))


def count_min_estimates(sketch: DataFrame, items: DataFrame, item: str, rows: int = CM_ROWS, buckets: int = CM_BUCKETS) -> DataFrame:
    """(item, estimate) of each distinct value of a column: the least of its counts over the rows of the sketch, 0 if one is empty."""
    each = items.select(item).where(F.col(item).isNotNull()).distinct()
    at = each.select(item, F.inline(count_min_cells(F.col(item), rows, buckets)))
    found = at.join(F.broadcast(sketch), ["row", "bucket"], "left")  # rows * buckets rows at most
    return found.groupBy(item).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


@query("agg_count_min", f"""WITH h AS (SELECT l_partkey, md5(l_partkey::VARCHAR) AS h FROM lineitem), c AS (SELECT l_partkey, k AS row, ('0x' || substr(h, 4 * k + 1, 4))::INT % {CM_BUCKETS} AS bucket FROM h, range(0, {CM_ROWS}) u(k)),
 s AS (SELECT row, bucket, count(*) AS n FROM c GROUP BY ALL) SELECT l_partkey, min(n)::BIGINT AS estimate FROM (SELECT DISTINCT * FROM c) JOIN s USING (row, bucket) GROUP BY l_partkey""")
def agg_count_min(spark, d) -> DataFrame:
    """How often each part is ordered, from the merged sketches of returned and of other lines."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_returnflag")
    parts = [count_min(li.where(F.col("l_returnflag") == "R"), "l_partkey"), count_min(li.where(~F.col("l_returnflag").eqNullSafe("R")), "l_partkey")]
    return count_min_estimates(count_min_merged(parts), li, "l_partkey")
