"""Scalar functions by family, and the UDF surface."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import query
from ..sources.tables import table


@query("fn_string", """SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, substr(c_name, 3, 5) AS part, lpad(c_custkey::VARCHAR, 8, '0') AS padded, length(c_name)::INT AS len,
 concat_ws('-', c_mktsegment, c_nationkey::VARCHAR) AS joined, trim('  ' || c_mktsegment || ' ') AS trimmed, reverse(c_name) AS back, replace(c_name, 'C', 'K') AS swapped,
 instr(c_name, '#')::INT AS at, translate(c_mktsegment, 'AEIOU', '12345') AS coded, split_part(c_name, '#', 2) AS tail, levenshtein(c_mktsegment, 'BUILDINGS')::INT AS dist,
 starts_with(c_name, 'Cust') AS starts, repeat('x', c_nationkey % 4) AS xs FROM customer""")
def fn_string(spark, d) -> DataFrame:
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        "c_custkey", F.lower(n).alias("low"), F.upper(m).alias("up"), F.substring(n, 3, 5).alias("part"), F.lpad(
            F.col("c_custkey").cast("string"), 8, "0",
        ).alias("padded"), F.length(n).alias("len"),
        F.concat_ws(
            "-", m, F.col("c_nationkey").cast("string"),
        ).alias("joined"), F.trim(F.concat(
            F.lit("  "), m, F.lit(" "),
        )).alias("trimmed"), F.reverse(n).alias("back"), F.replace(n, F.lit("C"), F.lit("K")).alias("swapped"),
        F.instr(n, "#").alias("at"), F.translate(m, "AEIOU", "12345").alias("coded"), F.split_part(
            n, F.lit("#"), F.lit(2),
        ).alias("tail"), F.levenshtein(m, F.lit("BUILDINGS")).alias("dist"),
        F.startswith(n, F.lit("Cust")).alias("starts"), F.expr("repeat('x', c_nationkey % 4)").alias("xs"))


@query("fn_string_more", """SELECT c_custkey, list_aggregate(list_transform(string_split(lower(c_mktsegment), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS titled, substr(c_name, 1, 2) || '##' || substr(c_name, 5) AS laid_over,
 url_decode(url_encode(c_name)) AS again, left(c_name, 4) AS first4, right(c_name, 3) AS last3, ascii(c_mktsegment)::INT AS code, rpad(c_mktsegment, 12, '.') AS padded, length(c_name) - length(replace(c_name, '0', '')) AS zeros FROM customer""")
def fn_string_more(spark, d) -> DataFrame:
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        "c_custkey", F.initcap(m).alias("titled"), F.overlay(
            n, F.lit("##"), 3,
        ).alias("laid_over"), F.url_decode(F.url_encode(n)).alias("again"), F.left(
            n, F.lit(4),
        ).alias("first4"), F.right(n, F.lit(3)).alias("last3"),
        F.ascii(m).alias("code"), F.rpad(
            m, 12, ".",
        ).alias("padded"), (F.length(n) - F.length(F.replace(n, F.lit("0"), F.lit("")))).cast("bigint").alias("zeros"))


@query("fn_regex", r"""SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)', 2) AS host, len(regexp_extract_all(url, '[0-9]+'))::INT AS numbers, regexp_replace(url, '[0-9]+', '#', 'g') AS masked,
 regexp_matches(url, 'page=[0-9]+') AS paged FROM pages""")
def fn_regex(spark, d) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract(u, "^(https?)://([^/]+)", 2).alias("host"),
        F.regexp_count(u, F.lit("[0-9]+")).alias("numbers"), F.regexp_replace(u, "[0-9]+", "#").alias("masked"),
        u.rlike("page=[0-9]+").alias("paged"),
    )


@query("fn_date", """SELECT o_orderkey, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS dom, (dayofweek(o_orderdate) + 1)::INT AS dow, dayofyear(o_orderdate)::INT AS doy,
 weekofyear(o_orderdate)::INT AS w, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS days, date_trunc('month', o_orderdate)::TIMESTAMP AS month_start,
 last_day(o_orderdate)::DATE::VARCHAR AS month_end, (o_orderdate::DATE + 30)::DATE::VARCHAR AS due, strftime(o_orderdate, '%Y-%m') AS label FROM orders""")
def fn_date(spark, d) -> DataFrame:
    t = F.col("o_orderdate")
    day = t.cast("date")
    parts = {
        "y": F.year(t), "q": F.quarter(t), "m": F.month(t), "dom": F.dayofmonth(t), "dow": F.dayofweek(t),
        "doy": F.dayofyear(t), "w": F.weekofyear(t),
    }
    return table(spark, d, "orders").select(
        "o_orderkey", *(c.alias(k) for k, c in parts.items()), F.datediff(
            day, F.lit("1995-01-01").cast("date"),
        ).alias("days"), F.date_trunc("month", t).cast("timestamp_ntz").alias("month_start"),
        F.last_day(day).cast("string").alias("month_end"), F.date_add(
            day, 30,
        ).cast("string").alias("due"), F.date_format(t, "yyyy-MM").alias("label"))


@query("fn_math", """SELECT p_partkey, round(p_retailprice, 1) AS r1, round(ln(p_retailprice), 9) AS ln, round(log2(p_retailprice), 9) AS l2, ceil(p_retailprice)::BIGINT AS up, floor(p_retailprice)::BIGINT AS down,
 (p_partkey % 7)::BIGINT AS rest, (p_partkey // 7)::BIGINT AS whole, round(sqrt(p_retailprice), 9) AS root, abs(p_size - 25)::INT AS off, sign(p_size - 25)::DOUBLE AS sgn, round(p_retailprice ** 2, 4) AS sq,
 greatest(p_size, 10)::INT AS hi, least(p_size, 10)::INT AS lo, p_retailprice / nullif(p_size % 5, 0) AS per FROM part""")
def fn_math(spark, d) -> DataFrame:
    x, k, s = F.col("p_retailprice"), F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", F.round(x, 1).alias("r1"), F.round(F.ln(x), 9).alias("ln"), F.round(
            F.log2(x), 9,
        ).alias("l2"), F.ceil(x).alias("up"), F.floor(x).alias("down"), (k % 7).alias("rest"), F.expr("p_partkey div 7").alias("whole"),
        F.round(F.sqrt(x), 9).alias("root"), F.abs(s - 25).alias("off"), F.signum(s - 25).alias("sgn"), F.round(
            F.pow(x, F.lit(2.0)), 4,
        ).alias("sq"), F.greatest(
            s, F.lit(10),
        ).alias("hi"), F.least(s, F.lit(10)).alias("lo"), F.try_divide(x, s % 5).alias("per"))


def rounded(x: Column, places: int) -> Column:
    """A double rounded as in SQL engines in C, by its multiple in binary and with the sign of a zero kept; F.round goes by the shortest decimal digits, and has no -0.0."""
    return F.signum(x) * F.round(F.abs(x) * F.lit(10.0**places)) / F.lit(10.0**places)


@query(
    "fn_array",
    """SELECT vec_id, v[1:3] AS head, len(list_filter(v, lambda x: x > 0))::INT AS n_positive, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm2, list_contains(range(5), vec_id % 7) AS has, list_max(v) AS top, list_min(v) AS least FROM (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 4)) AS v FROM embeddings)""",
)
def fn_array(spark, d) -> DataFrame:
    v = F.col("v")
    e = table(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: rounded(x.cast("double"), 4)).alias("v"),
    )
    norm2 = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    return e.select(
        "vec_id", F.slice(v, 1, 3).alias("head"), F.size(F.filter(v, lambda x: x > 0)).alias("n_positive"),
        rounded(norm2, 6).alias("norm2"),
        F.array_contains(F.sequence(F.lit(0), F.lit(4)), (F.col("vec_id") % 7).cast("int")).alias("has"),
        F.array_max(v).alias("top"), F.array_min(v).alias("least"),
    )


@query(
    "fn_map",
    "SELECT o_custkey, list_sort(list(o_orderkey)) AS orders, sum(length(o_orderpriority))::BIGINT AS letters FROM orders GROUP BY o_custkey",
)
def fn_map(spark, d) -> DataFrame:
    """Maps arise in between: each customer's orders to the lengths of their priorities, doubled, filtered and summed."""
    m = F.map_from_entries(F.collect_list(F.struct("o_orderkey", F.length("o_orderpriority").alias("n"))))
    g = table(spark, d, "orders").groupBy("o_custkey").agg(m.alias("m")).withColumn(
        "twice", F.transform_values("m", lambda k, v: v * 2),
    )
    kept = F.map_filter("twice", lambda k, v: v > 0)
    letters = F.aggregate(F.map_values(kept), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return g.select(
        "o_custkey", F.array_sort(F.map_keys("m")).alias("orders"), letters.alias("twice_letters"),
    ).select("o_custkey", "orders", F.expr("twice_letters div 2").alias("letters"))


@query(
    "fn_map_more",
    """SELECT event_id, (user_id % 5)::BIGINT AS a, (user_id % 7)::BIGINT AS b, 3::INT AS n FROM events""",
)
def fn_map_more(spark, d) -> DataFrame:
    one = F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.col("user_id") % 5, F.col("user_id") % 7))
    both = table(spark, d, "events").select(
        "event_id", F.map_concat(one, F.create_map(F.lit("c"), F.lit(0).cast("bigint"))).alias("m"),
    )
    return both.select(
        "event_id", F.element_at("m", "a").alias("a"), F.element_at("m", "b").alias("b"), F.cardinality("m").alias("n"),
    )


@query("fn_array_more", """SELECT vec_id, list_transform(range(1, 4), lambda i: round(v[i] + v[i + 3], 6)) AS sums, list_sort(list_intersect(range(0, 6), [vec_id % 9, vec_id % 4])) AS shared,
 len(list_intersect(range(0, 3), [vec_id % 5])) > 0 AS meets, flatten([v[1:2], v[3:4]]) AS flat, list_distinct([vec_id % 3, vec_id % 3, 9])::BIGINT[].len()::INT AS kinds, list_position([5, 6, 7], vec_id % 9)::BIGINT AS at
 FROM (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 4)) AS v FROM embeddings)""")
def fn_array_more(spark, d) -> DataFrame:
    v, k = F.col("v"), F.col("vec_id")
    e = table(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: rounded(x.cast("double"), 4)).alias("v"),
    )
    up_to = lambda n: F.sequence(F.lit(0).cast("bigint"), F.lit(n).cast("bigint"))
    return e.select(
        "vec_id", F.zip_with(F.slice(v, 1, 3), F.slice(v, 4, 3), lambda x, y: rounded(
            x + y, 6,
        )).alias("sums"), F.array_sort(F.array_intersect(up_to(5), F.array(k % 9, k % 4))).alias("shared"),
        F.arrays_overlap(
            up_to(2), F.array(k % 5),
        ).alias("meets"), F.flatten(F.array(
            F.slice(v, 1, 2), F.slice(v, 3, 2),
        )).alias("flat"), F.size(F.array_distinct(F.array(k % 3, k % 3, F.lit(9)))).alias("kinds"),
        F.nullif(
            F.array_position(F.array(F.lit(5), F.lit(6), F.lit(7)).cast("array<bigint>"), k % 9), F.lit(0),
        ).alias("at"))


@query("fn_json", "SELECT event_id, (props ->> '$.k')::INT AS k, (props ->> '$.missing') AS missing FROM events")
def fn_json(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.get_json_object("props", "$.missing").alias("missing"),
    )


@query("fn_variant", "SELECT event_id, (props ->> '$.k')::INT AS k FROM events")
def fn_variant(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


@query("fn_hash", "SELECT c_custkey, md5(c_name) AS md5, sha256(c_name) AS sha FROM customer")
def fn_hash(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(
        "c_custkey", F.md5("c_name").alias("md5"), F.sha2("c_name", 256).alias("sha"),
    )


@query(
    "fn_url",
    r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages",
)
def fn_url(spark, d) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", F.parse_url(u, F.lit("HOST")).alias("host"), F.parse_url(u, F.lit("PROTOCOL")).alias("scheme"),
        F.parse_url(u, F.lit("QUERY"), F.lit("page")).alias("page"),
    )


@query(
    "fn_null",
    "SELECT event_id, coalesce(nullif(event_type, 'view'), 'seen') AS kind, (value IS NULL) AS missing, ifnull(nullif(user_id % 3, 0), -1)::BIGINT AS third FROM events",
)
def fn_null(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("seen")).alias("kind"),
        F.col("value").isNull().alias("missing"),
        F.ifnull(F.nullif(F.col("user_id") % 3, F.lit(0)), F.lit(-1)).alias("third"),
    )


@F.arrow_udf(T.DoubleType())
def with_tax(price: pa.Array, tax: pa.Array) -> pa.Array:
    return pc.multiply(price, pc.add(tax, 1.0))


@query(
    "udf_scalar",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice * (1 + l_tax), 6) AS gross FROM lineitem",
)
def udf_scalar(spark, d) -> DataFrame:
    """A vectorised function over Arrow batches; Catalyst still prunes the scan to its columns."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.round(with_tax("l_extendedprice", "l_tax"), 6).alias("gross"),
    )


def _partial_users(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, last id and largest value by user and batch."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by("user_id").aggregate([
            ("event_id", "count"), ("event_id", "max"), ("value", "max"),
        ])
        yield from t.select([
            "user_id", "event_id_count", "event_id_max", "value_max",
        ]).rename_columns(["user_id", "n", "last_id", "top"]).to_batches()


@query(
    "map_partitions",
    "SELECT user_id, count(*)::BIGINT AS n, max(event_id)::BIGINT AS last_id, max(value) AS top FROM events GROUP BY user_id",
)
def map_partitions(spark, d) -> DataFrame:
    """Partial sums by batch in Arrow, merged by Spark: no user's rows are gathered anywhere."""
    part = table(spark, d, "events").select("user_id", "event_id", "value").mapInArrow(
        _partial_users, "user_id bigint, n bigint, last_id bigint, top double",
    )
    return part.groupBy("user_id").agg(
        F.sum("n").alias("n"), F.max("last_id").alias("last_id"), F.max("top").alias("top"),
    )


@query(
    "udf_agg",
    "SELECT event_type, count(*)::BIGINT AS n, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY event_type",
)
def udf_agg(spark, d) -> DataFrame:
    """A custom aggregate with partial states: each batch gives count, mean and mean square of a type, and a grouped Arrow function merges the states, not the rows."""
    states = table(spark, d, "events").select("event_type", "value").mapInArrow(
        _partial_moments, "event_type string, n bigint, square double",
    )
    merged = states.groupBy("event_type").agg(
        merged_square("n", "square").alias("square"), merged_count("n").alias("n"),
    )
    return merged.select("event_type", "n", F.round(F.sqrt("square"), 6).alias("rms"))


def _partial_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A state for each type of a task: its rows and their mean square."""
    states: dict[str, tuple[int, float]] = {}
    for b in batches:
        t = pa.table({
            "k": b.column(0), "sq": pc.multiply(b.column(1), b.column(1)),
        }).group_by("k").aggregate([("sq", "count"), ("sq", "sum")])
        for k, n, total in zip(*(t.column(c).to_pylist() for c in ("k", "sq_count", "sq_sum")), strict=True):
            had, mean = states.get(k, (0, 0.0))
            states[k] = (had + n, mean + ((total or 0.0) - n * mean) / max(1, had + n))
    if states:
        kinds, rows = list(states), list(states.values())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kinds, pa.string()), pa.array([n for n, _ in rows], pa.int64()),
                pa.array([x for _, x in rows], pa.float64()),
            ],
            ["event_type", "n", "square"],
        )


@F.pandas_udf(T.DoubleType())
def merged_square(n: pd.Series, square: pd.Series) -> float:
    """One state out of those of all tasks, of which there is one for each task and type."""
    return float((n * square).sum() / max(1, n.sum()))


@F.pandas_udf(T.LongType())
def merged_count(n: pd.Series) -> int:
    return int(n.sum())


@query(
    "udtf",
    r"SELECT item_id, len(w)::INT AS n, list_sort(list_distinct(list_filter(w, lambda x: length(x) > 6))) AS longest FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark)",
)
def udtf(spark, d) -> DataFrame:
    """A Python table function, called by LATERAL: rows out of each passage, grouped again by Spark."""

    class Words:
        def eval(self, text: str) -> Iterator[tuple[str, bool]]:
            import regex

            for w in regex.findall(r"[\p{L}\p{N}]+", (text or "").lower()):
                yield w, len(w) > 6

    spark.udtf.register("sparkwright_words", F.udtf(Words, returnType="word string, is_long boolean"))
    table(spark, d, "benchmark").createOrReplaceTempView("sparkwright_benchmark")
    words = spark.sql("SELECT item_id, t.word, t.is_long FROM sparkwright_benchmark, LATERAL sparkwright_words(text) t")
    return words.groupBy("item_id").agg(
        F.count("*").cast("int").alias("n"),
        F.array_sort(F.collect_set(F.when(F.col("is_long"), F.col("word")))).alias("longest"),
    )


@query(
    "udtf_words",
    r"SELECT item_id, unnest(range(len(w)))::INT AS place, unnest(w) AS word FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark)",
)
def udtf_words(spark, d) -> DataFrame:
    """The built-in generator, which stays in the JVM."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return table(spark, d, "benchmark").select("item_id", F.posexplode(words).alias("place", "word"))
