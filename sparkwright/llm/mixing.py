"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash of its id. Sizes are summed by source and hash bucket; the bucket in
which a source's budget runs out is found and only that bucket is summed again at a finer grain, until one
hash is left. A document takes one more copy if its hash lies under its source's threshold, so nothing is
sorted and larger budgets take supersets of smaller ones.

Defined results: a null source is a source of its own, last in order; an empty or null text has size
0 and takes 0; rows with one id share a hash and are taken together; a null id hashes as an empty
string. With no words at all every target is 0. An empty table gives an empty result. A very long text counts with all its words, and may be
what holds a source's boundary. Documents of one hash are taken together; if taking and leaving the boundary come as near, it is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, materialize, table, word_count

HASH_BITS, LEVEL_BITS = 60, 12


def doc_hash(doc_id: Column) -> Column:
    """The first 60 bits of the md5 of the id as text."""
    return F.conv(
        F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10,
    ).cast("long")


def in_order(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """df with, for each of sums, its sum over the rows before: ranges are dealt out, and the driver adds up one row for each range."""
    spark = df.sparkSession
    ranged = materialize(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    each = ranged.groupBy("part").agg(*(F.sum(c).alias(k) for k, c in sums.items())).orderBy("part").collect()
    rows, so_far = [], dict.fromkeys(sums, 0.0)
    for r in each:
        rows.append((r["part"], *so_far.values()))
        so_far = {k: v + float(r[k]) for k, v in so_far.items()}
    starts = spark.createDataFrame(
        rows or [(0, *so_far.values())], "part int, " + ", ".join(f"start_{k} double" for k in sums),
    )
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = {k: F.coalesce(F.sum(c).over(before), F.lit(0.0)) + F.col(f"start_{k}") for k, c in sums.items()}
    return ranged.join(F.broadcast(starts), "part").withColumns(added).select(*df.columns, *sums)


def source_targets(totals: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """totals(source, source_size) with target: share of all sizes by weight, at most `most` times the size, the excess shared again.

    Sources are capped in the order of cap over weight; the first that its share does not reach gives the level of all the rest.
    """
    placed = in_order(totals, [F.col("source").asc_nulls_last()], {"rank": F.lit(1.0)}, "mix_sources")
    order = F.array(*map(F.lit, weights))
    placed = placed.withColumn(
        "weight", F.get(order, (F.col("rank") % len(weights)).cast("int")).cast("double"),
    ).withColumn("most", most * F.col("source_size")).drop("rank")
    placed = placed.withColumn("ratio", F.col("most") / F.col("weight"))
    whole = placed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    capped = in_order(
        placed, [F.col("ratio").asc(), F.col("source").asc_nulls_last()],
        {"capped": F.col("most"), "used": F.col("weight")}, "mix_weights",
    )
    level = (F.lit(share * (whole["size"] or 0)) - F.col("capped")) / (F.lit(whole["weight"] or 0.0) - F.col("used"))
    found = capped.withColumn(
        "level", level,
    ).where(F.col("level") < F.col("ratio")).agg(F.min_by(
        "level", F.struct("ratio", F.col("source").isNull(), "source"),
    )).first()[0]
    return capped.select(
        "source", "source_size",
        F.least("most", F.lit(float(found) if found is not None else float("inf")) * F.col("weight")).alias("target"),
    )


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with whole copies, and the hash under which a document takes one more."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("copies", copies).withColumn(
        "rest", F.col("target") - F.col("copies") * F.col("source_size"),
    )
    state = state.withColumns({"start": F.lit(0).cast("long"), "below": F.lit(0).cast("long")})
    shift = HASH_BITS
    while shift > 0:
        width, shift = shift, shift - LEVEL_BITS
        state = state.select("source", "source_size", "target", "copies", "rest", "start", "below")
        same = sized["source"].eqNullSafe(state["source"]) & (F.shiftright(sized["hash"], width) == F.shiftright(
            state["start"], width,
        ))
        bucket = F.shiftright(sized["hash"], shift).alias("bucket")
        found = sized.join(state, same).groupBy(state["source"], bucket).agg(
            F.sum("size").alias("size"), F.count_distinct("hash").alias("n"),
        )
        up_to = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))  # 4096 buckets of a source at most
        hist = found.withColumn("up_to", up_to).select(F.col("source").alias("s"), "bucket", "size", "n", "up_to")
        here = state.join(
            hist, state["source"].eqNullSafe(hist["s"]) & (state["below"] + hist["up_to"] > state["rest"]),
        ).groupBy("source").agg(F.min_by(F.struct("bucket", "size", "up_to", "n"), "bucket").alias("b"))
        here = here.select(F.col("source").alias("s"), "b")
        state = state.join(here, state["source"].eqNullSafe(here["s"]), "left").select(
            "source", "source_size", "target", "copies", "rest",
            F.coalesce(F.shiftleft(F.col("b.bucket"), shift), F.lit(1 << HASH_BITS)).alias("start"),
            (F.col("below") + F.coalesce(F.col("b.up_to") - F.col("b.size"), F.lit(0))).alias("below"),
            F.coalesce("b.size", F.lit(0)).alias("size"), F.coalesce("b.n", F.lit(0)).alias("n"))
        state = materialize(state, "mix_state")
        alone = not state.where("n > 1").limit(1).count()
        end = F.col("start") + (1 << shift)
        # what holds the boundary is taken if that comes nearer to the budget
        nearer = (F.col("below") + F.col("size") - F.col("rest")) < (F.col("rest") - F.col("below"))
        if alone:
            break
    return state.select(
        "source", "source_size", "target", "copies", F.when(nearer, end).otherwise(F.col("start")).alias("threshold"),
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """One row for each row of docs: id, source, size, source_size, target, copies and taken (words, repeats counted)."""
    sized = docs.select(
        col(id_col).alias("doc_id"), col(source_col).alias("source"), word_count(col(text_col)).alias("size"),
    )
    sized = materialize(sized.withColumn("hash", doc_hash(F.col("doc_id"))), "mix_sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    state = thresholds(sized, source_targets(totals, weights, share, most)).withColumnRenamed("source", "s")
    n = F.col("copies") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    done = sized.join(state, sized["source"].eqNullSafe(state["s"])).withColumn("n", n)
    return done.select(
        F.col("doc_id").alias(id_col), "source", "size", "source_size", "target", F.col("n").alias("copies"),
        (F.col("n") * F.col("size")).alias("taken"),
    )


def apply_mix(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The rows of docs that the mix takes, with copies and taken (words) added under names that docs does not have."""
    n, taken = fresh(docs, "copies"), fresh(docs, "taken")
    key = fresh(docs, "mix_id")
    mixed = mix(docs, id_col, **kw).select(
        F.col(id_col).alias(key), F.col("source").alias(f"{key}_source"), F.col("copies").alias(n),
        F.col("taken").alias(taken),
    )
    mixed = mixed.groupBy(key, f"{key}_source").agg(F.max(n).alias(n))  # rows with one id and source have one number of copies
    same = col(id_col).eqNullSafe(F.col(key)) & col(kw.get("source_col", "source")).eqNullSafe(F.col(f"{key}_source"))
    out = docs.join(mixed, same).where(F.col(n) > 0)
    return out.select(
        *map(col, docs.columns), F.col(n), (F.col(n) * word_count(col(kw.get("text_col", "text")))).alias(taken),
    )


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT source, source_size, [3e0, 1e0, 2e0][(r % 3 + 1)::INT] AS weight, 2e0 * source_size AS most FROM t),
o AS (SELECT *, 1.5e0 * sum(source_size) OVER () AS budget, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS k FROM w),
c AS (SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
lv AS (SELECT coalesce(min_by(level, k), 0e0) AS level FROM c WHERE level * weight < most),
g AS (SELECT source, source_size, least(most, lv.level * weight) AS target FROM w, lv),
s AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM g),
h AS (SELECT source, hash, sum(size)::BIGINT AS size FROM d GROUP BY source, hash),
u AS (SELECT h.*, sum(h.size) OVER (PARTITION BY h.source ORDER BY hash) AS up_to, s.target - s.copies * s.source_size AS rest FROM h JOIN s ON h.source IS NOT DISTINCT FROM s.source),
x AS (SELECT source, hash, up_to <= rest OR (up_to - size <= rest AND up_to - rest < rest - (up_to - size)) AS more FROM u)
SELECT d.doc_id, d.size, s.source_size, s.target, (d.size * (s.copies + x.more::INT))::BIGINT AS taken
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.hash = x.hash
"""
