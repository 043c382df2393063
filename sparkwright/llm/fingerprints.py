"""Document fingerprints: bottom-k sketches of the hashes of a text's five-word shingles.

A sketch is the sorted array of the K least hashes (12 hex digits of MD5) of the distinct shingles of a text: A-Z lower-cased
words [^\\x20\\x09-\\x0D]+, joined by spaces. Sketches merge: the K least of two sketches are those of both texts, so a long text is
sketched in parts of PART shingles, one after the other, and texts of any grouping in `merged`. Two sketches estimate the
resemblance (Jaccard similarity) and the containment of the sets of shingles, and one the number of distinct shingles; up to K
shingles all three are exact.

Everything is built-in functions. An edit takes the beginning of the next document by id: the texts, with their sketches, are shuffled by id once, for two
joins. The first attaches to each id the one before and how much that takes; what it takes goes there, and the second join brings it to the text.

Defined results: a null text is an empty one. A text of fewer words than a shingle has one shingle, all its words; one without words
has an empty sketch, which is like another empty one (1.0) and unlike any other (0.0). Rows with one id share a place in the order of documents; of several, the next document of the place before is
the one with the least of what is taken, then the least fingerprint. Rows without an id share the last place. The last place is followed by the first, so a
single document is followed by itself. Rows that repeat are each returned. Further columns are passed over, whatever their names. An empty table gives an empty result.
A very long text is read whole; its words are held once, and the hashes of one part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, materialize, table

WORDS, K, DIGITS = 5, 128, 12
#: Shingles that are hashed before the least of them are taken, and times k hashes that are sorted of a long text.
PART, SPARE = 65_536, 3
#: Distinct ids that one task puts in order, about.
ORDERED = 1_000_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none() -> Column:
    return F.array().cast("array<string>")


def _least(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def _sketched(w: Column, width: int, k: int, below: Column) -> Column:
    """The k least hashes under a bound of the shingles of the words w, which are taken part by part."""
    last = F.greatest(F.size(w) - width, F.lit(0))

    def shingle_hash(i: Column) -> Column:
        return F.md5(F.concat_ws(" ", *(F.get(w, i + j) for j in range(width))))

    def more(found: Column, at: Column) -> Column:
        own = F.transform(F.sequence(at, F.least(at + PART - 1, last)), shingle_hash)
        low = F.transform(F.filter(own, lambda h: h < below), lambda h: F.substring(h, 1, DIGITS))
        return _least(F.concat(found, low), k)

    return F.aggregate(F.sequence(F.lit(0), last, F.lit(PART)), _none(), more)


def sketch(text: Column, width: int = WORDS, k: int = K) -> Column:
    """The k least hashes of the text's shingles of `width` words, ascending.

    Of a text with more than SPARE * k shingles only hashes under a bound, which about SPARE * k pass, are sorted; where repeats leave
    fewer than k, all are.
    """
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_remove(F.split(lower, r"[\x20\x09-\x0D]+"), "")
    every = F.lit("g")  # after all hex digits

    def whole(w: Column) -> Column:
        many = F.size(w) > SPARE * k
        share = (F.lit(float(SPARE * k) * 16**DIGITS) / F.size(w)).cast("bigint")
        bound = F.when(many, F.lpad(F.lower(F.hex(share)), DIGITS, "0")).otherwise(every)
        low = _let(bound, lambda b: _sketched(w, width, k, b))
        found = _let(low, lambda x: F.when(many & (F.size(x) < k), _sketched(w, width, k, every)).otherwise(x))
        return F.when(F.size(w) == 0, _none()).otherwise(found)

    return _let(words, whole)


def union(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return _least(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of either text that both have: of the union's k least, those in both sketches."""
    both = F.array_intersect(a, b)
    of = _let(union(a, b, k), lambda u: F.size(F.array_intersect(u, both)) / F.greatest(F.size(u), F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(of)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact up to k - 1, and else from how far the k least reach."""
    reach = F.conv(F.get(a, F.lit(k - 1)), 16, 10).cast("double") / float(16**DIGITS)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: the resemblance times the size of the union over the size of a; 1 for an empty a."""
    share = resemblance(a, b, k) * distinct_shingles(union(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(share, F.lit(1.0)))


def packed(a: Column) -> Column:
    """The sketch as one string, DIGITS hex digits a hash."""
    return F.array_join(a, "")


def unpacked(fingerprint: Column) -> Column:
    """The sketch that `packed` made a string of."""
    return F.regexp_extract_all(fingerprint, F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0))


def merged(sketches: DataFrame, by: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """(*by, sketch): the sketch of each group's texts together. Hashes are made distinct and each task hands on k of a group at most, so no hot group meets whole in one."""
    name, rank = fresh(sketches, "hash"), fresh(sketches, "rank")
    each = sketches.select(*map(col, by), F.explode(col(sketch_col)).alias(name)).distinct()
    first = F.row_number().over(Window.partitionBy(*map(col, by)).orderBy(name))
    kept = each.withColumn(rank, first).where(F.col(rank) <= k)
    return kept.groupBy(*map(col, by)).agg(F.array_sort(F.collect_list(name)).alias("sketch"))  # k of a group


def places(ids: DataFrame) -> DataFrame:
    """(id, before, need) of ids(id, need), each id once: the id before it, of the first one the last, and that one's need.

    The ids are dealt by range and put in order range by range; the ends of the ranges, one row for each, give the first of each range the one before.
    """
    parts = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() // ORDERED))
    key = (F.col("id").isNull(), F.col("id"))  # ids before null
    dealt = materialize(ids.repartitionByRange(parts, *key).withColumn("part", F.spark_partition_id()), "places")
    ends = dealt.groupBy("part").agg(F.max_by(F.struct("id", "need"), F.struct(*key)).alias("end"))
    ranges = Window.orderBy("part")
    last = F.last("end").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("part", F.coalesce(F.lag("end").over(ranges), last).alias("end"))
    inside = Window.partitionBy("part").orderBy(*key)
    before = F.coalesce(F.lag(F.struct("id", "need")).over(inside), F.col("end"))
    return dealt.join(F.broadcast(ends), "part").select("id", before.alias("b")).select(
        "id", F.col("b.id").alias("before"), F.col("b.need").alias("need"),
    )


def _key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, own, edited, next) for each row of docs: the text, the edited one, and the fingerprints of the text and of the next document.

    The edited text is the text with its last floor(n / 2) characters replaced by as many, or all, that the next document by id begins with.
    """
    slim = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    order = places(materialize(slim.groupBy("id").agg(F.max(half).alias("need")), "ids"))
    # keys without null let the joins and the grouping share shuffles, in which the fingerprint is binary; both joins read one shuffle of the same columns
    keyed = slim.select(_key("id").alias("key"), F.col("id").isNull().alias("none"), "text", F.unhex(packed(sketch(F.col("text")))).alias("own"))
    order = order.select("before", "need", _key("id").alias("key"), F.col("id").isNull().alias("none"))
    taken = keyed.join(order, ["key", "none"]).select(
        _key("before").alias("key"), F.col("before").isNull().alias("none"), F.left("text", F.col("need")).alias("head"),
        F.col("own").alias("next"),
    )
    heads = taken.groupBy("key", "none").agg(F.min(F.struct("head", "next")).alias("taken")).select("key", "none", "taken.*")
    both = keyed.join(heads, ["key", "none"], "left")
    edited = F.concat(F.left("text", F.char_length("text") - half), F.left("head", half))
    same_id = F.when(~F.col("none"), F.col("key").cast(slim.schema["id"].dataType))
    return both.select(
        same_id.alias("id"), "text", F.lower(F.hex("own")).alias("own"), edited.alias("edited"), F.lower(F.hex("next")).alias("next"),
    )


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, n_chars, the edited text's sha256, both fingerprints, and how like its fingerprint is to the edited text's and the next document's."""
    rows = with_edited(docs, id_col, text_col).select(
        "id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "own", unpacked(F.col("own")).alias("a"), sketch(F.col("edited")).alias("b"), unpacked(F.col("next")).alias("c"),
    )
    a, b = F.col("a"), F.col("b")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", F.col("own").alias("fingerprint"),
        packed(b).alias("edited_fingerprint"), resemblance(a, b).alias("near_edited"),
        resemblance(a, F.col("c")).alias("near_next"), F.round(containment(a, b), 6).alias("kept_share"),
        F.round(distinct_shingles(a), 3).alias("n_shingles"),
    )


def op13_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def _sketch_sql(text: str) -> str:
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+')"
    hashed = f"substr(md5(array_to_string(w[i + 1 : i + {WORDS}], ' ')), 1, {DIGITS})"
    return f"(SELECT coalesce(list_sort(list_distinct(list_transform(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - {WORDS}, 0) + 1 END), lambda i: {hashed})))[1:{K}], []) FROM (SELECT {words} AS w))"


def _near_sql(a: str, b: str) -> str:
    u = f"list_sort(list_distinct(list_concat({a}, {b})))[1:{K}]"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1e0 ELSE len(list_intersect({u}, list_intersect({a}, {b})))::DOUBLE / greatest(len({u}), 1) END"


def _count_sql(a: str) -> str:
    return f"CASE WHEN len({a}) < {K} THEN len({a})::DOUBLE ELSE {K - 1}e0 / (('0x' || {a}[{K}])::BIGINT::DOUBLE / {float(16**DIGITS):.0f}e0) END"


_UNION = f"list_sort(list_distinct(list_concat(a, b)))[1:{K}]"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, length(text) // 2 AS half, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next FROM d),
e AS (SELECT doc_id, text, next, substr(text, 1, length(text) - half) || substr(next, 1, half) AS edited FROM n),
s AS (SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_sketch_sql("text")} AS a, {_sketch_sql("edited")} AS b, {_sketch_sql("next")} AS c FROM e)
SELECT doc_id, n_chars, edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  {_near_sql("a", "b")} AS near_edited, {_near_sql("a", "c")} AS near_next,
  round(CASE WHEN len(a) = 0 THEN 1e0 ELSE least(1e0, ({_near_sql("a", "b")}) * ({_count_sql(_UNION)}) / ({_count_sql("a")})) END, 6) AS kept_share,
  round({_count_sql("a")}, 3) AS n_shingles
FROM s
"""
