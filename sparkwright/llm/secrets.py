"""Secret scans over a trigram inverted index, in DataFrame operations alone.

Each rule's regular expression gives a Boolean trigram query. The index has a posting for each document and
each trigram that some rule asks for; the postings of a clause are intersected by document, and
only the candidates are verified by the expression itself. A rule without mandatory trigrams scans every document. The lengths of the
matches and of what stands between them become rows, and a running sum over a text's rows gives the positions.

Defined results: a null or empty text has no spans. Rows that repeat an id are each scanned by their own text. A null id
is carried as null. Spans of one start are ordered by the rules' order. Other columns are passed over. An empty table gives an empty
result. Positions are code points, the end exclusive. A very long text is scanned whole, and its work grows with its length and matches.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialize, table
from .trigram import ANY, trigram_query


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: A match counts if this group of it has so many characters.
    group: int = 0
    least: int = 1


#: Fixed values, in order: the three base rules first.
RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # the runs of 32 or more, as a run is matched whole
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("url_login", r"[a-z0-9]://[^\x09-\x0D\x20/@:]+:[^\x09-\x0D\x20/@:]+@"),
)
SPANS, STEPS = "array<struct<start:int,rank:int,end:int,kind:string>>", "array<struct<rank:int,gap:int,length:int,judged:int>>"


def _clauses(rules: tuple[Rule, ...]) -> list[tuple[int, int, int, int, str]]:
    """(rule, clause, trigrams in the clause, place, trigram); a clause keeps 60 trigrams at most, which loosens it."""
    out = []
    for r, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        for k, clause in enumerate(sorted(map(sorted, query - ANY)) if not ANY <= query else ()):
            out += [(r, k, min(60, len(clause)), i, t) for i, t in enumerate(clause[:60])]
    return out


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """docs(doc_id, text) to postings (trigram, doc_id, text_key) of the wanted trigrams."""
    low = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select(F.explode(held).alias("trigram"), "doc_id", "text_key")


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text_key, rules): the documents of docs(doc_id, text) that some rule's query lets through."""
    spark, clauses = docs.sparkSession, _clauses(rules)
    wanted = spark.createDataFrame(
        clauses or [(0, 0, 0, 0, "")], "rule int, clause int, n int, place int, trigram string",
    ).where("n > 0")
    postings = materialize(trigram_index(docs, sorted({x[-1] for x in clauses})), "trigram_postings")
    met = postings.join(F.broadcast(wanted), "trigram").groupBy(
        "doc_id", "text_key", "rule", "clause", "n",
    ).agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("places"))
    full = met.where(F.col("places") == F.expr("shiftleft(1L, n) - 1"))
    return full.groupBy("doc_id", "text_key").agg(F.collect_set("rule").alias("rules"))


def _steps(text: Column, rank: int, rule: Rule) -> Column:
    """For each match of a rule the lengths of what stands before it, of itself, and of the group that is judged."""
    pattern = F.lit(rule.pattern)
    found, parts = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    zipped = F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("p"), found.alias("m"), judged.alias("g"))
    return F.transform(zipped, lambda x: F.struct(
        F.lit(rank).alias("rank"), F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("length"),
        F.length(x["g"]).alias("judged"),
    ))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row for each row of docs: its id and spans, an array of (start, rank, end, kind) in order."""
    slim = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    listed = candidates(slim, rules).select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"), "rules")
    joined = slim.withColumn("text_key", F.xxhash64("text")).join(
        listed, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key")), "left",
    )
    indexed = {x[0] for x in _clauses(rules)}
    text, none = F.col("text"), F.array().cast(STEPS)
    per_rule = [F.when(F.array_contains("rules", r) if r in indexed else F.lit(True), _steps(text, r, rule)).otherwise(none) for r, rule in enumerate(rules)]
    scanned = materialize(joined.select("doc_id", "text_key", F.concat(*per_rule).alias("steps")), "secret_steps")
    rows = scanned.where(F.size("steps") > 0).dropDuplicates(["doc_id", "text_key"]).select(
        "doc_id", "text_key", F.posexplode("steps").alias("i", "s"),
    ).select("doc_id", "text_key", "i", "s.*")
    place = Window.partitionBy("doc_id", "text_key", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ended = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(place).cast("int"))
    known = F.create_map(*(x for r, rule in enumerate(rules) for x in (F.lit(r), F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least")))))
    ended = ended.withColumn("rule", F.element_at(known, F.col("rank"))).where(F.col("judged") >= F.col("rule.least"))
    span = F.struct((F.col("end") - F.col("length")).alias("start"), "rank", "end", F.col("rule.kind").alias("kind"))
    found = ended.groupBy(
        F.col("doc_id").alias("f_id"), F.col("text_key").alias("f_key"),
    ).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    out = scanned.select("doc_id", "text_key").join(
        found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key")), "left",
    )
    return out.select(F.col("doc_id").alias(id_col), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long").alias(f"n_{RULES[k].kind}")

    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.select(
        "doc_id", *map(count, range(3)), F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    each = "\nUNION ALL ".join(
        f"SELECT doc_id, {r} AS rank, {quote(x.kind)} AS kind, {x.least} AS least, regexp_extract_all(t, {quote(x.pattern)}, 0) AS m, regexp_extract_all(t, {quote(x.pattern)}, {x.group}) AS g, string_split_regex(t, {quote(x.pattern)}) AS p FROM d"
        for r, x in enumerate(RULES)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({each}),
u AS (SELECT doc_id, rank, kind, least, unnest(m) AS m, unnest(g) AS g, unnest(p[1:len(m)]) AS p, unnest(range(len(m))) AS i FROM r WHERE len(m) > 0),
w AS (SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS e FROM u),
s AS (SELECT doc_id, rank, e - length(m) AS b, kind || ':' || (e - length(m))::BIGINT || ':' || e::BIGINT AS x FROM w WHERE length(g) >= least),
a AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  string_agg(x, ',' ORDER BY b, rank) FILTER (WHERE rank < 3) AS base, string_agg(x, ',' ORDER BY b, rank) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


SQL = _sql()
