import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkwright.llm import fingerprints as fp
from tests.compare import duck_rows, spark_rows
from tests.llm.helpers import COLUMNS, empty, odd, odd_documents, prose


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_sketch(text, k=fp.K):
    return sorted({hashlib.md5(s.encode()).hexdigest()[:12] for s in shingles(text)})[:k]


def brute_near(a, b):
    u = sorted({*a, *b})[: fp.K]
    return len({*u} & {*a} & {*b}) / len(u) if u else 1.0


def brute(docs):
    """(id, n_chars, sha, fingerprint, edited fingerprint, near_edited, near_next) of (id, text), several rows of an id among them."""
    texts = [(i, t or "") for i, t in docs]
    ids = sorted({i for i, _ in texts}, key=lambda i: (i is None, i or 0))
    out = []
    for i, t in texts:
        after = ids[(ids.index(i) + 1) % len(ids)]
        need = max(len(s) // 2 for j, s in texts if j == i)
        head, own = min((s[:need], "".join(brute_sketch(s))) for j, s in texts if j == after)
        half = len(t) // 2
        edited = t[: len(t) - half] + head[:half]
        a, b, c = brute_sketch(t), brute_sketch(edited), re.findall(".{12}", own)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), brute_near(a, b), brute_near(a, c)))
    return sorted(out, key=str)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def result(df):
    return sorted((tuple(r) for r in df.select(NAMES).collect()), key=str)


def test_query_equals_sql(spark, sf, duck):
    assert spark_rows(fp.op13_fingerprints(spark, sf)) == duck_rows(duck, fp.SQL)


def test_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(fp.op13_fingerprints(spark, sf)) == brute(docs)


def test_equal_texts_have_equal_fingerprints(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(fp.op13_fingerprints(spark, sf), "doc_id")
    by = rows.groupBy("text").agg(F.count("*").alias("n"), F.count_distinct("fingerprint").alias("k")).collect()
    assert max(r["n"] for r in by) > 1 and {r["k"] for r in by} == {1}


def test_odd_documents(spark):
    rows = [r[:2] for r in odd_documents()] + [(8, "z " * 20), (11, "Un deux TROIS"), (12, "un deux\ttrois")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("id", "own", "before", "need", "part", "head")})
    assert result(fp.fingerprint_edits(docs)) == brute(rows)
    one = spark.createDataFrame([(5, "a b c d e f")], "doc_id bigint, text string")
    assert result(fp.fingerprint_edits(one)) == brute([(5, "a b c d e f")])
    assert fp.fingerprint_edits(odd(spark)).count() == len(odd_documents())


def test_rows_without_ids(spark):
    rows = [(None, prose(k, 30)) for k in range(20)] + [(1, prose(50, 40))] * 3
    assert result(fp.fingerprint_edits(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)


def test_empty_table(spark):
    out = fp.fingerprint_edits(empty(spark))
    assert out.count() == 0 and out.columns[:7] == NAMES


@pytest.mark.parametrize("part", [7, 128, 65_536])
def test_parts_of_a_long_text_merge(spark, part, monkeypatch):
    monkeypatch.setattr(fp, "PART", part)
    texts = ["", "one", "a b c d e", prose(1, 127 + 4), prose(2, 3000), "x y z " * 900, prose(3, 500) + " " + "q " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["s"] for r in df.select("i", fp.sketch(F.col("text")).alias("s")).collect()}
    assert got == {i: brute_sketch(t) for i, t in enumerate(texts)}


def test_very_long_text(spark):
    text = prose(9, 400_000)
    df = spark.createDataFrame([(1, text), (2, "b")], "doc_id bigint, text string")
    assert result(fp.fingerprint_edits(df)) == brute([(1, text), (2, "b")])


def test_sketches_merge_by_group(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = fp.merged(docs.select("lang", fp.sketch(F.col("text")).alias("hash")), ["lang"], "hash")
    want = {}
    for r in docs.collect():
        want.setdefault(r["lang"], set()).update(hashlib.md5(s.encode()).hexdigest()[:12] for s in shingles(r["text"]))
    assert {r["lang"]: r["sketch"] for r in got.collect()} == {k: sorted(v)[: fp.K] for k, v in want.items()}


def test_estimates_are_near_the_counts(spark):
    r, rows, true = random.Random(7), [], []
    for k in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(1500)]
        cut = 25 * k
        rows.append((k, " ".join(words), " ".join(words[cut:])))
        a, b = shingles(rows[-1][1]), shingles(rows[-1][2])
        true.append((len(a & b) / len(a | b), len(a & b) / len(a), len(a)))
    df = spark.createDataFrame(rows, "k int, x string, y string").select("k", fp.sketch(F.col("x")).alias("a"), fp.sketch(F.col("y")).alias("b"))
    a, b = F.col("a"), F.col("b")
    got = df.select("k", fp.resemblance(a, b), fp.containment(a, b), fp.distinct_shingles(a)).orderBy("k").collect()
    off = [[abs(g[j + 1] - t[j]) for g, t in zip(got, true, strict=True)] for j in range(2)]
    assert all(sum(x) / len(x) < 0.04 and max(x) < 0.18 for x in off)
    assert sum(abs(g[3] - t[2]) / t[2] for g, t in zip(got, true, strict=True)) / len(got) < 0.15


def test_no_python_and_one_shuffle_of_texts(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = fp.op13_fingerprints(spark, sf)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search("Python|Arrow|Pandas", plan) and "ReusedExchange" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
