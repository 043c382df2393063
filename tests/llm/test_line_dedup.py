import hashlib
from collections import defaultdict

from sparkwright.llm import line_dedup
from tests.compare import duck_rows, spark_rows
from tests.llm.helpers import empty, odd, odd_documents

WHITE = " \t\n\x0b\x0c\r"


def brute(docs, min_chars=20, min_docs=3):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))

    held = defaultdict(set)
    for i, t, *_ in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars and i is not None:
                held[key(x)].add(i)
    out = []
    for i, t, *_ in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or i == max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_query_equals_sql(spark, sf, duck):
    assert spark_rows(line_dedup.op1_line_dedup(spark, sf)) == duck_rows(duck, line_dedup.SQL)


def test_odd_documents(spark):
    shared = "  This Line is shared by all of them\t"
    docs = odd_documents() + [(20 + k, f"{shared}\nown line number {k} of the text\n{shared.upper()}", "en", "a", 1) for k in range(4)] + [(None, shared, None, None, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(map(tuple, line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str)
    assert got == brute(docs)
    assert (23, 3, 0) in {g[:3] for g in got} and (None, 1, 1) in {g[:3] for g in got}


def test_columns_are_kept_and_may_clash(spark):
    df = odd(spark, "key drops line_dedup n_lines holder")
    out = line_dedup.apply_line_dedup(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_digest(spark, sf):
    r = line_dedup.op1_line_dedup(spark, sf).join(line_dedup.dedup_lines(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "kept_text"), "doc_id").first()
    assert r["kept_sha256"] == hashlib.sha256(r["kept_text"].encode()).hexdigest()


def test_rows_without_an_id_are_each_rewritten(spark):
    shared = "this line is in many of the documents"
    rows = [(k, f"{shared}\nown {k}") for k in range(4)] + [(None, f"{shared}\nnone {k}") for k in range(50)] + [(None, f"{shared}\nnone 1")]
    got = line_dedup.apply_line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r["text"] for r in got if r["doc_id"] is None) == sorted([f"none {k}" for k in range(50)] + ["none 1"])
    assert sum(shared in r["text"] for r in got) == 1
