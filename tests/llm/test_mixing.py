import hashlib
from collections import defaultdict

import pytest

from sparkwright.llm import mixing
from tests.compare import duck_rows, spark_rows
from tests.llm.helpers import empty, odd, prose


def brute(rows, weights=(3, 1, 2), share=1.5, most=2.0):
    """(id, source, size) to taken words by source, by sorting."""
    size = defaultdict(int)
    for _, s, n in rows:
        size[s] += n
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, level = set(), 0
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            break
        level = (share * sum(size.values()) - sum(most * size[s] for s in capped)) / sum(w[s] for s in free)
        new = {s for s in free if most * size[s] <= level * w[s]}
        if not new:
            break
        capped |= new
    target = {s: min(most * size[s], level * w[s]) for s in names}
    taken = defaultdict(int)
    for s in names:
        copies = int(target[s] // size[s]) if size[s] else 0
        rest = target[s] - copies * size[s]
        by = defaultdict(int)
        for i, k, n in rows:
            if k == s:
                by[hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15]] += n
        below = 0
        for h in sorted(by):
            if below + by[h] <= rest or below + by[h] - rest < rest - below:
                below += by[h]
            if below + by[h] > rest:
                break
        taken[s] = copies * size[s] + below
    return target, taken


def check(df):
    got = mixing.mix(df).collect()
    rows = [(r["doc_id"], r["source"], r["size"]) for r in got]
    target, _ = brute(rows)
    taken = defaultdict(int)
    largest = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], sum(n for i, s, n in rows if (i, s) == (r["doc_id"], r["source"])))
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6
    return got


def test_query_equals_sql(spark, sf, duck):
    assert spark_rows(mixing.op6_mixing(spark, sf)) == duck_rows(duck, mixing.SQL)


def test_odd_documents(spark):
    got = check(odd(spark, "size hash bucket s target copies taken start"))
    assert len(got) == 13


def test_many_documents_need_finer_buckets(spark):
    rows = [(i, prose(i, 1 + i % 9), "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(7)).collect()}
    assert {r["doc_id"]: r["taken"] for r in check(df)} == again


def test_no_rows_and_no_words(spark):
    assert mixing.mix(empty(spark)).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert {(r["target"], r["taken"]) for r in mixing.mix(none).collect()} == {(0.0, 0)}


def test_apply_keeps_columns(spark):
    df = odd(spark, "copies taken mix_id")
    out = mixing.apply_mix(df)
    assert out.columns == [*df.columns, "copies_", "taken_"]
    want = defaultdict(int)
    for r in mixing.mix(odd(spark)).collect():
        want[r["doc_id"]] += r["taken"]
    got = defaultdict(int)
    for r in out.collect():
        got[r["doc_id"]] += r["taken_"]
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
