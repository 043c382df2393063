import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkwright.llm import filter_audit as fa
from tests.compare import duck_rows, spark_rows
from tests.llm.helpers import COLUMNS, empty, odd, odd_documents, prose

LABELS = "doc_id bigint, quality int, toxic int"


def failures(docs):
    """For each of (id, text): its failures, by the words of the contract."""
    out = []
    for i, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [j for j, s in docs if (s or "") == t]
        smaller = any(j is not None for j in same) if i is None else any(j is not None and j < i for j in same)
        out.append({
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": smaller,
        })
    return out


def brute(docs, labels):
    """The whole result of (id, text, lang) and (id, quality, toxic), each order applied filter by filter."""
    marks = failures([(i, t) for i, t, _ in docs])
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = set()
    for part in {lang or "" for _, _, lang in docs}:
        own = [(i, m) for (i, _, lang), m in zip(docs, marks, strict=True) if (lang or "") == part]
        rows, shared = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if x[1][f]], [x for x in left if not x[1][f]]
                shared[f] += len(gone)
                rows.append((
                    "".join(order), step, f, len(left), len(gone), sum(m[f] for _, m in own) - len(gone), sum(m[f] and sum(m.values()) == 1 for _, m in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ))
        out |= {(part, o, s, *rest, shared[f]) for o, s, f, *rest in rows}
    return out


def result(df):
    return {tuple(r) for r in df.select([x.split()[0] for x in fa.RESULT.split(", ")]).collect()}


def test_query_equals_sql(spark, sf, duck):
    assert spark_rows(fa.op12_filter_audit(spark, sf)) == duck_rows(duck, fa.SQL)


def test_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    got = fa.op12_filter_audit(spark, sf)
    assert result(got) == brute(docs, labels) and got.count() == 600 * len({x[2] for x in docs})


def test_odd_documents_and_labels(spark):
    shout = "THE #1 " * 120 + prose(3, 300)
    more = [(20, shout, None, "a", 1), (21, shout, "", "a", 1), (22, prose(4, 250), "en", "a", 1), (None, prose(4, 250), "en", "a", 1), (23, "a b " * 200, "en", "a", 1)]
    rows = odd_documents() + more
    labels = [(20, 1, 1), (20, 0, None), (22, 1, 0), (None, 1, 1), (8, None, 1), (99, 1, 1)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("clash") for c in ("mask", "part", "key", "id", "first")})
    counts = fa.failure_counts(docs, spark.createDataFrame(labels, LABELS).withColumn("part", F.lit(1)))
    assert result(fa.filter_audit(counts)) == brute([r[:3] for r in rows], labels)
    assert sum(r["n"] for r in counts.collect()) == len(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    out = fa.filter_audit(fa.failure_counts(empty(spark), none))
    assert out.count() == 0 and out.columns == [x.split()[0] for x in fa.RESULT.split(", ")]
    assert {r["good_lost"] for r in fa.filter_audit(fa.failure_counts(odd(spark), none)).collect()} == {0}


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for k in fa.swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_a_swap_keeps_every_count():
    r = random.Random(4)
    counts = {m: (r.randint(0, 3), r.randint(0, 1), 0) for m in range(16) if r.random() < 0.7}
    diagram = fa.Diagram(counts, 4, 3)
    for k in [None, *fa.swaps(4)]:
        if k is not None:
            diagram.swap(k)
        for mask in range(16):
            at = diagram.root
            for depth, which in enumerate(diagram.order):
                at = diagram.levels[depth][at][mask >> which & 1]
            assert tuple(diagram.weight[4][at]) == counts.get(mask, (0, 0, 0))
        assert all(len(set(level)) == len(level) for level in diagram.levels[1:])


def test_equal_nodes_are_one():
    diagram = fa.Diagram(dict.fromkeys(range(32), (1, 0, 0)), 5, 3)
    assert [len(level) for level in diagram.levels] == [1] * 5 and diagram.weight[0][0].tolist() == [32, 0, 0]
