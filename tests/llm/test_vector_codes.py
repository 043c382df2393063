import hashlib
import math
import random

import numpy as np
import pytest

from sparkwright.llm import vector_codes as vc
from tests.compare import duck_rows, spark_rows

COLUMNS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error) of each usable row, and the digest, by plain loops."""
    def number(x):
        return max(-vc.MOST, min(vc.MOST, math.floor(1024 * float(np.float32(x)))))

    usable = [(i, [number(x) for x in v], k) for i, v, k in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    usable = [r for r in usable if len(r[1]) == len(usable[0][1])]
    if not usable:
        return [], None
    w = len(usable[0][1]) // parts
    books = [[r[1][p * w : p * w + w] for r in usable[:entries]] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in usable:
                x = v[p * w : p * w + w]
                own.setdefault(near(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    out = []
    for i, v, k in usable:
        found = [near(v[p * w : p * w + w], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), k))
    return (
        [(i, c, e, sum(x[2] for x in out if x[3] == k)) for i, c, e, k in out],
        hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest(),
    )


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, COLUMNS)
    codes, books = vc.compress(df, **kw)
    got = vc.with_label_error(codes).collect()
    want, digest = brute(rows, **kw)
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=lambda r: str(key(r))) == sorted(want, key=lambda r: str(key(r)))
    assert digest is None or vc.digest(books) == digest
    return got


def test_query_equals_sql(spark, sf, duck):
    assert spark_rows(vc.op11_vector_codes(spark, sf)) == duck_rows(duck, vc.SQL)


@pytest.mark.parametrize("spread", [1, 3, 40])
def test_walk_equals_plain_distances(spread):
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread + 1, (5000, 6))
    x = x[vc.sorted_rows(x)]
    book = rng.integers(-spread, spread + 1, (20, 6))
    far = ((x[:, None] - book) ** 2).sum(2)
    seen = 0
    for rows, nearest, distance in vc.walk(x, book):
        assert (nearest == far[rows].argmin(1)).all() and (distance == far[rows].min(1)).all()
        seen += len(nearest)
    assert seen == len(x)


def test_walk_is_exact_beyond_doubles():
    x = np.array([[-vc.MOST, 1, 2, 3], [-vc.MOST, 1, 2, 4], [vc.MOST, 0, 0, 1]])
    book = np.array([[vc.MOST, 0, 0, 0], [vc.MOST, 1, 2, 3]])
    far = ((x[:, None] - book) ** 2).sum(2)
    (_, nearest, distance), = vc.walk(x, book)
    assert (nearest == far.argmin(1)).all() and (distance == far.min(1)).all()


def test_common_beginnings_are_added_once(monkeypatch):
    x = np.array([[1, 2, 3, k] for k in range(100)])
    assert vc.shared_beginnings(x).tolist() == [0] + [3] * 99 + [0]
    seen = []
    plain = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, side: seen.append(len(a)) or plain(a, v, side))
    [*vc.walk(x, np.arange(8).reshape(2, 4))]
    assert seen == [1, 1, 1]  # one node for each of the three shared dimensions


def test_small_tables_by_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)], i % 3) for i in range(60)]
    check(spark, rows, entries=7)
    check(spark, rows * 2 + [(5, rows[0][1], None), (None, rows[1][1], None), (None, None, 2)], entries=5)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    v = [0.5, -0.25, 0.1, 0.0]
    rows = [
        (3, v, 1), (3, v, 1), (1, None, 1), (2, [0.5, None, 0.1, 0.2], 1), (4, [inf, 0.0, 0.0, 0.0], 2), (5, [nan, 0.0, 0.0, 0.0], 2),
        (6, [], None), (7, [1.0, 2.0, 3.0], None), (8, v * 2, None), (None, [9.0, 1e30, -1e30, 0.0], None), (9, [0.1, 0.2, 0.3, 0.4], None),
    ]
    got = check(spark, rows)
    assert len(got) == 4 and {r["vec_id"] for r in got} == {3, None, 9}
    check(spark, rows, entries=1)


def test_a_copy_in_a_third_of_the_rows(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)] if i % 3 else [0.125] * 8, 0) for i in range(300)]
    check(spark, rows, entries=16)
    vectors = vc.scaled(spark.createDataFrame(rows, COLUMNS))
    counted = vc.distinct_parts(vectors, 2).collect()
    assert max(x["n"] for x in counted) == 100 and sum(x["n"] for x in counted) == 4 * 300


def test_empty_and_more_columns(spark):
    empty = spark.createDataFrame([], COLUMNS)
    codes, books = vc.compress(empty)
    out = vc.with_label_error(codes)
    assert out.columns == ["vec_id", "code", "error", "label", "label_error"] and out.count() == 0 and books == []
    clash = spark.createDataFrame([(1, [0.1] * 4, 2)], COLUMNS).selectExpr("*", "'x' AS v", "'y' AS code", "'z' AS part", "'w' AS of")
    assert vc.with_label_error(vc.compress(clash)[0]).first()["code"] == "00000000"
