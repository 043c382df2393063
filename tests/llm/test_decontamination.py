import re
import time
import tracemalloc

import numpy as np

from sparkwright.llm import decontamination as dc
from tests.llm.helpers import empty, odd, prose

BENCH = "item_id bigint, text string"


def words(t):
    return "".join(c for c in (t or "").lower() if c not in dc.string.punctuation).split()


def brute_cover(doc, item, least):
    """Words of item that greedy string tiling covers, by trying all starts."""
    least = min(least, len(item))
    d, i, covered = [True] * len(doc), [True] * len(item), 0
    while least:
        best = []
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and d[a + n] and i[b + n] and doc[a + n] == item[b + n]:
                    n += 1
                if n >= least:
                    best.append((-n, a, b))
        if not best:
            break
        most = min(best)[0]
        for n, a, b in sorted(best):
            if n == most and all(d[a : a - n]) and all(i[b : b - n]):
                for k in range(-n):
                    d[a + k] = i[b + k] = False
                covered -= n
    return covered


def test_query_equals_brute_force(spark, sf):
    docs, bench = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    grams = [(k, words(t), {tuple(words(t)[j : j + 5]) for j in range(len(words(t)) - 4)}) for k, t in bench]
    want = set()
    for i, t in docs:
        w = words(t)
        seen = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        for k, item, g in grams:
            if g & seen and brute_cover(w, item, 5) >= 0.5 * len(item):
                want.add((i, k))
    got = dc.op5_decontamination(spark, sf)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and want


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(150):
        doc, item = rng.integers(0, 4, int(rng.integers(0, 40))), rng.integers(0, 4, int(rng.integers(1, 20)))
        got = dc.greedy_tiles(doc.astype(np.uint64), np.arange(len(doc)), item.astype(np.uint64), min(3, len(item)))
        assert sum(t[2] for t in got) == brute_cover(doc.tolist(), item.tolist(), 3)
        assert all((doc[p : p + n] == item[q : q + n]).all() for p, q, n in got)


def test_planted_cases(spark):
    item = prose(77, 40)
    w = item.split()
    docs = [
        (1, prose(3, 100) + " " + item + " " + prose(4, 100)), (2, " ".join(w[20:] + ["between"] + w[:20])), (3, prose(5, 200)), (4, item.upper().replace(" ", " , ")), (5, " ".join(w[:15])), (6, " ".join(x if k % 8 else "edit" for k, x in enumerate(w))), (7, "tiny one"), (8, "tiny"), (None, item), (9, None),
    ]
    bench = spark.createDataFrame([(1, item), (2, "Tiny one!"), (3, ""), (4, None), (None, "  "), (1, item)], BENCH)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in dc.contaminated(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 1), (6, 1), (None, 1), (7, 2)}
    assert got[2, 1]["coverage"] == 1 and got[2, 1]["n_tiles"] == 2 and [(t["doc_pos"], t["item_pos"], t["length"]) for t in got[2, 1]["tiles"]] == [(0, 20, 20), (21, 0, 20)]
    left = dc.decontaminate(df, bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 5, 8, 9]


def test_odd_documents(spark):
    df = odd(spark, "words seeds bad_id bad_key item_id")
    bench = spark.createDataFrame([(1, re.sub("alpha", "alpha", prose(1, 30)))], BENCH)
    left = dc.decontaminate(df, bench)
    assert left.columns == df.columns and {1, 5, 6, 9}.isdisjoint(r["doc_id"] for r in left.collect()) and left.count() == df.count() - 4
    assert dc.decontaminate(df, bench.limit(0)).count() == df.count()
    assert dc.contaminated(empty(spark), bench).count() == 0


def test_lots_change_no_tile():
    rng = np.random.default_rng(6)
    for _ in range(200):
        doc, item = rng.integers(0, 3, int(rng.integers(0, 60))).astype(np.uint64), rng.integers(0, 3, int(rng.integers(1, 25))).astype(np.uint64)
        pos = np.cumsum(rng.integers(1, 3, len(doc)) if rng.random() < 0.5 else np.ones(len(doc), int))
        whole = dc.greedy_tiles(doc, pos, item, min(3, len(item)))
        assert all(dc.greedy_tiles(doc, pos, item, min(3, len(item)), lot) == whole for lot in (1, 2, 7, 30))


def test_a_repetitive_document_is_bounded():
    doc, item = np.full(60_000, 7, np.uint64), np.full(300, 7, np.uint64)
    began = time.perf_counter()
    tracemalloc.start()
    tiles = dc.greedy_tiles(doc, np.arange(len(doc)), item, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tiles == [(0, 0, 300)] and peak < 200e6 and time.perf_counter() - began < 60


def test_common_seeds_bring_no_pairs(spark):
    """A phrase that every document has is among the seeds that an item's candidates may lack."""
    phrase = "all of the rights are reserved here"
    docs = spark.createDataFrame([(k, f"{prose(k + 1, 30)} {phrase}") for k in range(50)] + [(100, f"{prose(400, 60)} {phrase}")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, f"{prose(400, 60)} {phrase}")], BENCH)
    seeds = [(1, 1, 67, s, 1) for s in range(63)]
    held = spark.createDataFrame([(s,) for s in range(61) for _ in range(2)] + [(s,) for s in (61, 62) for _ in range(51)], "seed bigint")
    rare = {r["seed"] for r in dc.rare_seeds(spark.createDataFrame(seeds, "item_id bigint, item_key bigint, n int, seed bigint, times bigint"), held, 5, 0.5).collect()}
    assert 61 not in rare and 62 not in rare and len(rare) == 57  # 7 shared seeds are needed, so 6 may be left out
    assert [(r["doc_id"], r["coverage"]) for r in dc.contaminated(docs, bench).collect()] == [(100, 1.0)]
