"""What the SQL comparison leaves open: estimates, greedy and recursive operators, joins with made-up cases, and plans."""

import re
import time
from itertools import product
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkwright import catalogue
from sparkwright.operators import sets
from sparkwright.operators.aggregates import (
    CM_BUCKETS, CM_ROWS, count_min, count_min_estimates, count_min_merged, exact_quantiles, from_ordered_bits, ordered_bits,
)
from sparkwright.operators.joins import asof_join, dyadic_cells, range_join, salted_join, small
from sparkwright.operators.sets import closure, closure_by_hub
from sparkwright.plans import encoding, postings, retrieval, vectors
from sparkwright.plans.retrieval import split_text
from sparkwright.plans.vectors import diverse, nearest
from sparkwright.sources.shared import shared_dir
from sparkwright.sources.tables import table
from sparkwright.streaming import stateful
from tests.compare import duck_rows, spark_rows


def test_estimates_are_near(spark, sf):
    exact = {r[0]: r[1] for r in table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey")).collect()}
    for flag, n in ((r[0], r[1]) for r in catalogue.QUERIES["agg_approx_distinct"](spark, sf).collect()):
        assert abs(n - exact[flag]) <= 0.05 * exact[flag]
    users = {r[0]: r[1] for r in table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id")).collect()}
    for r in catalogue.QUERIES["agg_sketch"](spark, sf).collect():
        assert abs(r["users"] - users[r["event_type"]]) <= 0.05 * users[r["event_type"]]


@given(st.text(alphabet="ab .\n", max_size=400), st.integers(5, 60))
def test_split_text_round_trip(text, size):
    parts = split_text(text, size)
    assert "".join(parts) == text and all(0 < len(p) <= size for p in parts)


def test_diverse_is_greedy():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(10, 8))
    g = pd.DataFrame({"query_id": 1, "vec_id": np.arange(10), "score": np.round(rng.random(10), 6), "v": list(v)})
    got = diverse(g, 4)["vec_id"].tolist()
    order, chosen = g.sort_values(["score", "vec_id"], ascending=[False, True])["vec_id"].tolist(), []
    while len(chosen) < 4:
        chosen.append(max((i for i in order if i not in chosen), key=lambda i: (round(0.7 * g["score"][i] - 0.3 * max((v[i] @ v[j] for j in chosen), default=0), 9), -order.index(i))))
    assert got == chosen


def test_nearest_in_many_blocks(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    r = e.select("vec_id", F.col("embedding").alias("v"))
    few = sorted(map(tuple, nearest(q, r, 5, block=37).collect()))
    assert few == sorted(map(tuple, nearest(q, r, 5).collect()))


def shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_nearest_shuffles_each_vector_once(spark, metric):
    """Seventeen blocks of queries against seventeen of rows: a vector that is shuffled for each of them makes 17 times the bytes. Equal vectors and repeated ids are among the rows."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 64)).astype(np.float32)
    v[50:60] = v[7]
    ids = [*range(590), *range(10)]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id bigint, v array<float>")
    before = shuffled(spark)
    got = nearest(rows.toDF("query_id", "q").where("query_id >= 10"), rows, 5, metric, block=37).select("query_id", "vec_id", "rank").collect()
    assert shuffled(spark) - before < 3 * v.nbytes
    x = v.astype(np.float64)
    s = np.round(x @ x.T if metric == "dot" else -np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T)), 6)
    want = [(q, ids[j], r + 1) for q in range(10, 590) for r, j in enumerate(sorted((j for j in range(600) if ids[j] != q), key=lambda j: (-s[q, j], ids[j]))[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_parts_of_the_exact_search_are_bounded_and_enough():
    for q, r, width in product((0, 1, 25, 513, 10_256, 51_282, 615_384, 5_000_000), (0, 1, 500, 10_256, 615_384, 5_000_000), (1, 64, 1024)):
        n_q, n_r = vectors._cut(q, r, width, vectors.BLOCK)
        assert n_q >= 1 and n_r >= 1
        assert -(-r // n_r) * width <= vectors.PART_NUMBERS and -(-q // n_q) * width <= vectors.PART_NUMBERS // 8
        assert n_q * n_r >= min(8, q * r // vectors.BLOCK**2)
    assert vectors._cut(615_384, 615_384, 64, vectors.BLOCK)[1] == 5  # so each query sends on 5 times k rows


def test_range_join_against_all_pairs(spark):
    a = [(i, x) for i, x in enumerate([-7.5, 0.0, 1.0, 9.99, 10.0, 55.5])]
    b = [(i, lo, hi) for i, (lo, hi) in enumerate([(-8.0, 0.0), (0.0, 10.0), (9.0, 60.0), (5.0, 5.0)])]
    got = range_join(spark.createDataFrame(a, "a int, x double"), spark.createDataFrame(b, "b int, lo double, hi double"), F.col("x"), F.col("lo"), F.col("hi"), 10.0).select("a", "b").collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for (i, x), (j, lo, hi) in product(a, b) if lo <= x < hi)


def test_range_join_of_long_intervals_makes_few_rows(spark):
    rng = np.random.default_rng(5)
    a = [(i, float(x)) for i, x in enumerate(rng.integers(-100_000, 100_000, 60))] + [(60, None)]
    b = [(0, -1e6, 1e6), (1, -1e6, -99_999.5), (2, 7.0, 7.0), (3, 8.0, 3.0), (4, None, 5.0)]
    b += [(5 + i, float(min(x)), float(max(x))) for i, x in enumerate(rng.integers(-100_000, 100_000, (40, 2)).tolist())]
    left, right = spark.createDataFrame(a, "a int, x double"), spark.createDataFrame(b, "b int, lo double, hi double")
    got = range_join(left, right, F.col("x"), F.col("lo"), F.col("hi"), 10.0).select("a", "b").collect()
    want = sorted((i, j) for (i, x), (j, lo, hi) in product(a, b) if x is not None and lo is not None and lo <= x < hi)
    assert sorted(map(tuple, got)) == want
    cells = right.where("b = 0").select(F.explode(dyadic_cells(F.floor(F.col("lo") / 10.0), F.floor(F.col("hi") / 10.0))).alias("c")).select("c.*").collect()
    covered = sorted(n for r in cells for n in range(r["cell"] << r["level"], (r["cell"] + 1) << r["level"]))
    assert len(cells) < 40 and covered == list(range(-100_000, 100_001))
    assert range_join(left, right.where("false"), F.col("x"), F.col("lo"), F.col("hi"), 10.0).count() == 0


def test_closure_over_cycles_and_dead_ends(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 1), (1, 2), (7, None), (None, 1)], "src int, dst int")
    got = closure(edges, spark.createDataFrame([(1,), (5,), (6,), (9,), (1,)], "start int")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (1, 3), (1, 4), (5, 5), (6, 1), (6, 2), (6, 3), (6, 4), (6, 6), (9, 9)]


def test_closure_by_hub_equals_closure(spark):
    rng = np.random.default_rng(10)
    made = [
        [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 1), (1, 2), (None, 1), (7, 8), (8, 4), (8, 6)],
        [(int(a), int(b)) for a, b in rng.integers(0, 60, (70, 2))], [],
    ]
    for rows in made:
        edges = spark.createDataFrame(rows, "src int, dst int")
        starts = spark.createDataFrame([(x,) for x in [*range(0, 60, 4), 7, 7]], "start int")
        assert sorted(map(tuple, closure_by_hub(edges, starts).collect())) == sorted(map(tuple, closure(edges, starts).collect()))


def test_closure_by_hub_writes_no_pairs_of_a_cycle(spark):
    """300 starts that all reach 300 nodes: 90,000 rows, but the steps write some rows for each node and tried hub."""
    folder = shared_dir(spark).removeprefix("file://")
    before = set(Path(folder).iterdir())
    edges = spark.range(300).select(F.col("id").alias("src"), F.explode(F.array(*(((F.col("id") * 7 + j * j) % 300) for j in range(5)))).alias("dst"))
    got = closure_by_hub(edges, spark.range(300).toDF("start"))
    wrote = sum(spark.read.parquet(str(x)).count() for x in set(Path(folder).iterdir()) - before)
    assert got.count() == 300 * 300 and wrote < 300 * 300 / 2


def test_closure_by_hub_writes_no_pairs_of_several_cycles(spark, monkeypatch):
    """Three parts of 200 nodes that do not reach each other, and some pairs of nodes: the second and third part are no plain steps either."""
    monkeypatch.setattr(sets, "HUB_PAIRS", 3000)
    folder = shared_dir(spark).removeprefix("file://")
    parts = spark.range(600).select(F.col("id").alias("src"), F.explode(F.array(*(((F.col("id") * 7 + j * j) % 200 + F.floor(F.col("id") / 200) * 200) for j in range(5)))).alias("dst"))
    edges = parts.union(spark.range(600, 640).select("id", F.col("id").bitwiseXOR(F.lit(1))))
    before = set(Path(folder).iterdir())
    got = closure_by_hub(edges, spark.range(640).toDF("start"))
    wrote = sum(spark.read.parquet(str(x)).count() for x in set(Path(folder).iterdir()) - before)
    assert sorted(map(tuple, got.collect())) == sorted([(i, j) for i in range(600) for j in range(i // 200 * 200, i // 200 * 200 + 200)] + [(i, j) for i in range(600, 640) for j in (i, i ^ 1)])
    assert wrote < 600 * 200 / 2


def test_closure_by_hub_makes_short_files(spark, tmp_path):
    """Starts times nodes rows, of which a page of Parquet repeats the nodes: far under the 12 bits that a node takes."""
    edges = spark.range(3000).select(F.col("id").alias("src"), F.explode(F.array((F.col("id") + 1) % 3000, *(((F.col("id") * 7 + j * j) % 3000) for j in range(4)))).alias("dst"))
    closure_by_hub(edges, spark.range(3000).toDF("start")).write.parquet(str(tmp_path / "out"))
    files = [*(tmp_path / "out").glob("part-*")]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3000 * 3000
    assert sum(x.stat().st_size for x in files) < 3000 * 3000 / 5


def test_count_min_is_never_too_low_and_within_its_bound(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey")
    n = df.count()
    exact = {r[0]: r[1] for r in df.groupBy("l_orderkey").count().collect()}
    parts = [count_min(df.where("l_orderkey % 2 = 0"), "l_orderkey"), count_min(df.where("l_orderkey % 2 = 1"), "l_orderkey")]
    whole = {tuple(r) for r in count_min(df, "l_orderkey").collect()}
    assert {tuple(r) for r in count_min_merged(parts).collect()} == whole
    got = {r[0]: r[1] for r in count_min_estimates(count_min_merged(parts), df, "l_orderkey").collect()}
    assert set(got) == set(exact) and all(got[k] >= exact[k] for k in exact)
    assert sum(got[k] - exact[k] > np.e / CM_BUCKETS * n for k in exact) <= len(exact) * np.exp(-CM_ROWS) * 1.5 + 1


def test_salted_join_keeps_all_rows(spark):
    big = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("x")).union(spark.range(3).select(F.lit(2), "id"))
    other = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "k2 int, y string")
    assert salted_join(big, other, "k", "k2").count() == 2000


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = catalogue.QUERIES["scan_pruned"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,45.0)" in plan and "l_extendedprice" not in plan


def test_stateful_stream_equals_batch(spark, sf):
    got = {r["user_id"]: (r["n"], r["gap"]) for r in catalogue.QUERIES["st_stateful"](spark, sf).collect()}
    e = table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).toPandas().sort_values("us")
    want = {u: (len(g), int(g["us"].diff().max() // 1_000_000) if len(g) > 1 else 0) for u, g in e.groupby("user_id")}
    assert got == want


def test_sketches_of_sets_and_top_items(spark, sf):
    users = {r[0]: r[1] for r in table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id")).collect()}
    for r in catalogue.QUERIES["agg_sketch_sets"](spark, sf).collect():
        assert abs(r["users"] - users[r["event_type"]]) <= 0.05 * users[r["event_type"]]
    counts = {(r[0], r[1]): r[2] for r in table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").count().collect()}
    for r in catalogue.QUERIES["agg_top_k"](spark, sf).collect():
        assert abs(r["n"] - counts[r["l_returnflag"], r["item"]]) <= 0.05 * r["n"]
    mids = {r[0]: (r[1], r[2]) for r in table(spark, sf, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.45)), F.percentile("value", F.lit(0.55))).collect()}
    for r in catalogue.QUERIES["agg_sketch"](spark, sf).collect():
        assert mids[r["event_type"]][0] <= r["mid"] <= mids[r["event_type"]][1]


def recall(approximate, exact):
    got, want = ({(r["query_id"], r["vec_id"]) for r in x.collect()} for x in (approximate, exact))
    return len(got & want) / len(want)


def test_ivf_recall_on_the_table(spark):
    d = "/root/testdata/sf0.01"
    assert recall(catalogue.QUERIES["knn_ivf"](spark, d), catalogue.QUERIES["knn_exact"](spark, d)) >= 0.9


def test_ivf_probes_few_cells_of_clustered_vectors(spark):
    """Where vectors have structure, few cells are read, and recall stays; small blocks cut cells and queries into parts."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16))
    v = centres[rng.integers(0, 40, 1200)] + 0.1 * rng.normal(size=(1200, 16))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id bigint, v array<float>")
    q = rows.where("vec_id % 20 = 0").toDF("query_id", "q")
    for block in (16, vectors.BLOCK):
        index = vectors.ivf_index(rows, block=block)
        probes = vectors.ivf_probes(index, q, rows, metric="l2")
        assert index.rows.count() == 1200 and 1 <= probes <= len(index.centres) // 3
        assert recall(vectors.ivf_search(index, q, probes, metric="l2"), nearest(q, rows, metric="l2")) >= 0.9


def test_bar_of_few_terms_loses_no_rank(spark):
    """BM25 over candidates equals BM25 over all pairs, with terms that all documents have."""
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(["the", "of", *(words[min(59, int(x))] for x in rng.exponential(12, 30))])) for k in range(150)]
    passages = [(k, " ".join(["the", "of", *(words[int(x)] for x in rng.integers(0, 60, 8))])) for k in range(12)] + [(99, "the of"), (98, "nowhere")]
    df, p = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(passages, "item_id bigint, text string")
    for block_docs in (4, 128):
        index = retrieval.build_index(df, block_docs=block_docs)
        asked = retrieval.passage_terms(p)
        known = index.terms().withColumn("idf", F.ln(1 + (index.n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        pairs = index.postings().join(known.select("term", "idf"), "term").join(asked, "term")
        whole = pairs.groupBy("item_id", "doc_id").agg(F.round(F.sum(F.col("idf") * F.col("weight")), 6).alias("score"))
        want = retrieval.top_k(whole, "item_id", "doc_id").select("item_id", "doc_id", "score", "rank")
        assert sorted(map(tuple, retrieval.bm25_ranks(index, p).select("item_id", "doc_id", "score", "rank").collect())) == sorted(map(tuple, want.collect()))


def test_index_and_ranks_write_no_row_for_each_posting_or_pair(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("the of and "), F.col("id") % 7).alias("text"))
    passages = spark.range(20).select(F.col("id").alias("item_id"), F.concat(F.lit("the of "), F.col("id") % 7).alias("text"))
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    index = retrieval.build_index(docs)
    assert index.terms().where("term = 'the'").first()["df"] == 600 and index.n == 600 and index.mean == 4
    for ranks in (retrieval.bm25_ranks(index, passages), retrieval.overlap_ranks(index, passages)):
        got = [(r["doc_id"] % 7 == r["item_id"] % 7, r["rank"]) for r in ranks.collect()]
        assert len(got) == 200 and all(same for same, _ in got) and sorted(k for _, k in got) == sorted([*range(1, 11)] * 20)
    assert sum(spark.read.parquet(str(x)).count() for x in set(folder.iterdir()) - before) < 600


def test_index_is_stored_by_term_and_reads_no_text(spark, sf):
    index = postings.stored_index(spark, sf)
    assert postings.stored_index(spark, sf) is index and index.blocks.agg(F.max("n")).first()[0] <= index.n
    few = spark.createDataFrame([("zzz",), ("und",)], "term string")
    plan = index.of(few)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [" in plan and "text" not in plan
    plan = catalogue.QUERIES["bm25"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "regexp_extract_all" not in plan


def test_vocabulary_and_sums_over_many_blocks_and_buckets(spark, monkeypatch):
    """Odd texts and ids, blocks of a few documents, buckets of a few terms, against plain loops."""
    monkeypatch.setattr(postings, "BUCKET_TERMS", 8)
    rng = np.random.default_rng(21)
    docs = [(k, " ".join(f"w{min(40, int(x))}" for x in rng.exponential(9, 25))) for k in range(40)]
    docs += [(50, None), (51, ""), (52, " .,\n"), (53, "É😀x é 𝔘𝔘 ٣"), (None, "w1 lone"), (-7, "w1 W1 w1"), (54, "lone")]
    index = retrieval.build_index(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), block_docs=5)
    words = {k: re.findall(r"[^\W_]+", (t or "").lower()) for k, t in docs}
    df = {t: sum(t in w for w in words.values()) for w in words.values() for t in w}
    first = {t: min((k for k, w in words.items() if t in w and k is not None), default=None) for t in df}
    assert index.buckets > 4 and index.blocks.count() >= 8 and index.n == len(docs)
    got = {r["term"]: (r["df"], r["cf"], r["first"]) for r in index.vocabulary.collect()}
    assert got == {t: (n, sum(w.count(t) for w in words.values()), first[t]) for t, n in df.items()}
    sums = {r["doc_id"]: (round(r["x"], 9), r["terms"]) for r in retrieval.tfidf_sums(index).collect()}
    assert sums == {k: (round(sum(np.log(len(docs) / df[t]) for t in w), 9), len(set(w))) for k, w in words.items() if w}
    assert index.postings().count() == sum(df.values())


def test_no_posting_is_a_row(spark, sf):
    """The vocabulary is read as it is stored, and sums take no list apart."""
    plan = catalogue.QUERIES["inverted_index"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    assert "inline" not in catalogue.QUERIES["tfidf"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_encoded_texts_of_common_words_are_near(spark):
    docs = [(1, "the red house stands"), (2, "red houses stand"), (3, "quantum chromodynamics"), (4, None), (5, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    index = retrieval.build_index(df)
    v = {r["doc_id"]: np.array(r["vector"]) for r in encoding.encoded(index, df).collect()}
    assert set(v) == {1, 2, 3} and v[1] @ v[2] > 0.3 > abs(v[1] @ v[3]) and all(abs(np.linalg.norm(x) - 1) < 1e-4 for x in v.values())
    assert {r["doc_id"]: list(r["vector"]) for r in encoding.encoded_documents(index).collect()} == {k: list(x) for k, x in v.items()}


def test_blocks_get_each_terms_df_from_all_buckets(spark, monkeypatch):
    """Vectors made in blocks of a few documents, with the df of many buckets, are those of the texts."""
    monkeypatch.setattr(postings, "BUCKET_TERMS", 8)
    rng = np.random.default_rng(22)
    docs = [(k, " ".join(f"w{min(40, int(x))}" for x in rng.exponential(9, 25))) for k in range(40)] + [(50, None), (51, " ."), (53, "É😀x é 𝔘𝔘 ٣"), (-7, "w1 W1 lone")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    index = retrieval.build_index(df, block_docs=5)
    want = {r["doc_id"]: list(r["vector"]) for r in encoding.encoded(index, df).collect()}
    got = {r["doc_id"]: list(r["vector"]) for r in encoding.encoded_documents(index).collect()}
    assert index.buckets > 4 and index.blocks.count() >= 8 and set(got) == set(want) == {k for k, t in docs if k not in (50, 51)}
    assert all(np.allclose(got[k], want[k], atol=2e-6) for k in want)


def test_short_passages_join_by_their_opening(spark, sf):
    docs = [(1, "ab cd"), (2, "xab c"), (3, "\n\n."), (4, ""), (5, "é😀 b")]
    passages = [(1, "ab"), (2, ""), (3, "ab cd"), (4, "\n."), (5, "😀 b"), (6, None), (7, "zz")]
    got = retrieval.holders(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(passages, "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, k) for i, p in passages for k, t in docs if p is not None and p in t)
    p = table(spark, sf, "benchmark").where("item_id < 5").select("item_id", F.substring("text", 1, 20).alias("text"))
    assert "NestedLoop" not in retrieval.holders(table(spark, sf, "documents"), p)._jdf.queryExecution().executedPlan().toString()


def test_holders_find_what_is_cut_out_of_words(spark):
    docs = [(1, "xx alpha beta gamma delta epsilon zeta yy"), (2, "alpha beta gamma delta epsilon zeta"), (3, "no such text"), (4, "A,b"), (5, "alpha beta Gamma delta epsilon zeta yy")]
    passages = [(1, "lpha beta gamma delta epsilon zeta y"), (2, "alpha beta gamma delta epsilon zet"), (3, ",b"), (4, "a beta gamma delta epsilon zeta")]
    got = retrieval.holders(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(passages, "item_id bigint, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, k) for i, p in passages for k, t in docs if p in t)


def test_holders_move_no_text_that_was_not_found(spark):
    """More pairs than a broadcast takes: the texts without any are left out before the shuffle."""
    docs = [(k, "zero one two three four five six seven") for k in range(340)] + [(1000 + k, f"other {k}") for k in range(50)]
    passages = [(k, "one two three four five six seven") for k in range(300)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = retrieval.holders(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(passages, "item_id bigint, text string"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == got.distinct().count() == 340 * 300 and got.agg(F.max("doc_id")).first()[0] == 339
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"SortMergeJoin \[doc_id#\d+L\], \[doc_id#\d+L\], Inner", plan) and re.search(r"BroadcastHashJoin \[doc_id#\d+L\], \[doc_id#\d+L\], LeftSemi", plan)


def test_mmr_query_against_plain_loops(spark, sf):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in table(spark, sf, "embeddings").collect()}
    got = {}
    for r in catalogue.QUERIES["mmr"](spark, sf).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in [k for k in rows if k % 20 == 0][:5]:
        near = sorted(((round(float(rows[q] @ v), 6), -k) for k, v in rows.items() if k != q), reverse=True)[:10]
        chosen = []
        while len(chosen) < 5:
            chosen.append(max(((round(0.7 * s - 0.3 * max((float(rows[-k] @ rows[c]) for c in chosen), default=0), 9), s, k) for s, k in near if -k not in chosen))[2] * -1)
        assert got[q] == chosen


def test_small_checks_rows_and_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    df = spark.range(100).withColumn("text", F.repeat(F.lit("x"), F.lit(1000)))
    assert hinted(small(df)) and not hinted(small(df, most_rows=99)) and not hinted(small(df, most_bytes=50_000))


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    assert shared_dir(Session(spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y" and shared_dir(Session(spark_master="local[4]")).startswith("file:")
    for master in ("local-cluster[3,2,1000]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError):
            shared_dir(Session(spark_master=master))


def test_ordered_bits_keep_order_and_value(spark):
    import struct

    rng = np.random.default_rng(11)
    xs = [struct.unpack("<d", rng.bytes(8))[0] for _ in range(2000)]
    xs = [x for x in xs if x == x] + [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.0**-1022, 2.2e-308, 1.7976931348623157e308, float("inf"), float("-inf")]
    xs += [float(np.nextafter(2.0**e, w)) for e in (-1022, -3, 0, 1, 29, 52, 1023) for w in (0.0, np.inf)] + [2.0**e for e in range(-1074, 1024, 7)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ordered_bits(F.col("x")).alias("k"))
    got = df.select("x", "k", from_ordered_bits(F.col("k")).alias("back")).collect()
    for r in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(r["x"])))[0]
        assert r["k"] == (-bits if r["x"] < 0 else bits) and r["back"] == r["x"]
    nan = spark.createDataFrame([(float("nan"),)], "x double").select(ordered_bits(F.col("x")).alias("k"), from_ordered_bits(ordered_bits(F.col("x"))).alias("b")).first()
    assert nan["k"] > max(r["k"] for r in got) and nan["b"] != nan["b"]


def test_exact_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", float(x)) for x in rng.normal(size=3000)] + [("ties", x) for x in [2.0] * 500 + [3.0]] + [("one", -1.5), ("none", None)]
    rows += [(None, float(x)) for x in rng.integers(-5, 5, 40)] + [("wide", float(x)) for x in 10.0 ** rng.uniform(-300, 300, 200)] + [("inf", float("inf"))] * 3
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    fractions = {"least": 0.0, "mid": 0.5, "p90": 0.9, "most": 1.0}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "x", fractions).collect()}
    want = {r["g"]: r for r in df.where("x IS NOT NULL").groupBy("g").agg(*(F.percentile("x", F.lit(p)).alias(k) for k, p in fractions.items())).collect()}
    assert set(got) == set(want) == {"hot", "ties", "one", "wide", "inf", None}
    for g in set(want) - {"inf"}:
        for k in fractions:
            assert got[g][k] == pytest.approx(want[g][k], rel=1e-12), (g, k)
    assert got["inf"]["mid"] == float("inf")
    assert exact_quantiles(df.where("false"), ["g"], "x", fractions).count() == 0


def test_asof_join_against_loops_with_a_hot_key(spark):
    rng = np.random.default_rng(4)
    keys = lambda n: [None if x == 0 else 1 if x < 30 else int(x) % 7 for x in rng.integers(0, 60, n)]
    times = lambda n: [None if x == 0 else int(x) for x in rng.integers(0, 200, n)]
    a = list(zip(range(400), keys(400), times(400)))
    b = list(zip(keys(60), times(60), range(1000, 1060)))
    left = spark.createDataFrame(a, "i int, k int, t int").withColumn("t", F.timestamp_seconds("t"))
    right = spark.createDataFrame(b, "k int, t int, v int").withColumn("t", F.timestamp_seconds("t"))
    want = {i: max(((t2, v) for k2, t2, v in b if None not in (k, t, k2, t2) and k2 == k and t2 <= t), default=(0, None))[1] for i, k, t in a}
    for slices in (1, 7, 64):
        got = asof_join(left, right, "k", "t", "v", slices)
        assert got.columns == ["i", "k", "t", "v"]
        rows = got.collect()
        assert len(rows) == len(a) and {r["i"]: r["v"] for r in rows} == want
    assert asof_join(left, right.where("false"), "k", "t", "v").where("v IS NOT NULL").count() == 0
    assert asof_join(left.where("false"), right, "k", "t", "v").count() == 0


def test_asof_join_gives_no_task_half_the_rows(spark):
    hot = spark.range(20_000).select(F.lit(1).alias("k"), F.timestamp_seconds("id").alias("t"), F.col("id").alias("v"))
    left = hot.drop("v")
    groups = {}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for r in asof_join(left, hot, "k", "t", "v").groupBy(F.spark_partition_id().alias("p")).count().collect():
            groups[r["p"]] = r["count"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(groups.values()) == 20_000 and max(groups.values()) < 20_000 / 2


def clustered(spark, n, dims=32, clusters=40):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(clusters, dims))[rng.integers(0, clusters, n)] + 0.25 * rng.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id bigint, v array<float>")


def recall(got, want):
    got, want = ({(r["query_id"], r["vec_id"]) for r in df.collect()} for df in (got, want))
    return len(got & want) / len(want)


def test_lsh_reaches_its_recall_on_the_table(spark, sf):
    exact = catalogue.QUERIES["knn_exact"](spark, sf)
    got = catalogue.QUERIES["knn_lsh"](spark, sf)
    assert recall(got, exact) >= 0.9
    scores = {(r["query_id"], r["vec_id"]): r["score"] for r in exact.collect()}
    rows = got.collect()
    assert all(scores.get((r["query_id"], r["vec_id"]), r["score"]) == r["score"] and r["query_id"] != r["vec_id"] for r in rows)


def test_lsh_compares_a_falling_share_of_clustered_vectors(spark):
    shares = []
    for n in (1000, 4000):
        rows = clustered(spark, n)
        q = rows.where("vec_id % 20 = 0").toDF("query_id", "q")
        index = vectors.lsh_index(rows)
        probes = vectors.lsh_probes(index, q, rows)
        met = vectors.lsh_candidates(index, q, probes).select("query_id", "cell").join(index.rows.select("cell", "vec_id"), "cell")
        assert recall(vectors.lsh_search(index, q, probes), nearest(q, rows)) >= 0.9
        shares.append(met.select("query_id", "vec_id").distinct().count() / (n * n / 20))
    assert shares[1] < shares[0] and shares[1] < 0.5


def test_lsh_meets_all_and_only_what_shares_a_bucket(spark, monkeypatch):
    """Small regions, parts and lots against a join on the buckets; a query comes to a region once."""
    monkeypatch.setattr(vectors, "LSH_LOT", 20)
    rows = clustered(spark, 1500)
    q = rows.where("vec_id % 10 = 0").toDF("query_id", "q")
    index = vectors.lsh_index(rows, tables=3, bits=6, block=200)
    v = {r["vec_id"]: np.array(r["v"], np.float32).astype(float) for r in rows.collect()}
    met = vectors.lsh_candidates(index, q, 9).join(index.rows, "cell").where("query_id <> vec_id").select("query_id", "vec_id").distinct().collect()
    want = {}
    for r in met:
        want.setdefault(r["query_id"], []).append((-round(float(v[r["query_id"]] @ v[r["vec_id"]]), 6), r["vec_id"]))
    got = {}
    for r in vectors.lsh_search(index, q, 9).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (-r["score"], r["vec_id"])
    assert 0 < index.shift < 6 and {k: [x[i] for i in sorted(x)] for k, x in got.items()} == {k: sorted(x)[:10] for k, x in want.items()}


def test_lsh_of_equal_vectors_and_of_none(spark):
    rows = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("v"))
    index = vectors.lsh_index(rows, tables=2, bits=3, block=7)
    got = vectors.lsh_search(index, rows.where("vec_id = 9").toDF("query_id", "q"), 1, 4).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    none = rows.where("false")
    assert vectors.lsh_search(vectors.lsh_index(none), none.toDF("query_id", "q"), 2).count() == 0


def test_bucketed_tables_join_and_group_without_exchange(spark, sf):
    df = catalogue.QUERIES["sink_bucketed"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2


def test_folders_are_pruned_by_the_other_side(spark, sf):
    df = catalogue.QUERIES["join_dynamic_pruning"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.split("PartitionFilters", 1)[1]


def test_map_state_expires_between_three_batches(spark, tmp_path):
    """A run of one batch for each: with time to live Spark always has a next batch, so a stream is never done."""
    source = spark.readStream.schema("k string, item string").option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/[0-9]*")

    def batch(no, rows):
        spark.createDataFrame(rows, "k string, item string").coalesce(1).write.parquet(f"{tmp_path}/{no}")
        with stateful.rocksdb(spark):
            run = stateful.first_seen(source, "k", "item", 20_000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
                "checkpointLocation", f"{tmp_path}/checkpoint",
            ).trigger(once=True).start()
        try:
            assert run.awaitTermination(60)
        finally:
            run.stop()
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))

    assert batch(0, [("a", "x"), ("a", "x"), ("b", "x")]) == [("a", "x"), ("b", "x")]
    assert batch(1, [("a", "x"), ("a", "y")]) == [("a", "x"), ("a", "y"), ("b", "x")]  # x of a is still known
    time.sleep(22)
    assert batch(2, [("b", "x"), ("c", "z")]) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("c", "z")]  # x of b had expired
    assert spark.conf.get(stateful.PROVIDER) != stateful.ROCKSDB


def test_recursion_is_not_ended_at_a_number_of_rows(spark, sf):
    limit = "spark.sql.cteRecursionRowLimit"
    want, before = sorted(map(tuple, catalogue.QUERIES["cte_recursive"](spark, sf).collect())), spark.conf.get(limit)
    spark.conf.set(limit, "100")
    try:
        assert sorted(map(tuple, catalogue.QUERIES["cte_recursive"](spark, sf).collect())) == want and len(want) > 100
        assert spark.conf.get(limit) == "100"
    finally:
        spark.conf.set(limit, before)


@pytest.mark.parametrize("name", ["fn_array", "fn_array_more"])
def test_rounded_arrays_equal_sql_to_the_last_bit(spark, duck, tmp_path, name):
    """Zeros below zero, and sums of squares that end in a five at the last place but one."""
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.normal(size=64) / 8], k % 3) for k in range(400)] + [(400 + k, [-1e-5, 0.0, -0.0, 0.03125, -0.03125, -1e-5] * 3, 0) for k in range(3)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sql = catalogue.ORACLES[name].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got, want = spark_rows(catalogue.QUERIES[name](spark, str(tmp_path))), duck_rows(duck, sql)
    assert repr(got) == repr(want)
