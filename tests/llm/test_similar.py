import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sparkwright.llm import line_dedup, quality_rules, simhash
from tests.llm.helpers import empty, odd, prose


def brute_kept(rows, similarity=0.8, width=5):
    """rows: (id, text) to the rows of the smallest id of each group of links, by all pairs; and the number of links."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}

    sets, root, links = [shingles(t) for _, t in rows], list(range(len(rows))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= similarity * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
                links += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for k, (i, t) in enumerate(rows):
        best[find(k)] = min((i, t), best.get(find(k), (i, t)))
    return sorted(best.values()), links


def changed(text, n, seed):
    """The text with n words changed at places at least five words apart, so that 5 n shingles differ."""
    words = text.split()
    for k in np.random.default_rng(seed).choice(np.arange(5, len(words) - 5, 5), n, replace=False):
        words[k] = f"new{seed}x{k}"
    return " ".join(words)


def pairs():
    """400-word texts and one changed copy of each, of similarities 0.7 to 0.95."""
    rows = []
    for k in range(60):
        text = prose(k + 1, 400)
        rows += [(2 * k, text), (2 * k + 1, changed(text, (2, 6, 8, 9, 10, 14)[k % 6], k))]
    return rows


def test_links_are_exact(spark):
    rows = pairs()
    want, links = brute_kept(rows)
    assert 0 < links < 60
    got = simhash.one_of_similar(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == want


def test_stage_equals_brute_force(spark, sf):
    """On the tables there are pairs of similarity 0.83 that the fingerprints miss, and pairs of 0.69 and 0.797 that they link."""
    docs = line_dedup.apply_line_dedup(quality_rules.keep_good(spark.read.parquet(f"{sf}/documents.parquet")))
    want, _ = brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == want


def test_tiles_cut_and_large_groups(spark):
    base = prose(7, 300)
    rows = [(k, changed(base, 3 + k % 9, k)) for k in range(60)]
    sets = [(0, k, simhash.shingle_set(t, 5).view(np.int64).tolist()) for k, t in rows] + [(1, 100, [1, 2, 3]), (1, 101, [4, 5, 6])]
    sets = spark.createDataFrame(sets, "root bigint, key bigint, shingles array<bigint>")
    kept = brute_kept(rows)[0]
    for tile in (1500, 1 << 18):
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.similar_links(sets, 0.8, tile)).collect()}
        assert {roots.get(k, k) for k, _ in rows} == {k for k, _ in kept} and 100 not in roots and 101 not in roots


def test_odd_and_empty_tables(spark):
    df = odd(spark, "root best kept_id kept_key")
    out = simhash.one_of_similar(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([1, 2, 5, 7, 8, None, 10], key=str)
    assert simhash.one_of_similar(empty(spark)).count() == 0


def test_candidates_grow_in_proportion(spark):
    """A group of like texts has a star for each band and a forest for each tile of fingerprints, not all its pairs."""
    base = prose(3, 300)
    counts = []
    for n in (80, 240):
        rows = [(k, changed(base, 1 + k % 3, k)) for k in range(n)] + [(1000 + k, prose(100 + k, 300)) for k in range(n)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        f = simhash._sketch_udf(5)("text")
        prints = df.select(f.alias("f")).select(F.get("f", F.lit(0)).alias("key"), F.get("f", F.lit(1)).alias("fp"), F.slice("f", 3, simhash.BANDS).alias("bands"))
        counts.append(simhash.candidate_links(prints, 3).count())
    most = simhash.BANDS + 1 + len(simhash.block_masks(3))  # links of a text, at most
    assert 80 <= counts[0] <= most * 80 and 240 <= counts[1] <= most * 240 and counts[1] < 5 * counts[0] < 240 * 239 / 2


def test_known_components_are_not_compared(spark):
    """A root of one component falls out; of others, the largest meets the rest, and the links are those that all pairs give."""
    base = prose(11, 300)
    rows = [(k, changed(base, 2 + k % 3, k)) for k in range(40)] + [(100 + k, changed(base, 14 + k, 50 + k)) for k in range(6)]
    sets = [(0, k, min(k, 1), simhash.shingle_set(t, 5).view(np.int64).tolist()) for k, t in rows if k < 40] + [(0, k, k, simhash.shingle_set(t, 5).view(np.int64).tolist()) for k, t in rows if k >= 100]
    sets += [(1, k, 7, [1, 2, 3]) for k in range(200, 230)]
    df = spark.createDataFrame(sets, "root bigint, key bigint, comp bigint, shingles array<bigint>")
    kept = {k for k, _ in brute_kept(rows)[0]}
    for tile in (1500, 1 << 18):
        links = simhash.similar_links(df, 0.8, tile).collect()
        assert all(r["a"] < 200 and r["b"] < 200 for r in links) and len(links) < 40
        known = [(1, k) for k in range(2, 40)]
        roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(known + [(r["a"], r["b"]) for r in links], "a bigint, b bigint")).collect()}
        assert {roots.get(k, k) for k, _ in rows} == kept
