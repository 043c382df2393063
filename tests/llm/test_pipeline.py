"""The whole pipeline against plain loops, near duplicates by the exact similarity of five-word shingles."""

import corpus_pipeline
from sparkwright.llm import decontamination as dc
from sparkwright.llm import quality_rules as qr
from tests.llm.helpers import empty, odd
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_quality_rules import brute_figures
from tests.llm.test_similar import brute_kept


def good(text, lang):
    n, _, _, _, repeated = qr.base_counts(text)
    if n < 50 or 2 * repeated > n:
        return False
    _, per, part, entropy, spelled = brute_figures(text)
    low, high, share, least = qr.BANDS[lang]
    return low <= per <= high and part <= share and entropy >= least and spelled <= qr.PIECE_BANDS[lang]


def test_run_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    items = [dc.tokens(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    judged = [(i, t) for i, t, lang in rows if good(t, lang)]
    lines = [(i, t) for i, _, _, t in brute_lines(judged)]
    kept, links = brute_kept(lines)
    want = []
    for i, t in kept:
        w = dc.tokens(t)
        if not any(sum(x[2] for x in dc.greedy_tiles(w, dc.np.arange(len(w)), item, min(5, len(item)))) >= 0.5 * len(item) for item in items):
            want.append((i, t))
    got = corpus_pipeline.run(spark, sf).collect()
    assert links and len(judged) < len(rows) and len(want) < len(kept) < len(lines)
    assert got and {(r["doc_id"], r["text"]) for r in got} <= set(want)
    assert all(r["copies"] in (1, 2) and r["taken"] == r["copies"] * len(r["text"].encode().split()) for r in got)
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = stage(spark, before, sf)
    assert sorted((r["doc_id"], r["text"]) for r in before.collect()) == sorted(want)


def test_stages_take_odd_and_empty_tables(spark, sf):
    for docs in (odd(spark, "copies taken judged row"), empty(spark)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            assert out.columns[: len(docs.columns)] == docs.columns and (k == 4 or out.columns == docs.columns)
            assert out.count() <= docs.count()


def test_run_takes_long_runs_of_white_space(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    row = docs.first()
    gap = [(10**6 + k, row["text"] + run * 1_000_000, row["lang"], row["source"], 0) for k, run in enumerate((" ", "\n"))]
    out = docs.union(spark.createDataFrame(gap, docs.schema))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf)
    assert out.count() > 0
