import html
import re

import numpy as np

from sparkwright.llm import block_lstm, html_extraction
from sparkwright.llm.blocks import blocks_of


def test_query_gives_the_articles(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = html_extraction.op3_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    wrong = 0
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())
        wrong += want != r["text"]
        assert r["n_chars"] == len(r["text"])
    assert wrong == 0


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>One &amp; two"), (4, "u", "no markup at all"), (4, "u", "no markup at all"), (5, "u", "<p>" + "word " * 20000), (6, "u", "<script>x<p>y"), (7, "u", "< < & &am <"), (8, "u", "<!-- <p>gone</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS text", "'y' AS n_chars")
    got = html_extraction.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    by = {r["page_id"]: r["text"] for r in got.collect()}
    assert by[1] == by[2] == by[8] == "" and all(r["n_chars"] == len(r["text"]) for r in got.collect())
    assert html_extraction.extract(df.limit(0)).count() == 0


def test_blocks():
    page = "<body><nav><a href='/x>y'>Home</a></nav><div class='postBody main'><h1>T</h1><p>a<b>b</b> c<br>d<p>e &eacute;&#8212;<ul><li>x<li>y</ul><script>var p='<p>no</p>'</script></div>"
    got = [(b.text, b.path) for b in blocks_of(page)]
    div = ("body", "div", ".post", ".body", ".main")
    assert got == [("Home", ("body", "nav")), ("T", (*div, "h1")), ("ab c", (*div, "p")), ("d", (*div, "p")), ("e é—", (*div, "p")), ("x", (*div, "ul", "li")), ("y", (*div, "ul", "li"))]
    assert blocks_of("<nav><a>Home</a></nav>")[0].linked == 4


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    pages = [rng.normal(size=(n, 5)).astype(np.float32) for n in (3, 1, 4)]
    labels = [rng.integers(0, 2, len(p)).astype(np.float32) for p in pages]
    w = {k: v.astype(np.float64) for k, v in block_lstm.fresh_weights(5, 4, 1).items()}
    _, grad = block_lstm.gradient(pages, labels, w)
    for k in w:
        for i in list(np.ndindex(w[k].shape))[:: max(1, w[k].size // 4)]:
            w[k][i] += 1e-3
            up = block_lstm.gradient(pages, labels, w)[0]
            w[k][i] -= 2e-3
            down = block_lstm.gradient(pages, labels, w)[0]
            w[k][i] += 1e-3
            assert abs((up - down) / 2e-3 - grad[k][i]) < 2e-3


def test_held_out_pages_of_other_shapes(spark, sf):
    sample = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    w = html_extraction.fit(sample)
    page = """<html><body><header><h1>Site name</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice"><p>We use cookies on this site.</p></div><main><h1>The title</h1><p>First words of the text, with <b>bold</b> words. And more.</p>
      <aside class="related"><h3>Related</h3><ul><li><a href=1>Other story</a></li></ul></aside><p>Second part goes on.</p></main><section class="comments"><h2>Comments</h2><div class="comment"><p>I do not agree with this text.</p></div></section><footer>copy</footer></body></html>"""
    blocks = blocks_of(page)
    kept = [b.text for b, k in zip(blocks, html_extraction.label_pages([blocks], w)[0], strict=True) if k]
    assert kept == ["The title", "First words of the text, with bold words. And more.", "Second part goes on."]
