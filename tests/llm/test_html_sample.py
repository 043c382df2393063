from sparkwright.llm import html_extraction
from sparkwright.llm.blocks import blocks_of


def page(k, n):
    return "<html><body><nav><a href=x>Home</a></nav><article>" + "".join(f"<p>Words {k} of part {i} go on here, and on.</p>" for i in range(n)) + "</article></body></html>"


def frame(spark, pages):
    return spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string").selectExpr("*", "'u' AS url")


def test_long_pages_are_learnt_and_copies_count_once(spark):
    pages = [page(k, 1000) for k in range(4)] + [page(9, 3)] * 50 + [None, "", "<script>x</script>"]
    sample = html_extraction.training_sample(frame(spark, pages))
    assert len(sample) == 5
    assert all(0 < sum(len(b.text) for b in p) <= html_extraction.TRAIN_CHARS and len(p) == len(y) for p, y in sample)
    assert sum(len(p) > 300 for p, _ in sample) == 4
    few = html_extraction.training_sample(frame(spark, pages), train_pages=3)
    assert len(few) == 3 and len({p[0].text + p[-1].text for p, _ in few}) == 3


def test_only_long_pages(spark):
    pages = [page(k, 800) for k in range(5)]
    got = html_extraction.extract(frame(spark, pages)).collect()
    for r in got:
        assert r["text"] == " ".join(b.text for b in blocks_of(pages[r["page_id"]]) if "article" in b.path)


def test_pages_without_text(spark):
    got = html_extraction.extract(frame(spark, ["<script>x</script>", "", None])).collect()
    assert [r["text"] for r in got] == ["", "", ""]
