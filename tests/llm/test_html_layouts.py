"""The labeller, trained on the tables' pages alone, on pages of other layouts."""

import pytest

from sparkwright.llm import html_extraction
from sparkwright.llm.blocks import blocks_of
from tests.llm.html_layouts import LAYOUTS, scores


@pytest.fixture(scope="module")
def figures(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()
    weights = html_extraction.fit([r["html"] for r in rows])
    pages = [blocks_of(page) for page, _ in LAYOUTS.values()]
    kept = [[b.text for b, k in zip(p, y, strict=True) if k] for p, y in zip(pages, html_extraction.label_pages(pages, weights), strict=True)]
    return {name: scores(k, want) for (name, (_, want)), k in zip(LAYOUTS.items(), kept, strict=True)}


def test_recall_and_precision_over_all_layouts(figures):
    recall, precision = (sum(x[i] for x in figures.values()) / len(figures) for i in (0, 1))
    assert len(figures) >= 12 and recall >= 0.97 and precision >= 0.95, figures


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(figures, name):
    recall, precision = figures[name]
    assert recall >= 0.8 and precision >= 0.8


def test_blocks_have_all_wanted_text():
    for page, want in LAYOUTS.values():
        assert set(want) <= {b.text for b in blocks_of(page)}
