import time

import numpy as np
import pytest

from sparkwright.llm.block_lstm import fresh_weights, logits, long_logits
from sparkwright.llm.blocks import DIM, MAX_DEPTH, MAX_NAMES, Block, blocks_of, vectors
from sparkwright.llm.html_extraction import label_pages


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a</p><svg-icon name=x></svg-icon><p>b</p>", ["a", "b"]),
        ("<p>a</p><video-player></video-player><p>b</p><video><p>no</p></video><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><select-box>b</select-box><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><svg width='1' /><p>b</p><math/><p>c</p><svg><path d=x /><text>no</text></svg><p>d</p>", ["a", "b", "c", "d"]),
        ("<p>a</p><datalist><option value=1>no<option>no</datalist><p>b</p>", ["a", "b"]),
        ("<select><option>no<option>no</select><p>b</p><datalist><option>no</option></datalist><p>c</p>", ["b", "c"]),
        ("<p>a</p><noscript><p>b</p>", ["a", "b"]),
        ("<p>a</p><script>no<p>no</p>", ["a"]),
        ("<title>no</title ><p>a</p><textarea>no", ["a"]),
    ],
)
def test_raw_elements_end(page, want):
    assert [b.text for b in blocks_of(page)] == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>", ["Where x=2 holds."]),
        ("<p>a</p><math/><p>b</p>", ["a", "b"]),
        ("<p>a <annotation>no</annotation> b</p>", ["a b"]),
        ("<p title='x > y' class=\"a>b\" data-x=\">\">a</p>", ["a"]),
        ("<p>a</p><p class=\"x>b</p><p>c</p>", ["a", "b", "c"]),
        ("<p>a < b and c <d", ["a < b and c <d"]),
        ("<p>a<span>b<p>c</span>d", ["ab", "cd"]),
        ("<a href=x>l<p>m</a>n</p>", ["l", "mn"]),
    ],
)
def test_markup(page, want):
    assert [b.text for b in blocks_of(page)] == want


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<div>a" * 100_000, "<p>a" * 200_000, "<svg>" * 200_000, "<option>" * 120_000, "<a b=\">\" " * 110_000, "<!--" * 250_000, "<b>" * 200_000 + "<div>a</div>" * 20_000, "<p class='" + "x " * 500_000, "<" * 1_000_000, "</x" * 300_000, "<p class=" + "x=" * 400_000 + ">a"],
    ids=["tags", "nested", "paragraphs", "svg", "options", "quotes", "comments", "inline", "names", "angles", "ends", "equals"],
)
def test_a_megabyte_of_odd_markup_is_read_in_linear_time(page):
    began = time.perf_counter()
    blocks = blocks_of(page)
    assert time.perf_counter() - began < 5
    assert max((len(b.path) for b in blocks), default=0) <= MAX_DEPTH * (1 + MAX_NAMES)


def test_deep_elements_close_again():
    page = "<article>" + "<div>" * 1000 + "a" + "</div>" * 1000 + "</article><footer>b</footer>"
    a, b = blocks_of(page)
    assert len(a.path) == MAX_DEPTH and a.path[0] == "article" and b.path == ("footer",)


def test_long_pages_are_labelled_in_parts_as_whole():
    rng = np.random.default_rng(2)
    w = fresh_weights(DIM, 6, 3)
    page = [Block(("body", "p"), f"word{int(k)} and more.", 0) for k in rng.integers(0, 99, 500)]
    whole = logits([vectors(page)], w)[0]
    for step in (64, 500, 1000):
        assert np.allclose(long_logits(500, lambda s, e: vectors(page, s, e), w, step), whole, atol=1e-5)
    assert np.allclose(label_pages([page[:40], page], w)[1], whole > 0)


@pytest.mark.parametrize("end", ['<a href="http://x', '<img alt="q', "<p class=a", "</p", "<!doctype x", "<!-- note", "<?php x", "<a href='x\" b", "</", "<b", '<x-card id="a'])
def test_a_page_cut_off_inside_a_tag_keeps_no_markup(end):
    page = "<article><p>hello world</p>tail " + end
    assert [b.text for b in blocks_of(page)] == ["hello world", "tail"]


def test_a_less_than_sign_in_a_text_is_text():
    assert [b.text for b in blocks_of("<p>a < b and 3 <4 end")] == ["a < b and 3 <4 end"]


@pytest.mark.parametrize("tag", ["svg", "template", "object", "canvas", "video"])
def test_hidden_elements_in_one_another(tag):
    inner = f"<{tag} a='>'><{tag}></{tag}>inner<{tag}>x</{tag}></{tag}>"
    assert [b.text for b in blocks_of(f"<p>one {inner} two {inner}</p>three")] == ["one two", "three"]
    assert [b.text for b in blocks_of(f"<p>one</p><{tag}><p>two</p>")] == ["one", "two"]  # nothing closes it
    assert [b.text for b in blocks_of(f"<{tag}>x<{tag}>y</{tag}>z")] == ["z"]  # the outer one is not closed: the next end tag


def test_a_self_closed_svg_in_another():
    assert [b.text for b in blocks_of("<svg><svg viewBox='0'/>t</svg>after")] == ["after"]


def test_unbalanced_hidden_elements_take_linear_time():
    start = time.time()
    assert blocks_of("<svg><svg></svg>" * 40_000 + "<template>" * 40_000)[-1:] == []
    assert time.time() - start < 20


def test_names_after_many_others_count():
    page = '<div class="flex p-4 m-2 text-gray-700 w-full h-10 rounded-lg shadow-md border-2 a1 a2 a3 a4 a5 a6 article">x</div>'
    path = blocks_of(page)[0].path
    assert ".article" in path and len(path) <= 1 + 16 + 1
