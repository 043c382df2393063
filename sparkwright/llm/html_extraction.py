"""HTML extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks; each block is a vector of hashed tag-path names, hashed words
and a few plain figures, among them whether a known name of an article, or of what is none, is on its path. A bidirectional LSTM reads the whole sequence and labels every block, and the text of a
page is its main blocks in order.

There are no hand-made labels. The labeller is trained on a bounded sample (of the distinct pages with text, the TRAIN_PAGES of
the smallest hash of their content; of a longer page blocks of its start, end and inside, TRAIN_CHARS characters at most) that is labelled by structure: what an article, main or like element
holds, but for menus, notes and so on inside. The sample is also varied: further blocks under the names that boilerplate
usually has go in between, as do tables, lists, links and captions of the article, the article's element changes its name, and in
three of ten variants class and id names are hidden, so that structure, links and place must tell. All pages are then
labelled by the LSTM alone.

Defined results: a null or empty page has the text ''. Repeated rows are labelled alike. A null url or id is carried.
Badly nested markup is read as far as it goes; a tag that the page ends inside is no text, hidden elements in one another end together. Other columns are passed over. An empty table gives
an empty result. If no page has any text there is no sample, nothing is trained and all texts are ''. A block of over TRAIN_CHARS characters
is learnt by its first ones, but labelled and returned whole. A block whose number is exactly 0, neither side, is not main text. A very long page
is read LONG_PAGE blocks at a time, each way; elements nested deeper than MAX_DEPTH count as that deep.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block_lstm import Weights, logits, long_logits, train
from .blocks import MAIN, NOT_MAIN_NAMES, NOT_MAIN_TAGS, Block, blocks_of, named, vectors
from .common import col, table

TRAIN_PAGES, TRAIN_CHARS, VARIANTS, HIDDEN, EPOCHS, SEED = 300, 20_000, 12, 24, 8, 11
#: Pages that are labelled at once, and blocks; and blocks of a page that is read in parts.
LOT, LOT_BLOCKS, LONG_PAGE = 256, 20_000, 4_000
#: Paths by which the training sample is varied.
MAIN_PATHS = (
    ("article",), ("main",), ("div", ".content"), ("div", ".main"), ("div", ".article", ".body"), ("div", ".post"),
    ("section", ".entry"), ("div", ".story"), ("main", "article"), ("div", ".main", ".content", "article"),
    ("section", "article"), (),
)
INNER = (
    ("p",), ("p",), ("ul", "li"), ("div",), ("h2",), ("h3",), ("blockquote", "p"), ("ol", "li"), ("table", "tr", "td"),
    ("section", "p"), ("figure", "figcaption"), ("pre",), (),
)


def structural_labels(page: list[Block]) -> np.ndarray:
    """1 for blocks of the article by the names on their path; without an article, for all that has no other name."""
    places = [named(b.path) for b in page]
    some = any(inside and not off for inside, off in places)
    return np.array([not off and (inside or not some) for inside, off in places], np.float32)


def unnamed(page: list[Block], rng: np.random.Generator) -> list[Block]:
    """The page with its class and id names hidden: each replaced by a word that says nothing, or all left out."""
    drop, salt = rng.random() < 0.5, int(rng.integers(1 << 30))

    def hidden(path: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(
            x if x[0] != "." else f".{xxhash.xxh3_64_hexdigest(f'{salt}{x}')[:6]}" for x in path if x[0] != "." or not drop
        )

    return [b._replace(path=hidden(b.path)) for b in page]


def varied(page: list[Block], labels: np.ndarray, rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page with its article under another name, with boilerplate and further kinds of blocks of the article put in between, and often with its names hidden."""
    words = [w for b in page for w in b.text.split()]
    hide = rng.random() < 0.3
    new = MAIN_PATHS[rng.integers(len(MAIN_PATHS))] if rng.random() < 0.8 else None
    out: list[tuple[Block, float]] = []
    top = ("html", "body")

    def text(linked: bool, most: int = 0) -> tuple[str, int]:
        n = int(rng.integers(1, most or (6 if linked else 60)))
        t = " ".join(words[i] for i in rng.integers(len(words), size=n))
        return t, len(t) if linked else 0

    def inside(b: Block) -> tuple[str, ...]:
        at = next((i for i, x in enumerate(b.path) if x in MAIN), None)
        return b.path[: at + 1] if at is not None else b.path[:-1]

    for b, k in zip(page, labels, strict=True):
        if k and new is not None:
            head = inside(b)
            b = b._replace(path=(*top, *new, *b.path[len(head) :]))
        out.append((b, float(k)))
    for _ in range(int(rng.integers(0, 6))):
        at = int(rng.integers(len(out) + 1))
        near, is_main = out[min(at, len(out) - 1)]
        if rng.random() < 0.35:  # more of the article
            if not is_main:
                continue
            body, k = inside(near) or top, 1.0
        else:
            tag = rng.random() < (0.8 if hide else 0.35)
            name = ("header",) if rng.random() < 0.2 else (NOT_MAIN_TAGS[rng.integers(6)],) if tag else (
                ("div", "section", "p", "ul", "aside")[rng.integers(5)],
                f".{NOT_MAIN_NAMES[rng.integers(len(NOT_MAIN_NAMES))]}",
            )
            within = rng.random() < 0.5 and name != ("header",) and (tag or not hide)
            if hide and not within:  # without names, only its place and its links tell it from the article
                at = 0 if rng.random() < 0.5 else len(out)
            body, k = (*(inside(near) if within else top), *name), 0.0
        inner = ("header", "h1") if k and rng.random() < 0.2 else INNER[rng.integers(len(INNER))]
        linked = rng.random() < (0.2 if k and inner[:1] in (
            ("ul",), ("ol",), ("table",),
        ) else 0.0 if k else 0.7 if hide and not tag else 0.4)
        for _ in range(int(rng.integers(1, 6))):
            t, n = text(linked, 12 if k and linked else 0)
            if t:
                out.insert(at, (Block((*body, *inner), t, n), k))
                at += 1
    blocks = [b for b, _ in out]
    return unnamed(blocks, rng) if hide else blocks, np.array([k for _, k in out], np.float32)


def fit(
    sample: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED, variants: int = VARIANTS,
) -> Weights | None:
    """Weights from a sample of pages; None if it has no blocks."""
    return fit_blocks(
        [(page, structural_labels(page)) for page in map(blocks_of, sample)], hidden, epochs, seed, variants,
    )


def fit_blocks(
    sample: list[tuple[list[Block], np.ndarray]], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED,
    variants: int = VARIANTS,
) -> Weights | None:
    """Weights from labelled pages, or windows of them; None if they have no blocks."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for page, labels in sample:
        for k in range(max(variants, 400 // max(1, len(sample))) if page else 0):
            p, y = (page, labels) if k == 0 else varied(page, labels, rng)
            xs.append(vectors(p))
            ys.append(y)
    return train(xs, ys, hidden, epochs, seed) if xs else None


def window(html: str, chars: int = TRAIN_CHARS) -> tuple[list[Block], np.ndarray]:
    """The blocks of a page, labelled as parts of all of it; of a page of over chars characters of text those at its start, at its end and from a place given by its hash."""
    page = blocks_of(html)
    labels, sizes = structural_labels(page), [len(b.text) for b in page]
    if sum(sizes) <= chars:
        return page, labels
    start = xxhash.xxh3_64_intdigest(html.encode("utf-8", "replace")) % len(page)
    taken: set[int] = set()
    for run, most in (
        (range(len(page)), chars // 4), (range(len(page) - 1, -1, -1), chars // 4),
        ([*range(start, len(page)), *range(start)], chars // 2),
    ):
        for i in run:
            if i not in taken:
                most -= sizes[i]
                if most < 0:
                    break
                taken.add(i)
    at = sorted(taken) or [start]
    return [page[i]._replace(text=page[i].text[:chars], linked=min(page[i].linked, chars)) for i in at], labels[at]


def _window_udf(chars: int) -> Callable:
    @F.arrow_udf("string")
    def windows(html: pa.Array) -> pa.Array:
        found = (window(x.as_py(), chars) for x in html)
        return pa.array([json.dumps([page, labels.tolist()]) if page else None for page, labels in found], pa.string())

    return windows


def training_sample(
    pages: DataFrame, html_col: str = "html", train_pages: int = TRAIN_PAGES, train_chars: int = TRAIN_CHARS,
) -> list[tuple[list[Block], np.ndarray]]:
    """Labelled windows of the train_pages distinct pages with text that have the smallest hashes: the same ones in every run."""
    full = pages.select(col(html_col).alias("html")).where(F.length("html") > 0)
    h = F.pmod(F.xxhash64("html"), F.lit(1 << 32))
    n = full.select(F.approx_count_distinct(F.xxhash64("html"))).first()[0]
    share = min(1.0, (3 * train_pages + 100) / max(1, n))
    while True:
        some = full.where(h < int(share * (1 << 32))).distinct().select(
            h.alias("h"), F.xxhash64("html").alias("key"), _window_udf(train_chars)(F.col("html")).alias("piece"),
        )
        found = some.where(F.col("piece").isNotNull()).orderBy("h", "key").limit(train_pages).collect()  # train_pages * train_chars characters of text at most
        if len(found) == train_pages or share == 1.0:
            break
        share = min(1.0, 8 * share)  # many of them have no text
    read = (json.loads(r["piece"]) for r in found)
    return [([Block(tuple(path), text, linked) for path, text, linked in page], np.array(labels, np.float32)) for page, labels in read]


def label_pages(pages: list[list[Block]], weights: Weights) -> list[np.ndarray]:
    """Whether each block is main text; pages of like length go together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if pages[i]]
    at = 0
    while at < len(order):
        if len(pages[order[at]]) > LONG_PAGE:
            page = pages[order[at]]
            out[order[at]] = long_logits(len(page), lambda first, last, page=page: vectors(
                page, first, last,
            ), weights, LONG_PAGE) > 0
            at += 1
            continue
        n = 1
        while n < LOT and at + n < len(order) and (n + 1) * len(pages[order[at + n]]) <= LOT_BLOCKS:
            n += 1
        of = order[at : at + n]
        for i, y in zip(of, logits([vectors(pages[i]) for i in of], weights), strict=True):
            out[i] = y > 0
        at += n
    return out


def _text_udf(weights) -> Callable:
    @F.arrow_udf("string")
    def main_text(html: pa.Array) -> pa.Array:
        out: list[str] = []
        if weights.value is None:  # no page has text
            return pa.array([""] * len(html), pa.string())
        for at in range(0, len(html), 4 * LOT):
            pages = [blocks_of(x.as_py()) for x in html[at : at + 4 * LOT]]
            out += [" ".join(b.text for b, k in zip(p, y, strict=True) if k) for p, y in zip(pages, label_pages(pages, weights.value), strict=True)]
        return pa.array(out, pa.string())

    return main_text


def extract(
    pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"),
    train_pages: int = TRAIN_PAGES, train_chars: int = TRAIN_CHARS,
) -> DataFrame:
    """One row for each row of pages: the columns to keep, text and n_chars."""
    weights = fit_blocks(training_sample(pages, html_col, train_pages, train_chars))
    sent = pages.sparkSession.sparkContext.broadcast(weights)
    out = pages.select(*(col(c).alias(c) for c in keep), _text_udf(sent)(col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
