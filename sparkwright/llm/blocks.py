"""Pages as sequences of leaf blocks: the text between block-level tags, with the path of tags above it."""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import xxhash

#: Fixed values of HTML: elements whose content is not markup or not shown, elements that never close, inline elements,
#: those of formulas, and what a start tag closes.
RAW = frozenset("noscript template svg iframe object canvas select audio video annotation annotation-xml".split())
#: Those whose content goes on to the end of the page if they are not closed; others are then left out as a tag alone.
RAW_TO_END = frozenset("script style textarea title".split())
#: Those that may lie in one another; the content of others is text to a browser, so the first end tag ends them.
NESTED = RAW - frozenset("noscript iframe select".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FORMULA = frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mtable mtr mtd semantics".split()
)
INLINE = FORMULA | frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
P_CLOSERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "body": ("head",),
}
#: A start tag closes nothing beyond these.
WALLS = frozenset("ul ol dl table td th div article section main aside nav body html form blockquote".split())
#: Names that begin a tag even if the page ends inside it.
KNOWN = RAW | RAW_TO_END | VOID | INLINE | P_CLOSERS | WALLS | CLOSES.keys() | frozenset("button head label option summary tbody tfoot thead caption".split())
ATTRIBUTE = re.compile(r"\s[\w:.-]++=")
#: Elements nested deeper count as the innermost of so many, as in browsers; and names that a path takes from one tag, beside all those that MAIN and NOT_MAIN_NAMES list.
MAX_DEPTH, MAX_NAMES = 256, 16
MARK = re.compile(r"<(?:!--|[!?]|(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)|/)", re.IGNORECASE)
#: What goes on to the > of a tag: a quoted value after = may hold one. Possessive, so nothing is tried twice.
REST = re.compile(r"(?P<attr>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
END_OF = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW | RAW_TO_END}
OPTION_END = re.compile(r"</?(?:option|optgroup|datalist|select)(?=[\s/>])", re.IGNORECASE)
PAIR_OF = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+", re.IGNORECASE) for tag in NESTED}
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
WORDS = re.compile(r"[^\W_]+")

#: Names of tags, classes and ids by which the training sample is labelled, and which a block is told of.
MAIN = ("article", "main", ".main", ".content", ".article", ".post", ".entry", ".story", ".body")
NOT_MAIN_TAGS = ("nav", "footer", "aside", "form", "menu", "dialog", "button", "head")
NOT_MAIN_NAMES = (
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disclaimer",
    "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo",
    "promoted", "related", "reply", "replies", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget",
)
TOLD = frozenset((*MAIN, *(f".{n}" for n in NOT_MAIN_NAMES)))

PATH_DIM, WORD_DIM, PLAIN_DIM = 160, 24, 8
DIM = PATH_DIM + WORD_DIM + PLAIN_DIM


class Block(NamedTuple):
    path: tuple[str, ...]  # tags, and .names from class, id and role
    text: str
    linked: int  # characters inside links


def markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, whether it closes, attributes) of each piece of markup, in order; the tag is empty for what only goes: comments, declarations and elements that are not shown.

    Every character is looked at a bounded number of times: what does not close is found out once.
    """
    at, unclosed = 0, set()  # elements that nothing closes from here on
    pairs: dict[str, dict[int, int]] = {}  # where the end tag of a start tag begins, of elements that may be nested
    while m := MARK.search(page, at):
        start, tag, closes = m.start(), (m["tag"] or "").lower(), bool(m["end"])
        if not tag:
            comment = m[0] == "<!--"
            end = page.find("-->" if comment else ">", m.end())
            at = end + (3 if comment else 1) if end >= 0 else len(page)
            yield start, at, "", False, ""
            continue
        rest = REST.match(page, m.end())
        if not rest:  # the page ends inside this tag; or after a text with a < that begins none
            if tag in KNOWN or ATTRIBUTE.search(page, m.end()):
                yield start, len(page), "", False, ""
            return
        at, attr = rest.end(), rest["attr"]
        hidden = END_OF.get(tag) or (OPTION_END if tag == "option" else None)
        if hidden and not closes and tag not in unclosed and not (tag == "svg" and attr.endswith("/")):
            if tag in NESTED and tag not in pairs:
                pairs[tag] = paired(page, tag, start)
            end = hidden.search(page, pairs.get(tag, {}).get(start, at))
            if end or tag in RAW_TO_END:
                after = page.find(">", end.end()) if end else -1
                at = end.start() if end and tag == "option" else after + 1 if after >= 0 else len(page)
                yield start, at, "", False, ""
                continue
            unclosed.add(tag)
        yield start, at, tag, closes, attr


def paired(page: str, tag: str, start: int) -> dict[int, int]:
    """Where the end tag begins that closes each start tag of an element that may lie in itself; start tags that nothing closes are not in it."""
    out, open_ = {}, []
    for m in PAIR_OF[tag].finditer(page, start):
        if m[1]:
            if open_:
                out[open_.pop()] = m.start()
        elif not (tag == "svg" and m[0].endswith("/")):
            open_.append(m.start())
    return out


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in order: character references decoded, white space turned into one space, none empty."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # elements that are not inline, each with the path to it
    parts: list[str] = []
    path: tuple[str, ...] = ()
    linked, link, deeper = 0, -1, 0  # characters in links; how deep a link began; elements open beyond MAX_DEPTH

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(path, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal path, linked
        if not text:
            return
        if not parts:
            path = stack[-1][1] if stack else ()
        parts.append(text)
        if link >= 0:
            linked += len(text)

    def close(tags: tuple[str, ...], walls: frozenset[str] = WALLS) -> None:
        nonlocal link
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                link = link if link <= i else -1
                return
            if stack[i][0] in walls:
                return

    at = 0
    for start, end, tag, closes, attr in markup(page):
        add(page[at:start])
        at = end
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                link = -1 if closes else len(stack)
            continue
        flush()
        optional = tag == "p" or tag in CLOSES
        if closes:
            if deeper and not optional:
                deeper -= 1
            elif not deeper:
                close((tag,), frozenset())
            continue
        if tag in P_CLOSERS:
            close(("p",))
        if tag in CLOSES:
            close(CLOSES[tag])
        if tag in VOID or attr.endswith("/"):
            continue
        if len(stack) >= MAX_DEPTH:
            deeper += not optional
            continue
        words = (w for g in NAMES.findall(attr) for w in WORDS.findall(re.sub(
            r"([a-z])([A-Z])", r"\1 \2", "".join(g),
        ))) if attr else ()
        names = list(dict.fromkeys(f".{w.lower()}" for w in words))
        names = [x for i, x in enumerate(names) if i < MAX_NAMES or x in TOLD]
        stack.append((tag, (*(stack[-1][1] if stack else ()), tag, *names)))
    add(page[at:])
    flush()
    return out


OFF = frozenset((*NOT_MAIN_TAGS, *(f".{n}" for n in NOT_MAIN_NAMES)))


@functools.lru_cache(maxsize=4096)
def named(path: tuple[str, ...]) -> tuple[bool, bool]:
    """Whether a name on the path is one of an article, and whether one is of what is not its text."""
    first = next((i for i, x in enumerate(path) if x in MAIN), None)
    page_header = "header" in path and (first is None or path.index("header") < first)
    return first is not None, page_header or not OFF.isdisjoint(path)


@functools.lru_cache(maxsize=4096)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Signed hashes of the path's tags and names, and of the innermost tag."""
    v = np.zeros(PATH_DIM, np.float32)
    tags = [x for x in path if x[0] != "."]
    for x in {*path, *(f"last {t}" for t in tags[-1:])}:
        h = xxhash.xxh3_64_intdigest(x)
        for _ in range(3):
            v[h % PATH_DIM] += 1 if h >> 20 & 1 else -1
            h = h * 0x9E3779B97F4A7C15 >> 7 & (1 << 57) - 1
    return v


def vectors(page: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """A row for each block, or for those from first to last."""
    some = page[first:last]
    out = np.zeros((len(some), DIM), np.float32)
    for i, b in enumerate(some):
        out[i, :PATH_DIM] = path_vector(b.path)
        words = b.text.split()
        hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64) % WORD_DIM
        out[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(hashed.astype(np.int64), minlength=WORD_DIM) / len(words)
        stops = sum(b.text.count(x) for x in ".!?")
        out[i, PATH_DIM + WORD_DIM :] = (
            np.log1p(len(words)) / 4, b.linked / len(b.text), min(1.0, 5 * stops / len(words)), (first + i) / len(page),
            min(1.0, len(page) / 100), 1.0, *named(b.path),
        )
    return out
