"""Token counts by compiled finite-state transducers.

A byte-level BPE vocabulary with word ends is compiled into two deterministic transducers.

The first reads character classes and marks where the pieces begin that merges cannot cross. It has five
states, so a chunk of text is a map of states to states; the maps of all chunks of a block of texts
compose by a parallel prefix scan, after which each chunk runs from its known state.

The second reads a piece byte by byte; each transition carries the number of tokens it emits (which is
negative where tokens grow together). A state holds, for each token prefix that the bytes read may still
grow into, the last token before it and its count; the next token is the one whose pair with that last token the
merges leave alone, and there is just one. States are compiled when a text first needs them.

Defined results: a null or empty text has no bytes and no tokens. Strings of special tokens inside a text count
as those tokens, as is the library's default; none is added. Rows that repeat are counted alike; other columns are passed over.
An empty table gives an empty result. A very long text is counted whole, chunk by chunk. No ties can arise: a text has one count.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, table

TOKENIZER, LIMIT = "word_bpe_49k.json", 2048
#: The pattern and the normalisation that the first transducer is compiled from.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_END = "</w>"
#: The white space of the pattern.
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Classes: space, letter, number, other, and an apostrophe before one or two letters that it takes with it.
SPACE, LETTER, NUMBER, OTHER, TAKES1, TAKES2 = range(6)
#: States: between pieces, in letters, in others, and one or two characters before the end of a contraction.
BETWEEN, LETTERS, OTHERS, ONE, TWO = range(5)
#: Characters of a block; pieces, and states or pairs, that a worker keeps before those tables start anew.
BLOCK, KEPT_PIECES, KEPT = 1 << 21, 1 << 19, 1 << 18


def _scanner() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece begins, by class and state."""
    to, begins = np.zeros((6, 5), np.uint8), np.zeros((6, 5), bool)
    into = {SPACE: BETWEEN, LETTER: LETTERS, NUMBER: BETWEEN, OTHER: OTHERS, TAKES1: ONE, TAKES2: TWO}
    for k in range(6):
        for s in (BETWEEN, LETTERS, OTHERS):
            goes_on = s == LETTERS and k == LETTER or s == OTHERS and k in (OTHER, TAKES1, TAKES2)
            to[k, s] = s if goes_on else into[k]
            begins[k, s] = k != SPACE and not goes_on
        to[k, ONE], to[k, TWO] = BETWEEN, ONE
    return to, begins


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for i in range(len(out)):
        k = kinds.get(unicodedata.category(chr(i))[0])
        if k is not None:
            out[i] = k
    out[SPACES] = SPACE
    return out


def classify(points: np.ndarray) -> np.ndarray:
    k = _classes()[points]
    at = np.flatnonzero(points[:-1] == ord("'"))
    if len(at):
        a, b = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
        b = np.where(at + 2 < len(points), b, 0)
        two = np.zeros(len(at), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        k[at[np.isin(a, [ord(x) for x in "stmd"])]] = TAKES1
        k[at[two]] = TAKES2
    return k


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix scan: row i becomes the map of rows 0 to i, one after the other."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        step *= 2
    return maps


def piece_bounds(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces begin and end."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    to, begins = _scanner()
    k = classify(points)
    length = max(16, int(np.sqrt(n)))
    chunks = -(-n // length)
    grid = np.full(chunks * length, SPACE, np.uint8)
    grid[:n] = k
    grid = np.ascontiguousarray(grid.reshape(chunks, length).T).astype(np.intp) * 5  # a row for each step
    flat, marks = to.ravel(), begins.ravel()
    maps = np.tile(np.arange(5, dtype=np.uint8), (chunks, 1))
    for row in grid:
        maps = flat[row[:, None] + maps]
    state = np.concatenate([[BETWEEN], compose_scan(maps)[:-1, BETWEEN]]).astype(np.uint8)
    starts = np.empty(grid.shape, bool)
    for i, row in enumerate(grid):
        at = row + state
        starts[i] = marks[at]
        state = flat[at]
    start = starts.T.ravel()[:n]
    begin = np.flatnonzero(start)
    stop = start | (k == SPACE)
    stops = np.append(np.flatnonzero(stop), n)
    return begin, stops[np.searchsorted(stops, begin, "right")]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], more = chr(256 + more), more + 1
    return out


class PieceTransducer:
    """Counts the tokens of a piece; states and transitions are compiled on first use."""

    def __init__(self, model: dict) -> None:
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.letters = _byte_letters()
        self.children: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        self.final: list[str | None] = [None]
        for t in model["vocab"]:
            ends = t.endswith(WORD_END)
            node = 0
            for x in t[: -len(WORD_END)] if ends else t:
                if x not in self.children[node]:
                    self.children[node][x] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                    self.final.append(None)
                node = self.children[node][x]
            (self.final if ends else self.token)[node] = t
        self.valid = functools.lru_cache(maxsize=KEPT)(self._valid)
        self.clear()

    def clear(self) -> None:
        """Forget all states but the first, in which nothing was read."""
        self.tails: list[tuple] = [((0, None, 0),)]
        self.known: dict[tuple, int] = {self.tails[0]: 0}
        self.next: list[dict[int, tuple[int, int]]] = [{}]
        self.last: list[dict[int, int]] = [{}]
        self.pieces: dict[str, int] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 40))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _valid(self, a: str, b: str) -> bool:
        """Whether the merges leave the boundary between two tokens alone."""
        ends = b.endswith(WORD_END)
        symbols = [*a, *(b[: -len(WORD_END)] if ends else b)]
        if ends:
            symbols[-1] += WORD_END
        return self.merged(symbols) == [a, b]

    def _token(self, state: int, letter: str, ends: list[str | None]) -> tuple[str, int]:
        """The token that ends with the letter, and the tokens up to it, as against those up to the state."""
        for node, before, count in self.tails[state]:
            child = self.children[node].get(letter)
            t = ends[child] if child is not None else None
            if t is not None and (before is None or self.valid(before, t)):
                return t, count + 1
        raise ValueError("the vocabulary has no token for a byte")

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        letter = self.letters[byte]
        t, emitted = self._token(state, letter, self.token)
        tail = [(self.children[n][letter], before, count - emitted) for n, before, count in self.tails[state] if letter in self.children[n]]
        tail = tuple([x for x in tail if self.children[x[0]]] + [(0, t, 0)])
        new = self.known.setdefault(tail, len(self.tails))
        if new == len(self.tails):
            self.tails.append(tail)
            self.next.append({})
            self.last.append({})
        self.next[state][byte] = new, emitted
        return new, emitted

    def count(self, piece: str) -> int:
        raw, state, n = piece.encode(), 0, 0
        for b in raw[:-1]:
            go = self.next[state].get(b)
            state, emitted = go if go is not None else self._step(state, b)
            n += emitted
        more = self.last[state].get(raw[-1])
        if more is None:
            more = self.last[state][raw[-1]] = self._token(state, self.letters[raw[-1]], self.final)[1]
        return n + more

    def counts(self, pieces: list[str]) -> list[int]:
        if len(self.tails) > KEPT:
            self.clear()
        if len(self.pieces) > KEPT_PIECES:
            self.pieces = {}
        known, out = self.pieces, []
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = self.count(p)
                if len(p) < 64:
                    known[p] = n
            out.append(n)
        return out


class TokenCounter:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != NORMALIZERS or split["pattern"]["Regex"] != PATTERN or model["end_of_word_suffix"] != WORD_END or model.get("dropout"):
            raise ValueError(f"{path}: not a tokenizer that can be compiled here")
        self.pieces = PieceTransducer(model)
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def parts(self, text: str) -> tuple[list[str], int]:
        """The normalised text between special tokens, and the number of those."""
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        return [unicodedata.normalize("NFC", p).replace("Σ", "σ").lower() for p in parts], len(parts) - 1

    def count_block(self, texts: list[str]) -> np.ndarray:
        total, owner, parts = np.zeros(len(texts), np.int64), [], []
        for i, t in enumerate(texts):
            ps, total[i] = self.parts(t)
            parts += ps
            owner += [i] * len(ps)
        whole = "\n".join(parts)
        begin, end = piece_bounds(np.frombuffer(whole.encode("utf-32-le"), np.uint32))
        n = self.pieces.counts([whole[s:e] for s, e in zip(begin.tolist(), end.tolist(), strict=True)])
        ends = np.cumsum([len(p) + 1 for p in parts])
        np.add.at(total, np.array(owner, np.int64)[np.searchsorted(ends, begin, "right")], np.array(n, np.int64))
        return total

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, in blocks of about BLOCK characters."""
        out, block, size = [], [], 0
        for t in texts:
            if block and size + len(t) > BLOCK:
                out.append(self.count_block(block))
                block, size = [], 0
            block.append(t)
            size += len(t)
        return np.concatenate([*out, self.count_block(block)]) if block else np.zeros(0, np.int64)


@functools.lru_cache(maxsize=2)
def counter(name: str) -> TokenCounter:
    """Compiled once in each Python worker; name is a file of the public tokenizers or a path."""
    import public_tokenizers

    return TokenCounter(name if "/" in name else public_tokenizers.path(name))


def _count_udf(tokenizer: str) -> Callable:
    @F.arrow_udf("bigint")
    def n_tokens(text: pa.Array) -> pa.Array:
        return pa.array(counter(tokenizer).count([t.as_py() or "" for t in text]))

    return n_tokens


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT,
) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_tokens and over_limit."""
    text = F.coalesce(col(text_col), F.lit(""))
    out = docs.select(
        col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
        _count_udf(tokenizer)(text).alias("n_tokens"),
    )
    return out.select(
        F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
    )


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
