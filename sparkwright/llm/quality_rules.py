"""Quality rules on tokeniser fertility, after a few plain counts.

A public byte-level vocabulary splits every whole text. Three figures are held against bands that depend on the
language, or else on the script, of the document: characters per token (low for noise, encoded data and
garbled text, high for padding and repeated runs), the share of tokens that are only part of a character
(byte fallback), and the entropy of the tokens in bits, as a share of what as many different tokens, or
FULL_LENGTH of them, would have (low for repetition). A second public vocabulary, of pieces, gives a fourth: the share of
characters that it can only spell in bytes (high for rare symbols and wrongly decoded text).

Bands of the commonest languages and scripts are parameters. For any other script they come from the table itself: far-out
fences around the quartiles of its documents, drawn toward the widest band where there are few of them.

Defined results: a null or empty text has no words, counts of zero, null figures, and fails the base rule. A
language without a band, or null, takes the band of the text's script, or else the widest. Of scripts with as many letters the last by name
counts, and a figure on the edge of its band is inside. A very long text is encoded whole, in pieces cut only where no token can lie across; so are long runs
of white space. Rows that repeat are
judged alike; other columns are passed over (`judge`) or kept (`keep_good`). An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, col, fresh, table, text_bytes

VOCABULARY, PIECES = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
SYMBOLS = b"#*$%&|<>"
#: Fixed values, per language (ISO 639-1) or script: characters per token (least, most), byte-fallback share (most), relative entropy (least).
BANDS = {
    "en": (2.10, 9.0, 0.10, 0.64),
    "de": (2.10, 9.0, 0.10, 0.64),
    "es": (2.00, 9.0, 0.10, 0.64),
    "fr": (2.00, 9.0, 0.10, 0.64),
    "LATIN": (1.80, 9.0, 0.15, 0.60),
    "CYRILLIC": (0.80, 9.0, 0.40, 0.50),
    "GREEK": (0.70, 9.0, 0.50, 0.50),
    "CJK": (0.30, 4.0, 0.95, 0.45),
    "": (0.25, 12.0, 1.0, 0.40),
}
#: Fixed values, likewise: share of characters that the second vocabulary spells in bytes (most).
PIECE_BANDS = {
    "en": 0.10, "de": 0.10, "es": 0.10, "fr": 0.10, "LATIN": 0.15, "CYRILLIC": 0.15, "GREEK": 0.25, "CJK": 0.60,
    "": 1.0,
}
#: Quartile distances to a fence, and the weight of the widest band in documents.
FENCE, PRIOR_DOCS = 3.0, 50
#: Tokens from which prose no longer gains entropy by being longer.
FULL_LENGTH = 512
#: Characters that the tokeniser takes at once, about.
PIECE = 50_000
RESULT = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,n_tokens:bigint,chars_per_token:double,fallback_share:double,rel_entropy:double,spelled_share:double,kept:boolean>"
CUT = re.compile(r"(?<=\S) ")
#: The white space of the vocabularies' pattern; runs of so many go to the vocabulary apart, as the pattern looks ahead from each.
SPACE, LONG_RUN = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", 1000
RUN, WHOLE_RUN = re.compile(f"[{SPACE}]{{{LONG_RUN},}}"), re.compile(f"[{SPACE}]{{{LONG_RUN - 1},}}")


@functools.lru_cache(maxsize=2)
def encoder(name: str) -> tuple[Callable, np.ndarray]:
    """The vocabulary's encode function, and for each id whether its bytes are only part of a character."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    partial = np.zeros(max(ranks.values()) + 1, bool)
    for piece, i in ranks.items():
        try:
            piece.decode()
        except UnicodeDecodeError:
            partial[i] = True
    by_pattern = tiktoken.Encoding("fertility", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = tiktoken.Encoding("runs", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        return [i for p in pieces(text) for i in (whole if WHOLE_RUN.fullmatch(p) else by_pattern).encode_ordinary(p)]

    return encode, partial


@functools.lru_cache(maxsize=2)
def speller(name: str) -> Callable[[str], bool]:
    """Whether a vocabulary of pieces has no piece for a character, so that it spells it in bytes."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))

    @functools.lru_cache(maxsize=None)  # no more entries than there are characters
    def spelled(c: str) -> bool:
        return not c.isspace() and any(model.is_byte(i) for i in model.encode(c))

    return spelled


def _cut(text: str) -> list[str]:
    """Pieces of about PIECE characters, cut only before a space after another character, where a token begins."""
    out, at = [], 0
    while len(text) - at > PIECE:
        m = CUT.search(text, at + PIECE)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]] if at < len(text) else out


def pieces(text: str) -> list[str]:
    """The text in pieces whose tokens, one after the other, are the text's.

    A run of LONG_RUN white-space characters is a piece by itself, which the pattern takes as one: the whole run at the end of the text,
    or else all but its last character, which may begin the next word's token.
    """
    out, at = [], 0
    for m in RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += [*_cut(text[at : m.start()]), text[m.start() : end]]
        at = end
    return out + _cut(text[at:])


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of `width` words that the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    key = ids[:n]
    for k in range(1, width):
        if int(key.max() + 1) * len(seen) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(seen) + ids[k : k + n]
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    again = np.zeros(len(words) + 1, np.int64)
    hit = np.flatnonzero(count[which] > 1)
    np.add.at(again, hit, 1)
    np.add.at(again, hit + width, -1)
    return int((np.cumsum(again) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text_bytes(text)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    return len(words), len(raw.translate(None, WHITE).decode()), len(raw) - len(raw.translate(
        None, SYMBOLS,
    )), len(lines) - len(set(lines)), repeat_words(words)


def script_name(text: str) -> str:
    """The first word of the names of most letters, as LATIN, ARABIC or THAI, with one name for those of East Asia; empty without letters."""
    if text.isascii():
        return "LATIN" if any(c.isalpha() for c in text) else ""
    counts: dict[str, int] = {}
    for c, n in Counter(text).items():
        if c.isalpha():
            name = unicodedata.name(c, "").split(" ")[0]
            name = "CJK" if name in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL") else name
            counts[name] = counts.get(name, 0) + n
    return max(counts, key=lambda k: (counts[k], k), default="")


def script(text: str) -> str:
    """The script of most letters if it has a band, or else empty."""
    name = script_name(text)
    return name if name in BANDS else ""


def fertility(text: str, vocabulary: str) -> tuple[int, float | None, float | None, float | None]:
    """Tokens, characters per token, share of tokens that are part of a character, relative entropy."""
    encode, partial = encoder(vocabulary)
    ids = np.asarray(encode(text), np.int64)
    if not len(ids):
        return 0, None, None, None
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    entropy = float(-(share * np.log2(share)).sum()) / max(1.0, float(np.log2(min(len(ids), FULL_LENGTH))))
    return len(ids), len(text) / len(ids), float(partial[ids].mean()), entropy


def spelled_share(text: str, vocabulary: str) -> float | None:
    """Share of the characters that the vocabulary of pieces spells in bytes."""
    spelled = speller(vocabulary)
    rare = {c for c in set(text) if spelled(c)}
    if not rare:
        return 0.0 if text else None
    counts = Counter(text)
    return sum(counts[c] for c in rare) / len(text)


class Rules(NamedTuple):
    vocabulary: str = VOCABULARY
    pieces: str = PIECES
    bands: dict = BANDS
    piece_bands: dict = PIECE_BANDS
    min_words: int = 50
    most_repeated: int = 50

    def failed(self, base: tuple) -> bool:
        return base[0] < self.min_words or 100 * base[4] > self.most_repeated * base[0]

    def key(self, text: str, lang: str | None) -> str:
        """The language or script whose band holds."""
        if lang in self.bands:
            return lang
        name = script_name(text)
        return name if name in self.bands else ""


def _judge_udf(rules: Rules) -> Callable:
    @F.arrow_udf(RESULT)
    def judged(text: pa.Array, lang: pa.Array) -> pa.Array:
        rows = []
        for t, code in zip(text, lang, strict=True):
            t, code = t.as_py() or "", code.as_py()
            base = base_counts(t)
            failed, key = rules.failed(base), rules.key(t, code)
            n, per, fallback, entropy = fertility(t, rules.vocabulary)
            spelled = spelled_share(t, rules.pieces)
            low, high, share, least = rules.bands[key]
            good = not failed and n > 0 and low <= per <= high and fallback <= share and entropy >= least and spelled <= rules.piece_bands.get(key, 1.0)
            rows.append((*base, failed, n, per, fallback, entropy, spelled, good))
        kind = pa.struct([(f"c{i}", k) for i, k in enumerate([pa.int64()] * 5 + [pa.bool_(), pa.int64()] + [pa.float64()] * 4 + [pa.bool_()])])
        names = [x.split(":")[0] for x in RESULT[7:-1].split(",")]
        columns = [pa.array([r[i] for r in rows], kind.field(i).type) for i in range(len(names))]
        return pa.StructArray.from_arrays(columns, names)

    return judged


def _figures_udf(rules: Rules) -> Callable:
    """Script and figures of the texts that pass the base rule and whose script has no band; null for others."""

    @F.arrow_udf("struct<script:string,per:double,fallback:double,entropy:double>")
    def figures(text: pa.Array) -> pa.Array:
        rows = []
        for t in text:
            t = t.as_py() or ""
            name = script_name(t)
            measured = name and name not in rules.bands and not rules.failed(base_counts(t))
            rows.append({"script": name} | dict(zip(
                ("per", "fallback", "entropy"), fertility(t, rules.vocabulary)[1:], strict=True,
            )) if measured else None)
        return pa.array(
            rows,
            pa.struct([
                ("script", pa.string()), ("per", pa.float64()), ("fallback", pa.float64()), ("entropy", pa.float64()),
            ]),
        )

    return figures


def with_script_bands(docs: DataFrame, text_col: str, lang_col: str, rules: Rules) -> Rules:
    """The rules with bands, from all documents of docs, for each script that has none; there are no more rows to gather than scripts."""
    lang = col(lang_col).cast("string")
    other = docs.where(lang.isNull() | ~lang.isin(*rules.bands)).select(
        _figures_udf(rules)(col(text_col)).alias("f")
    ).where("f IS NOT NULL").select("f.*")
    quartiles = {x: F.percentile_approx(x, [0.25, 0.75], 10_000).alias(x) for x in ("per", "fallback", "entropy")}
    found = {r["script"]: r for r in other.groupBy("script").agg(
        F.count("*").alias("n"), *quartiles.values(),
    ).collect()}
    widest = rules.bands[""]

    def band(r) -> tuple:
        def fence(x: str, side: int) -> float:
            low, high = r[x]
            return (low, high)[side > 0] + side * FENCE * (high - low)

        own = (fence("per", -1), fence("per", 1), fence("fallback", 1), fence("entropy", -1))
        return tuple((r["n"] * a + PRIOR_DOCS * b) / (r["n"] + PRIOR_DOCS) for a, b in zip(own, widest, strict=True))

    return rules._replace(bands=rules.bands | {k: band(r) for k, r in found.items()})


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **rules,
) -> DataFrame:
    """One row for each row of docs: its id, the counts and figures, base_failed and kept; rules: fields of Rules."""
    full = with_script_bands(docs, text_col, lang_col, Rules(**rules))
    out = docs.select(
        col(id_col).alias("doc_id"), _judge_udf(full)(col(text_col), col(lang_col).cast("string")).alias("r"),
    )
    return out.select(F.col("doc_id").alias(id_col), "r.*")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **rules) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    r, full = fresh(docs, "judged"), with_script_bands(docs, text_col, lang_col, Rules(**rules))
    out = docs.withColumn(r, _judge_udf(full)(col(text_col), col(lang_col).cast("string")))
    return out.where(F.col(f"{r}.kept")).select(*map(col, docs.columns))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
