"""LM scoring by a hidden Markov language model.

Tokens are lower-cased words and one end for each text. A state emits a class of words (a hash of the word's
last four bytes and its length), and a class emits its words by their training counts, so the states' tables
are of fixed size while the counts of words, which know no bound, stay a Spark table.

1. Documents become blocks of tokens, each with its own dictionary, so that later joins move a word once for
   each block and not once for each token.
2. Words are counted over all training documents; the sums by class are 2**16 rows at most.
3. Baum-Welch: each task runs the scaled forward and backward recursions over its blocks, Spark adds up the expected
   counts by class over all tasks, and the driver, which gets tables of fixed size only, makes the next parameters.
4. The counts are joined to the dictionaries, and each block scores its documents by the scaled forward recursion,
   which gives the exact likelihood of the whole text.

Neither training nor scoring cuts a text: each is one sequence, from its first word to its end. Sequences of like length are trained together,
LOT tokens at a time. A longer one passes in stretches of LOT tokens: the forward state at the end of each is kept, and
the stretches are computed again from the last to the first with the backward state of the one after, so memory is bounded and the
expected counts are those of the whole. The parameters start from a seeded perturbation of the class counts, so reruns agree up to
the order in which floats are added.

A state's tables are by class, so states tell classes apart but not the words of one class.

Smoothing: a class gives unknown words one count, and each known word one more than its own. The base score is
the add-one unigram model.

Defined results: a null or empty text has the end as its only token. A null id counts as an empty one when held-out documents are
chosen, so it is a training document. Rows that repeat are each counted and scored. Without training tokens, every
token is unknown. There are no ties. Other columns are passed over. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialize, table

CLASS_BITS, STATES, ROUNDS, SEED = 16, 8, 6, 17
CLASSES = 1 << CLASS_BITS
#: Tokens of a block, of a longer text alone if need be, and of the sequences that are trained on at once.
BLOCK, LOT = 1 << 22, 1 << 19
#: Weight of the prior of a state's classes, in tokens, and of its transitions.
PRIOR, TURN_PRIOR = 200.0, 10.0
#: White space cannot be a word, so this stands for the end.
END, END_CLASS = b"\n", 0
BLOCK_TYPE = "block0 bigint, block1 bigint, doc_ids array<string>, held array<boolean>, lengths array<bigint>, tokens binary, classes binary, words array<bigint>, counts array<bigint>"


class Params(NamedTuple):
    first: np.ndarray  # of a text
    later: np.ndarray  # of a stretch of a text, given what comes before it
    turn: np.ndarray
    emit: np.ndarray  # a row for each class


def word_id(word: bytes) -> int:
    """The class in the leading 16 bits and 48 bits of the word's hash after it, as a signed long."""
    x = word_class(word) << 48 | xxhash.xxh3_64_intdigest(word) & (1 << 48) - 1
    return x - (1 << 64) if x >> 63 else x


def word_class(word: bytes) -> int:
    if word == END:
        return END_CLASS
    return xxhash.xxh3_64_intdigest(word[-4:] + bytes([min(len(word), 8)])) % (CLASSES - 1) + 1


def pack(x: np.ndarray) -> bytes:
    """Numbers under 2**32 in planes of bytes, compressed."""
    return pa.compress(
        np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True,
    )


def unpack(b: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(b, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)


def numbered() -> defaultdict[bytes, int]:
    """A dictionary that numbers its keys as they come."""
    d: defaultdict[bytes, int] = defaultdict()
    d.default_factory = d.__len__
    return d


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = numbered()
    ids: list[str | None] = []
    held: list[bool] = []
    tokens: list[np.ndarray] = []
    size = 0

    def block() -> pa.RecordBatch:
        lengths = np.array([len(t) for t in tokens], np.int64)
        flat = np.concatenate(tokens)
        trained = flat[np.repeat(~np.array(held), lengths)]
        words = list(known)
        wids = np.array([word_id(w) for w in words], np.int64)
        classes = wids.view(np.uint64) >> np.uint64(48)
        # by content, so a task that runs again gives the same name
        name = np.frombuffer(
            xxhash.xxh3_128_digest(repr(ids).encode() + wids.tobytes() + flat.tobytes()), np.int64,
        ).tolist()
        columns = [
            *([x] for x in name), [ids], [held], [lengths], [pack(flat)], [pack(classes)], [wids],
            [np.bincount(trained, minlength=len(words))],
        ]
        kinds = [
            pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(),
            pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            [x.split()[0] for x in BLOCK_TYPE.split(", ")],
        )

    for batch in batches:
        for doc_id, h, text in zip(*batch.columns[:2], batch.column(2).cast(pa.binary()), strict=True):
            words = (text.as_py() or b"").lower().split()
            words.append(END)
            if size and size + len(words) > BLOCK:
                yield block()
                known, ids, held, tokens, size = numbered(), [], [], [], 0
            tokens.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
            ids.append(doc_id.as_py())
            held.append(h.as_py())
            size += len(words)
    if size:
        yield block()


def start(class_counts: np.ndarray, states: int, seed: int) -> Params:
    prior = class_prior(class_counts)
    rng = np.random.default_rng(seed)
    emit = prior[:, None] * (0.5 + rng.random((CLASSES, states)))
    turn = np.full((states, states), 0.3 / max(1, states - 1))
    np.fill_diagonal(turn, 0.7 if states > 1 else 1.0)
    even = np.full(states, 1 / states)
    return Params(even, even, turn, emit / emit.sum(0))


def class_prior(class_counts: np.ndarray) -> np.ndarray:
    return (class_counts + 1) / (class_counts.sum() + CLASSES)


def by_step(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the sequences, the longest first; how many go on at each step; and the tokens' places, step by step."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left") if len(lengths) else np.zeros(0, np.int64)
    return order, active, np.concatenate([starts[:m] + t for t, m in enumerate(active)]) if len(active) else np.zeros(
        0, np.int64,
    )


class Counts(NamedTuple):
    seen: np.ndarray  # the tokens' classes, step by step
    weights: np.ndarray  # their state weights
    first: np.ndarray  # the weights of the texts' first tokens
    turns: np.ndarray
    before: np.ndarray  # for the sequence's first token, what the state before it is multiplied by in its backward state


def expected(
    cls: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begins: np.ndarray, p: Params,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward over all sequences at once: the tokens' classes step by step, their state weights, those of the texts' first tokens, and of the turns."""
    return recursions(cls, starts, lengths, begins, p)[:4]


def recursions(
    cls: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begins: np.ndarray, p: Params,
    after: np.ndarray | None = None,
) -> Counts:
    """The forward and backward recursions of expected; after: the backward state at the end, if what is given goes on."""
    order, active, places = by_step(starts, lengths)
    begins = begins[order]
    first, later, turn = (x.astype(np.float32) for x in (p.first, p.later, p.turn))
    seen = cls[places]
    emit = (p.emit * (1 / class_scale(p)))[seen].astype(np.float32)  # what all states share says nothing about the state
    alphas, scales, turns = np.empty_like(emit), np.empty((len(emit), 1), np.float32), np.zeros_like(p.turn)
    ends = np.cumsum(active)
    a = np.where(begins[:, None], first, later)
    for t, (m, e) in enumerate(zip(active, ends, strict=True)):
        a = (a[:m] if t == 0 else a[:m] @ turn) * emit[e - m : e]
        s = a.sum(1, keepdims=True)
        a = a / s
        alphas[e - m : e], scales[e - m : e] = a, s
    beta = np.ones((active[0] if len(active) else 0, len(first)), np.float32)
    if after is not None:
        beta[:] = after
    n, weights = 0, emit[:0]  # the sequences that go on after the step, and their weights
    for t in range(len(active) - 1, -1, -1):
        m, e = active[t], ends[t]
        here = beta[:m]
        if n:
            f = ends[t + 1]
            x = emit[f - n : f] * beta[:n] / scales[f - n : f]
            turns += alphas[e - m : e - m + n].T @ x
            here[:n] = x @ turn.T
            emit[f - n : f] = weights  # in the place of what is no longer needed
        weights = alphas[e - m : e] * here
        n = m
    before = emit[:1] * beta[:1] / scales[:1]
    if len(active):
        emit[: active[0]] = weights
    return Counts(seen, emit, emit[: len(begins)][begins].sum(0), turns * p.turn, before)


def stretches(cls: np.ndarray, p: Params, lot: int = 0) -> Iterator[Counts]:
    """The counts of one long text, stretch by stretch from the last to the first."""
    cuts = list(range(0, len(cls), lot or LOT))
    entries, a = [p.first], None  # the state's distribution before the first token of each stretch
    scale = class_scale(p)
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        for k in cls[s:e]:
            a = (entries[0] if a is None else a @ p.turn) * (p.emit[k] / scale[k])
            a = a / a.sum()
        entries.append(a)
    after, end = None, len(cls)
    for i in range(len(cuts) - 1, -1, -1):
        here = p._replace(later=entries[i] @ p.turn) if i else p
        got = recursions(cls, np.array([cuts[i]]), np.array([end - cuts[i]]), np.array([i == 0]), here, after)
        across = np.outer(entries[i], got.before[0]) * p.turn if i else 0.0
        yield got._replace(turns=got.turns + across)
        after, end = got.before @ p.turn.T.astype(np.float32), cuts[i]


def class_scale(p: Params) -> np.ndarray:
    """The mean of a class's row, so that float32 holds the ratios."""
    return p.emit.mean(1, keepdims=True)


def _train(params, states: int) -> Callable:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Params = params.value
        emit, first, turn = np.zeros((CLASSES, states)), np.zeros(states), np.zeros((states, states))
        for batch in batches:
            for held, lengths, tokens, classes, n_words in zip(*batch.columns, strict=True):
                lengths, held = np.asarray(lengths.values), np.asarray(held.values.to_numpy(zero_copy_only=False))
                flat = unpack(tokens.as_py(), int(lengths.sum()))
                cls = unpack(classes.as_py(), n_words.as_py())[flat]
                at = np.cumsum(lengths) - lengths
                at, n = at[~held], lengths[~held]
                order = np.argsort(-n, kind="stable")  # texts of like length go together, so few steps have few of them
                at, n = at[order], n[order]
                long = int((n > LOT).sum())
                lots = np.cumsum(n[long:]) // LOT
                of = (np.flatnonzero(lots == lot) + long for lot in np.unique(lots))
                found = (recursions(cls, at[k], n[k], np.ones(len(k), bool), p) for k in of)
                for got in chain(found, *(stretches(cls[at[k] : at[k] + n[k]], p) for k in range(long))):
                    for s in range(states):
                        emit[:, s] += np.bincount(got.seen, weights=got.weights[:, s], minlength=CLASSES)
                    first, turn = first + got.first, turn + got.turns
        rows = np.concatenate([emit, first[None], turn])  # the last 1 + states rows are not classes
        hit = np.flatnonzero(rows.sum(1) > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hit), *(pa.array(rows[hit, s]) for s in range(states))],
            ["row", *(f"s{s}" for s in range(states))],
        )

    return train


def _score(params, states: int, word_mass: np.ndarray, total: int) -> Callable:
    """word_mass: the counts of a class with its smoothing."""

    def score(key, blocks: pa.Table, counts: pa.Table) -> pa.Table:
        p: Params = params.value
        out = []
        for row in blocks.to_batches():
            for ids, held, lengths, tokens, classes, n_words in zip(
                *(row.column(c) for c in ("doc_ids", "held", "lengths", "tokens", "classes", "n_words")), strict=True,
            ):
                n = np.asarray(lengths.values)
                flat = unpack(tokens.as_py(), int(n.sum()))
                word_cls = unpack(classes.as_py(), n_words.as_py())
                c = np.zeros(n_words.as_py(), np.int64)
                c[counts.column("place").to_numpy()] = counts.column("c").to_numpy()
                at = np.cumsum(n) - n
                in_class = np.log10((c + 1) / word_mass[word_cls])[flat]
                base = np.log10((c + 1) / total)[flat]
                likely = forward(word_cls[flat], at, n, p)
                known = (c > 0).astype(np.int64)[flat]
                out.append(pa.table({
                    "doc_id": ids.values, "held_out": held.values, "n_tokens": pa.array(n),
                    "n_known": np.add.reduceat(known, at), "base_score": np.add.reduceat(base, at),
                    "score": likely + np.add.reduceat(in_class, at),
                }))
        return pa.concat_tables(out) if out else pa.schema([
            ("doc_id", pa.string()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
            ("base_score", pa.float64()), ("score", pa.float64()),
        ]).empty_table()

    return score


def forward(cls: np.ndarray, starts: np.ndarray, lengths: np.ndarray, p: Params) -> np.ndarray:
    """Log10 likelihood of the class sequence of each text, all at once, the longest first."""
    order, active, places = by_step(starts, lengths)
    seen, like = cls[places], np.zeros(len(starts))
    a, at = np.tile(p.first, (len(starts), 1)), 0
    for t, m in enumerate(active):
        a = (a[:m] if t == 0 else a[:m] @ p.turn) * p.emit[seen[at : at + m]]
        at += m
        s = a.sum(1)
        like[:m] += np.log10(s)
        a = a / s[:, None]
    out = np.empty(len(starts))
    out[order] = like
    return out


def train(
    blocks: DataFrame, class_counts: np.ndarray, states: int = STATES, rounds: int = ROUNDS, seed: int = SEED,
) -> Params:
    """Baum-Welch over the training documents of all blocks."""
    p, prior = start(class_counts, states, seed), class_prior(class_counts)
    columns = blocks.select("held", "lengths", "tokens", "classes", "n_words")
    kind = "row bigint, " + ", ".join(f"s{s} double" for s in range(states))
    for _ in range(rounds):
        sent = blocks.sparkSession.sparkContext.broadcast(p)
        sums = columns.mapInArrow(
            _train(sent, states), kind,
        ).groupBy("row").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(states)))
        rows = np.zeros((CLASSES + 1 + states, states))
        for part in sums.toArrow().to_batches():  # a row for each class at most
            rows[part.column(0).to_numpy()] = np.stack([part.column(1 + s).to_numpy() for s in range(states)], 1)
        emit, first, turn = rows[:CLASSES], rows[CLASSES], rows[CLASSES + 1 :]
        held, start_of = emit.sum(0), (first + 1) / (first + 1).sum()
        p = Params(
            start_of, start_of, (turn + TURN_PRIOR / states) / (turn + TURN_PRIOR / states).sum(1, keepdims=True),
            (emit + PRIOR * prior[:, None]) / (held + PRIOR),
        )
    return p


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2,
    states: int = STATES, rounds: int = ROUNDS,
) -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    key = F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")), F.lit(0))
    slim = docs.select(
        col(id_col).cast("string").alias("doc_id"), (key % folds == held_fold).alias("held"),
        col(text_col).alias("text"),
    )
    blocks = materialize(slim.mapInArrow(_blocks, BLOCK_TYPE), "token_blocks").withColumn("n_words", F.size("words"))
    words = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(
        F.col("w.words").alias("word"), F.col("w.counts").alias("n"),
    ).where("n > 0")
    vocabulary = materialize(words.groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    class_counts, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    by_class = vocabulary.groupBy(F.shiftrightunsigned("word", 48).alias("k")).agg(
        F.sum("c").alias("c"), F.count("*").alias("v"),
    )
    for part in by_class.toArrow().to_batches():  # a row for each class at most
        class_counts[part.column(0).to_numpy()], class_words[part.column(0).to_numpy()] = part.column(1).to_numpy(), part.column(2).to_numpy()
    sent = spark.sparkContext.broadcast(train(blocks, class_counts, states, rounds))
    held = blocks.select(
        F.col("block0").alias("of0"), F.col("block1").alias("of1"), F.posexplode("words").alias("place", "word"),
    ).join(vocabulary, "word").select("of0", "of1", "place", "c")
    scored = blocks.drop("words", "counts").groupBy("block0", "block1").cogroup(held.groupBy("of0", "of1")).applyInArrow(
        _score(
            sent, states, class_counts + class_words + 1, n + v + 1,
        ), "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col), "held_out", "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op8_hmm_scores(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
