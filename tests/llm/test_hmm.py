import math
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkwright.llm import hmm
from tests.llm.helpers import empty, odd, prose


def counts(docs):
    c = Counter()
    for i, t in docs:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            c.update([*(t or "").encode().lower().split(), b"\n"])
    return c


def test_query_base_and_held_out(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    c = counts(docs)
    n, v, texts = sum(c.values()), len(c), dict(docs)
    got = hmm.op8_hmm_scores(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        w = [*texts[r["doc_id"]].encode().lower().split(), b"\n"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)  # scores are negative


def params(states=3):
    rng = np.random.default_rng(1)
    p = hmm.start(rng.integers(0, 9, hmm.CLASSES).astype(float), states, 2)
    return p._replace(turn=rng.dirichlet(np.ones(states), states), first=rng.dirichlet(np.ones(states)))


def test_forward_is_the_sum_over_all_paths():
    p, cls = params(), np.array([5, 9, 5, 1, 0])
    total = 0.0
    for path in np.ndindex(*[3] * len(cls)):
        x = p.first[path[0]] * p.emit[cls[0], path[0]]
        for a, b, k in zip(path, path[1:], cls[1:], strict=False):
            x *= p.turn[a, b] * p.emit[k, b]
        total += x
    got = hmm.forward(np.concatenate([cls, [3]]), np.array([0, 5]), np.array([5, 1]), p)
    assert got[0] == pytest.approx(math.log10(total)) and got[1] == pytest.approx(math.log10(p.first @ p.emit[3]))


def test_expected_counts_against_plain_recursion():
    p, rng = params(4), np.random.default_rng(3)
    cls, lengths = rng.integers(0, 50, 600), np.array([200, 1, 150, 249])
    starts, begins = np.cumsum(lengths) - lengths, np.array([True, True, False, True])
    emit, first, turn = np.zeros((50, 4)), np.zeros(4), np.zeros((4, 4))
    for s, n, b in zip(starts, lengths, begins, strict=True):
        a, scale = np.zeros((n, 4)), np.zeros(n)
        x = p.first if b else p.later
        for t in range(n):
            x = (x if t == 0 else x @ p.turn) * p.emit[cls[s + t]]
            scale[t] = x.sum()
            a[t] = x = x / scale[t]
        beta = np.ones((n, 4))
        for t in range(n - 2, -1, -1):
            beta[t] = p.turn @ (p.emit[cls[s + t + 1]] * beta[t + 1]) / scale[t + 1]
        np.add.at(emit, cls[s : s + n], a * beta)
        first += (a * beta)[0] * b
        for t in range(1, n):
            turn += np.outer(a[t - 1], p.emit[cls[s + t]] * beta[t] / scale[t]) * p.turn
    seen, w, f, x = hmm.expected(cls, starts, lengths, begins, p)
    got = np.stack([np.bincount(seen, weights=w[:, k], minlength=50) for k in range(4)], 1)
    assert np.allclose(got, emit, atol=1e-3) and np.allclose(f, first, atol=1e-3) and np.allclose(x, turn, atol=1e-2)


def test_training_does_not_lose_likelihood(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, six = ({r["doc_id"]: r["score"] for r in hmm.score_documents(docs, rounds=k).where("not held_out").collect()} for k in (1, 6))
    assert sum(six.values()) > sum(one.values())


def test_words_of_the_model_sum_to_one():
    """Over known words and the unknown word of each class, given any state."""
    c = {b"one": 3, b"two": 1, b"three": 0}
    cls = {w: hmm.word_class(w) for w in c}
    mass = np.zeros(hmm.CLASSES)
    for w, n in c.items():
        if n:
            mass[cls[w]] += n + 1
    mass += 1
    for k in set(cls.values()):
        assert sum((n + 1) / mass[k] for w, n in c.items() if n and cls[w] == k) + 1 / mass[k] == pytest.approx(1)


def test_pack_round_trip():
    x = np.array([0, 1, 255, 256, 2**31, 7])
    assert (hmm.unpack(hmm.pack(x), len(x)) == x).all()


def test_odd_documents(spark):
    df = odd(spark, "held words place c block_id")
    got = hmm.score_documents(df).collect()
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    c = counts(docs)
    assert len(got) == len(docs) and all(r["train_tokens"] == sum(c.values()) and math.isfinite(r["score"]) for r in got)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(i), len((t or "").encode().split()) + 1) for i, t in docs)
    assert hmm.score_documents(empty(spark)).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    alone = hmm.score_documents(spark.createDataFrame([(held[0], "a b")], "doc_id bigint, text string")).collect()
    assert alone[0]["train_tokens"] == alone[0]["n_known"] == 0 and alone[0]["base_score"] == 0


def test_stretches_of_a_long_text_give_the_counts_of_the_whole():
    p, rng = params(4), np.random.default_rng(8)
    cls = rng.integers(0, 50, 1001)
    whole = hmm.recursions(cls, np.array([0]), np.array([1001]), np.array([True]), p)
    want = np.stack([np.bincount(whole.seen, weights=whole.weights[:, k], minlength=50) for k in range(4)], 1)
    for lot in (100, 1000, 1001, 5000):
        parts = list(hmm.stretches(cls, p, lot))
        got = np.stack([sum(np.bincount(x.seen, weights=x.weights[:, k], minlength=50) for x in parts) for k in range(4)], 1)
        assert np.allclose(got, want, atol=1e-3) and np.allclose(sum(x.first for x in parts), whole.first, atol=1e-4) and np.allclose(sum(x.turns for x in parts), whole.turns, atol=1e-2)


def test_score_by_brute_force(spark):
    """Baum-Welch over whole texts and the scaled forward recursion, both by plain loops, give the query's scores."""
    rows = [(i, prose(i + 1, 5 + 7 * i)) for i in range(12)] + [(50, None)]
    docs = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t in rows]
    train = [w for i, w in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for d in train for w in d)
    k, n = np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES)
    for w, m in c.items():
        k[hmm.word_class(w)] += m
        n[hmm.word_class(w)] += 1
    states, prior, p = 3, hmm.class_prior(k), hmm.start(k, 3, hmm.SEED)
    for _ in range(2):
        emit, first, turn = np.zeros((hmm.CLASSES, states)), np.zeros(states), np.zeros((states, states))
        for cls in ([hmm.word_class(w) for w in d] for d in train):
            a = [p.first * p.emit[cls[0]]]
            for x in cls[1:]:
                a.append(a[-1] / a[-1].sum() @ p.turn * p.emit[x])
            b = np.ones(states)
            for t in range(len(cls) - 1, -1, -1):
                g = a[t] / a[t].sum() * b
                emit[cls[t]] += g / g.sum()
                if t:
                    y = np.outer(a[t - 1] / a[t - 1].sum(), p.emit[cls[t]] * b) * p.turn
                    turn += y / y.sum()
                    b = p.turn @ (p.emit[cls[t]] * b)
                    b = b / (a[t - 1] / a[t - 1].sum() @ b)
                else:
                    first += g / g.sum()
        one = (first + 1) / (first + 1).sum()
        turn = turn + hmm.TURN_PRIOR / states
        p = hmm.Params(one, one, turn / turn.sum(1, keepdims=True), (emit + hmm.PRIOR * prior[:, None]) / (emit.sum(0) + hmm.PRIOR))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in hmm.score_documents(df, states=3, rounds=2).collect()}
    for i, d in docs:
        cls = [hmm.word_class(w) for w in d]
        like, a = 0.0, p.first
        for t, x in enumerate(cls):
            a = (a if t == 0 else a @ p.turn) * p.emit[x]
            like += math.log10(a.sum())
            a = a / a.sum()
        like += sum(math.log10((c[w] + 1) / (k[x] + n[x] + 1)) for w, x in zip(d, cls, strict=True))
        assert got[i] == pytest.approx(like, rel=1e-4)
