import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwright.llm import token_counts as tc
from tests.llm.helpers import empty, odd


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tc.TOKENIZER))
    return lambda s: len(t.encode(s, add_special_tokens=False))


def test_query_equals_the_library(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in tc.op9_token_counts(spark, sf).collect():
        t = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), library(t), library(t) > 2048)


CASES = ["", " ", "hello world", "İstanbul ﬁ x\x85y", "don't'S 've foo'll 123 4a", "<|startoftext|> hi <|endoftext|>x", "a<|endoftext|>b", "\x1c\x1d", "ǅ Σας ΑΣ", "日本語", "a​b", "é K", "'ſ", "<|ENDOFTEXT|>", "'r", "'re", "''s !'s 'l", "'", "'v", "it'sabc 'llama", "😂" * 9, "a" * 5000, "!" * 300, "x '", "'s" * 20, "1'2'd"]


@pytest.mark.parametrize("text", CASES)
def test_cases(text, library):
    assert tc.counter(tc.TOKENIZER).count([text])[0] == library(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abcdeéŸßstrvlm'' \n\t12!#<|>😂日İΣ", max_size=60), min_size=1, max_size=8))
def test_any_text(library, texts):
    assert tc.counter(tc.TOKENIZER).count(texts).tolist() == [library(t) for t in texts]


def test_chunked_scan_equals_a_walk():
    rng = np.random.default_rng(1)
    to, begins = tc._scanner()
    for n in (1, 2, 17, 400, 3000):
        points = np.array([ord(x) for x in rng.choice(list("ab'srevl 1!"), n)], np.uint32)
        state, want = tc.BETWEEN, []
        for i, k in enumerate(tc.classify(points)):
            if begins[k, state]:
                want.append(i)
            state = to[k, state]
        begin, end = tc.piece_bounds(points)
        assert begin.tolist() == want and (end > begin).all()


def test_compose_scan():
    maps = np.random.default_rng(2).integers(0, 5, (37, 5)).astype(np.uint8)
    want, now = [], np.arange(5)
    for m in maps:
        now = m[now]
        want.append(now)
    assert (tc.compose_scan(maps) == np.array(want)).all()


def test_tables_start_anew(monkeypatch, library):
    monkeypatch.setattr(tc, "KEPT", 5)
    monkeypatch.setattr(tc, "KEPT_PIECES", 5)
    c = tc.TokenCounter(__import__("public_tokenizers").path(tc.TOKENIZER))
    for t in ("one two three four five six seven", "eight nine ten eleven", "unbelievable internationalization"):
        assert c.count([t])[0] == library(t)


def test_odd_documents(spark, library):
    df = odd(spark, "n_tokens n_bytes over_limit")
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in tc.count_tokens(df).collect())
    assert got == sorted((str(r["doc_id"]), library(r["text"] or "")) for r in df.collect())
    assert tc.count_tokens(empty(spark)).count() == 0
