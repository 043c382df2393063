import math
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkwright.llm import quality_classifier as qc
from tests.llm.helpers import empty, odd


def test_held_out_accuracy(spark):
    """Labels of one half train, those of the other half are the test."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    got = {r["doc_id"]: r for r in qc.classify(docs, known).collect()}
    test = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 2]
    assert sum((got[r["doc_id"]]["quality_posterior"] >= 0.5) == bool(r["quality"]) for r in test) > 0.97 * len(test)
    toxic = [r for r in test if r["toxic"]]
    assert sum(got[r["doc_id"]]["toxic_posterior"] >= 0.5 for r in toxic) > 0.9 * len(toxic)
    clean = [r for r in test if r["quality"] and not r["toxic"]]
    assert sum(got[r["doc_id"]]["kept"] for r in clean) > 0.99 * len(clean)


def test_query(spark, sf):
    got = qc.op4_quality_classifier(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and dict(got.dtypes)["kept"] == "boolean"


def test_odd_documents(spark):
    df = odd(spark, "host path e bucket l_quality")
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (8, 1, None), (None, 1, 1), (99, 0, 0), (1, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert qc.classify(df, labels).count() == df.count()
    bare = qc.classify(df, labels.limit(0)).collect()
    assert len(bare) == df.count() and all(abs(r["quality_evidence"]) < 1e-9 for r in bare)
    assert qc.classify(empty(spark), labels).count() == 0


def test_sparse_sites_shrink(spark):
    """A path with one good document stays near its host's rate, one with many goes its own way."""
    rows = [("h", "big", 1.0)] * 400 + [("h", "other", 0.0)] * 400 + [("h", "tiny", 1.0)] + [("g", "big", 0.5)] * 400
    _, paths = qc.site_rates(spark.createDataFrame(rows, "host string, path string, quality double"), "quality")
    rate = {(r["host"], r["path"]): (r["host_rate"], r["path_rate"]) for r in paths.collect()}
    assert rate["h", "big"][1] > 0.9 and rate["h", "other"][1] < 0.1
    host, tiny = rate["h", "tiny"]
    assert host < tiny < 0.9


def plain_features(text):
    """The distinct features of a text of ASCII, by regular expressions."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    punctuation = "[" + re.escape(string.punctuation) + "]"
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    plain = re.findall(r"[^\x20\x09-\x0D]+", re.sub(punctuation, "", lower))
    out = set(plain)
    for w in words:
        if not re.fullmatch("[A-Za-z]+", w):
            out.add("\x01" + re.sub(r"(.)\1+", r"\1", re.sub("[A-Za-z]", "a", re.sub("[0-9]", "0", w))))
    n, distinct = max(1, len(words)), len(out)
    size = len(f"{n:b}")
    out |= {
        f"\x02size {size}", f"\x02distinct {size} {20 * distinct // n}", f"\x02symbols {20 * len(re.findall(punctuation, text)) // n}",
        f"\x02length {len(text) // n}", f"\x02lines {20 * text.count(chr(10)) // n}",
        f"\x02again {20 * sum(a == b for a, b in zip(words, words[1:])) // n}",
    }
    for start in {w[:4] for w in plain if len(w) >= 4}:
        k, level = sum(w.startswith(start) for w in plain), 0
        while k >= 2 and 100 * k >= len(plain) << level:
            out.add(f"\x03{level} {start}")
            level += 1
    return sorted(out)


def plain_buckets(text):
    """The bucket of each feature in the first table, and the one in the second."""
    for f in plain_features(text):
        h = xxhash.xxh3_64_intdigest(f.encode())
        yield h % 2**18, 2**18 + (h >> 32) % 2**18


def test_features_by_plain_loops():
    texts = ["", "a", "Stop, stop! STOP it: 12ab-3 x--y\n\nnow now", "wordy words wordless " * 3 + "worm word-s", "ab " * 500 + "abcd abce", "$$ %% 1234 aAa"]
    for text in texts:
        want = {xxhash.xxh3_64_intdigest(f.encode()) for f in plain_features(text)}
        assert set(qc.features(text).tolist()) == want
    assert sorted(qc.beginnings([b"sham", b"shame", b"x"] * 2)) == [b"\x03%d sham" % k for k in range(7)]
    assert list(qc.beginnings([b"once"] + [b"a"] * 50)) == []
    assert list(qc.beginnings(["ééé".encode()] * 9)) == []


def test_fit_does_not_grow_with_an_ids_rows(spark):
    """Many texts and labels of one id: the sample stays as large as it is, and long texts keep all their features."""
    docs = spark.range(40).select(F.lit(1).alias("doc_id"), F.format_string("%d word", "id").alias("text"), F.lit("s").alias("source"), F.lit("l").alias("lang"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (1, None, None)], "doc_id int, quality int, toxic int")
    assert qc.classify(docs, labels, sample=3).count() == 40
    n = 5000
    long = " ".join(f"only{k:05d}" for k in range(n))
    docs = spark.createDataFrame([(k, long if k % 2 else "short", "s", "l") for k in range(200)], "doc_id bigint, text string, source string, lang string")
    got = qc.classify(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))).collect()
    assert all((r["quality_evidence"] > 0) == bool(r["doc_id"] % 2) for r in got)


def test_by_brute_force(spark):
    """Ratios, regression rows, evidence, site rates and posteriors of a small table, all by plain loops."""
    good, bad = ("clear", "plain", "useful", "sound"), ("vile", "awful", "nasty", "foul")
    rows = [(k, " ".join([*([good, bad][k % 3 == 0][i % 4] for i in range(k % 5 + 3)), f"word{k % 7}"]), "ab"[k % 2], "xyz"[k % 3]) for k in range(60)] + [(60, None, None, "x")]
    labels = {k: (int(k % 3 != 0), int(k % 3 == 0)) for k in range(0, 50)}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    df = spark.createDataFrame([(k, *v) for k, v in labels.items()], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in qc.classify(docs, df).collect()}
    passes = [F.xxhash64("doc_id", F.lit(k)) for k in range(6)]
    of = {r[0]: r[1:] for r in docs.select("doc_id", qc.fold_of(F.col("doc_id")), *passes).collect()}
    text, have = {r[0]: r[1] for r in rows}, {}
    for k, *_ in rows:
        have[k] = {b for pair in plain_buckets(text[k]) for b in pair}

    def ratios(keys):
        table = {}
        for i in range(2):
            yes, no = [k for k in keys if labels[k][i]], [k for k in keys if not labels[k][i]]
            for b in set().union(*(have[k] for k in keys)):
                y, n = sum(b in have[k] for k in yes) + 0.5, sum(b in have[k] for k in no) + 0.5
                r = math.log(y / (len(yes) + 1)) - math.log(n / (len(no) + 1))
                table[b, i] = r * max(0.0, 1 - 2.0**2 * (1 / y + 1 / n) / max(r * r, 1e-12))
        return table

    def values(k, table):
        out = []
        for x, y in plain_buckets(text[k]):
            v = [min(p, q, key=abs) if p * q > 0 else 0.0 for p, q in ((table.get((x, i), 0.0), table.get((y, i), 0.0)) for i in range(2))]
            if any(v):
                out.append((x, v))
        return out

    fit = {k: values(k, ratios([j for j in labels if of[j][0] != of[k][0]])) for k in labels}
    w, g2, offset = Counter(), {}, [0.0, 0.0]
    for step in range(6):
        for k in sorted(labels, key=lambda k: of[k][1 + step]):
            for i in range(2):
                z = sum(w[a, i] * x[i] for a, x in fit[k]) + offset[i]
                miss = 1 / (1 + math.exp(-z)) - labels[k][i]
                for at, grad in [*((a, x[i] * miss) for a, x in fit[k]), (-1, miss)]:
                    g2[at, i] = g2.get((at, i), 1e-2) + grad * grad
                    move = 0.1 / (1 + step) * grad / math.sqrt(g2[at, i])
                    if at < 0:
                        offset[i] -= move
                    else:
                        w[at, i] -= move
    share = [(sum(v[i] for v in labels.values()) + 1) / (len(labels) + 2) for i in range(2)]
    offset = [o - math.log(p / (1 - p)) for o, p in zip(offset, share)]
    full = ratios(list(labels))
    for i, head in enumerate(qc.HEADS):
        e = {k: max(-12.0, min(12.0, sum(w[a, i] * x[i] for a, x in values(k, full)) + offset[i])) for k, *_ in rows}
        for k in e:
            assert got[k][f"{head}_evidence"] == pytest.approx(e[k], abs=1e-3)
        p = (sum(v[i] for v in labels.values()) + 1) / (len(labels) + 2)
        belief = {k: float(labels[k][i]) if k in labels else 1 / (1 + math.exp(-(got[k][f"{head}_evidence"] + math.log(p / (1 - p))))) for k in e}
        judged = spark.createDataFrame([(r[2], r[3], belief[r[0]]) for r in rows], f"host string, path string, {head} double")
        shrink = qc.shrinkage(qc.site_sums(judged, (head,)), head)
        for k, _, host, path in rows:
            others = [(r[2], r[3], belief[r[0]]) for r in rows if r[0] != k]
            world = (sum(b for *_, b in others) + 0.5) / (len(others) + 1)
            in_host = [b for h, _, b in others if h == host]
            rate = (sum(in_host) + shrink.host_weight * world) / (len(in_host) + shrink.host_weight)
            in_path = [b for h, q, b in others if h == host and q == path]
            rate = (sum(in_path) + shrink.path_weight * rate) / (len(in_path) + shrink.path_weight)
            assert got[k][f"{head}_site"] == pytest.approx(rate, abs=1e-6)
            assert got[k][f"{head}_posterior"] == pytest.approx(1 / (1 + math.exp(-(got[k][f"{head}_evidence"] + math.log(rate / (1 - rate))))), abs=1e-6)
    assert all(r["kept"] == (r["quality_posterior"] >= 0.5 and r["toxic_posterior"] < 0.5) for r in got.values())
    assert qc.WEIGHT_RANGE[0] <= shrink.host_weight <= qc.WEIGHT_RANGE[1]


def test_prior_weight_by_plain_sums(spark):
    groups = [(10, 9.0), (20, 4.0), (5, 2.5)]
    got = qc.prior_weight(spark.createDataFrame(groups, "n bigint, s double"), "s", F.lit(0.4))
    q = sum(n * (s / n - 0.4) ** 2 for n, s in groups) - 3 * 0.24
    assert got == pytest.approx(min(10_000, max(2, 35 * 0.24 / q - 1)))
