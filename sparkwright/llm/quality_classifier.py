"""Quality and toxicity by hierarchical empirical Bayes.

1. Evidence: over all labelled documents, Spark counts for each hashed feature (words, word shapes, beginnings of words that make
   up a hundredth of the text or twice, four times as much and so on, and a few plain figures)
   how many documents of each class have it. The log ratio of a feature is shrunk toward zero by its own
   uncertainty, so rare and indifferent features say nothing. Every feature has two buckets of fixed tables and counts
   by the weaker one, so a chance collision in one of them does no harm. As features depend on each other, a logistic
   regression weighs the ratios; it is fitted on a bounded sample of labelled documents (SAMPLE of them, those of the smallest hash of their id, with
   all their features), which one task reads in batches, once for each pass. The ratios that it is fitted on leave out a document's own fold
   of the labels, so a document does not vouch for its own words.
2. Sites: every document counts toward its host and path with its label, or else with the classifier's belief. A host's
   rate is shrunk toward the global rate, and a path's toward its host's; how far follows from how much
   hosts (paths) differ beyond chance, by the method of moments. Sums are grouped in Spark, partially before the shuffle.
3. Posterior: the log odds of the site, as all its other documents give it, plus the evidence of the document, which so counts once. A
   document is kept if it is probably good and probably not toxic.

`documents` has a source but no url, so the source is the host, and the language under it is the path; both
are parameters.

Defined results: a null or empty text has few features and is judged by them and its site. Null hosts and paths are sites of their own.
Labels without a document and null labels are passed over; a document with several labels counts once for each. Without labels of both classes
there is no evidence, and the rates stay at the prior. Rows that repeat are each counted and judged; other columns are passed over. An
empty table gives an empty result. A quality posterior of exactly 0.5 keeps a document, a toxic one of 0.5 does not. A very long text counts by its
distinct features, however many.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap_of, col, in_bitmap, materialize, smallest_hashes, table, text_bytes

HEADS = ("quality", "toxic")
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Bits of the bitmap of labelled ids, as a power of two: 8 MB, however many there are.
BITMAP_BITS = 26
#: Labelled rows that the regression is fitted on, and passes over them.
SAMPLE, PASSES = 20_000, 6
#: Folds of the labels, for the fit alone.
FOLDS = 2
#: Code points of a word's beginning, and the words that must have it.
BEGINNING, LEAST_WORDS = 4, 2
#: A log ratio counts from so many standard errors; the evidence of a document and the prior weight of a site, in documents, lie within bounds.
LEAST_Z, MOST_EVIDENCE, WEIGHT_RANGE = 2.0, 12.0, (2.0, 10_000.0)
PUNCTUATION = string.punctuation.encode()
SHAPES = bytes(ord("a") if chr(b).isalpha() or b > 127 else ord("0") if chr(b).isdigit() else b for b in range(256))


def beginnings(plain: list[bytes]) -> Iterator[bytes]:
    """Beginnings of several words, once for each doubling of their share of the words from a hundredth on."""
    words = Counter()
    for word, n in Counter(plain).items():
        start = word.decode("utf-8", "replace")[:BEGINNING]
        if len(start) == BEGINNING:
            words[start] += n
    for start, n in words.items():
        if n >= LEAST_WORDS:
            for level in range((100 * n // len(plain)).bit_length()):
                yield b"\x03%d " % level + start.encode()


def features(text: str | None) -> np.ndarray:
    """Hashes of the distinct features of a text."""
    raw = text_bytes(text)
    words = raw.split()
    plain = raw.lower().translate(None, PUNCTUATION).split()
    found = set(plain)
    for shape in {w.translate(SHAPES) for w in words if not w.isalpha()}:
        found.add(b"\x01" + bytes(c for i, c in enumerate(shape) if not i or c != shape[i - 1]))
    n = max(1, len(words))
    size, distinct = n.bit_length(), len(found)
    symbols = len(raw) - len(raw.translate(None, PUNCTUATION))
    found |= {
        b"\x02size %d" % size, b"\x02distinct %d %d" % (size, 20 * distinct // n),
        b"\x02symbols %d" % (20 * symbols // n), b"\x02length %d" % (len(raw) // n),
        b"\x02lines %d" % (20 * raw.count(b"\n") // n),
        b"\x02again %d" % (20 * sum(map(bytes.__eq__, words, words[1:])) // n),
    }
    found.update(beginnings(plain))
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in sorted(found)], np.uint64)


def buckets(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(BUCKETS - 1)
    return (h & mask).astype(np.int64), BUCKETS + (h >> np.uint64(32) & mask).astype(np.int64)


KINDS = 2 * len(HEADS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, fold, labels) to the documents that have each bucket, by fold, head and class."""
    sums = np.zeros((2 * BUCKETS + 1, FOLDS * KINDS), np.int32)  # the last row counts all documents
    for batch in batches:
        for text, fold, *labels in zip(*batch.columns, strict=True):
            kinds = [KINDS * fold.as_py() + 2 * i + int(k.as_py() > 0) for i, k in enumerate(labels) if k.is_valid]
            if kinds:
                hit = np.append(np.unique(np.concatenate(buckets(features(text.as_py())))), 2 * BUCKETS)
                for k in kinds:
                    sums[hit, k] += 1
    hit = np.flatnonzero(sums.any(1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(hit), *(pa.array(sums[hit, k].astype(np.int64)) for k in range(sums.shape[1]))],
        ["bucket", *(f"n{k}" for k in range(sums.shape[1]))],
    )


def counts(labelled: DataFrame) -> np.ndarray:
    """labelled(text, fold, labels) to the documents that have each bucket, in the last row all, by fold and kind: a row of each bucket at most comes to the driver."""
    columns = [f"n{k}" for k in range(FOLDS * KINDS)]
    counted = labelled.mapInArrow(_count, "bucket bigint, " + ", ".join(f"{c} bigint" for c in columns))
    out = np.zeros((2 * BUCKETS + 1, FOLDS, KINDS), np.float32)
    for part in counted.groupBy("bucket").agg(*(F.sum(c).cast("float").alias(c) for c in columns)).toArrow().to_batches():
        rows = part.column(0).to_numpy()
        for k in range(len(columns)):
            out[rows, k // KINDS, k % KINDS] = part.column(1 + k).to_numpy()
    return out


def log_ratios(sums: np.ndarray) -> np.ndarray:
    """For each bucket and head, the log ratio of having it in the class and outside, shrunk by its uncertainty; zero where a class is missing."""
    out = np.zeros((2 * BUCKETS, len(HEADS)), np.float32)
    for i in range(len(HEADS)):
        no, yes = (sums[:, k].astype(np.float64) for k in (2 * i, 2 * i + 1))
        (no, all_no), (yes, all_yes) = (no[:-1], no[-1]), (yes[:-1], yes[-1])
        if all_no and all_yes:
            ratio = np.log((yes + 0.5) / (all_yes + 1)) - np.log((no + 0.5) / (all_no + 1))
            error = 1 / (yes + 0.5) + 1 / (no + 0.5)
            out[:, i] = ratio * np.maximum(0, 1 - LEAST_Z**2 * error / np.maximum(ratio**2, 1e-12))
    return out


def active(h: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the features that say something for some head, and their ratios."""
    a, b = buckets(h)
    x, y = ratios[a], ratios[b]
    weak = np.where(np.sign(x) == np.sign(y), np.where(np.abs(x) < np.abs(y), x, y), 0)
    some = weak.any(1)
    return a[some], weak[some]


class Fit(NamedTuple):
    """Weights of buckets and, in the last row, the offset of each head; sums of squared gradients, for AdaGrad."""

    w: np.ndarray
    g2: np.ndarray


def unfitted() -> Fit:
    return Fit(np.zeros((BUCKETS + 1, len(HEADS))), np.full((BUCKETS + 1, len(HEADS)), 1e-2))


def learn(fit: Fit, at: np.ndarray, x: np.ndarray, labels: np.ndarray, rate: float) -> None:
    """One step of AdaGrad, in place, by one document's buckets, their ratios and its labels, NaN where unknown."""
    w, g2 = fit
    z = (w[at] * x).sum(0) + w[-1]
    miss = np.nan_to_num(1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
    grad = x * miss
    g2[at] += grad * grad
    w[at] -= rate * grad / np.sqrt(g2[at])
    g2[-1] += miss * miss
    w[-1] -= rate * miss / np.sqrt(g2[-1])


def _pass(before, rate: float) -> Callable:
    """Learns from (at, x, labels) row by row, from the broadcast fit on; gives out the rows of the fit that then differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = Fit(*(v.copy() for v in before.value))
        for batch in batches:
            labels = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(HEADS))], 1)
            for at, x, known in zip(batch.column(0), batch.column(1), labels, strict=True):
                learn(fit, at.values.to_numpy(), x.values.to_numpy().reshape(-1, len(HEADS)), known, rate)
        hit = np.flatnonzero((fit.g2 != before.value.g2).any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(hit), *(pa.array(v[hit, i]) for v in fit for i in range(len(HEADS)))],
            ["bucket", *(f"{v}{i}" for v in Fit._fields for i in range(len(HEADS)))],
        )

    return run


def regress(rows: DataFrame, passes: int = PASSES) -> Fit:
    """rows(doc_id, key, at, x, labels as doubles), a bounded sample, to a logistic regression: one task reads them in another order at each pass, and hands on a row of each bucket at most."""
    spark, fit = rows.sparkSession, unfitted()
    found = ", ".join(f"{v}{i} double" for v in Fit._fields for i in range(len(HEADS)))
    labels = [f"l_{x}" for x in HEADS]
    for k in range(passes):
        order = [F.xxhash64("doc_id", F.lit(k)), F.col("doc_id"), F.col("key"), *map(F.col, labels)]
        one = rows.coalesce(1).sortWithinPartitions(*order).select("at", "x", *labels)
        sent = spark.sparkContext.broadcast(fit)
        got = one.mapInArrow(_pass(sent, 0.1 / (1 + k)), f"bucket bigint, {found}").toArrow()
        hit = got.column(0).to_numpy()
        fit = Fit(*(v.copy() for v in fit))
        for j, v in enumerate(fit):
            for i in range(len(HEADS)):
                v[hit, i] = got.column(1 + j * len(HEADS) + i).to_numpy()
        sent.destroy()
    return fit


class Model(NamedTuple):
    ratios: np.ndarray
    weights: np.ndarray
    offset: np.ndarray  # of the log odds, less those of the sample's classes


def evidence(h: np.ndarray, m: Model) -> np.ndarray:
    """The log ratio of each head that the text speaks for."""
    at, x = active(h, m.ratios)
    return np.clip((m.weights[at] * x).sum(0) + m.offset, -MOST_EVIDENCE, MOST_EVIDENCE)


def _active_udf(by_fold) -> Callable:
    """by_fold: for each fold the ratios that the other folds give."""

    @F.arrow_udf("struct<at:array<int>,x:array<float>>")
    def active_features(text: pa.Array, fold: pa.Array) -> pa.Array:
        rows = [active(features(t.as_py()), by_fold.value[k.as_py()]) for t, k in zip(text, fold, strict=True)]
        return pa.StructArray.from_arrays(
            [
                pa.array([a.astype(np.int32) for a, _ in rows], pa.list_(pa.int32())),
                pa.array([x.ravel() for _, x in rows], pa.list_(pa.float32())),
            ],
            ["at", "x"],
        )

    return active_features


def _evidence_udf(model) -> Callable:
    @F.arrow_udf("array<double>")
    def doc_evidence(text: pa.Array) -> pa.Array:
        return pa.array([evidence(features(t.as_py()), model.value) for t in text], pa.list_(pa.float64()))

    return doc_evidence


def _log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _belief(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def prior_weight(groups: DataFrame, s: str, toward: Column) -> float:
    """How many documents a rate that groups(n, and s: sum of beliefs) shrink toward counts for, by moments over all groups."""
    low, high = WEIGHT_RANGE
    spread = F.col(s) / F.col("n") - toward
    sums = groups.agg(
        F.sum(F.col("n") * spread * spread).alias("q"), F.sum(toward * (1 - toward)).alias("chance"),
        F.sum(toward * (1 - toward) * F.col("n")).alias("var"),
    ).first()
    beyond = (sums["q"] or 0.0) - (sums["chance"] or 0.0)  # squared differences beyond what chance gives
    return min(high, max(low, (sums["var"] or 0.0) / beyond - 1 if beyond > 0 else high))


class Shrinkage(NamedTuple):
    """Of one head: sums over all documents, and the prior weights of hosts and paths, in documents."""

    n: int
    s: float
    host_weight: float
    path_weight: float

    def rates(self, s: Column, host_s: Column, own: Column | float = 0.0, out: int = 0) -> tuple[Column, Column]:
        """Rates of the host and of the path; with out = 1 those that a site has without one document and its own belief."""
        world = (F.lit(self.s) - own + 0.5) / (self.n - out + 1)
        host = (host_s - own + self.host_weight * world) / (F.col("host_n") - out + self.host_weight)
        return host, (s - own + self.path_weight * host) / (F.col("n") - out + self.path_weight)


def site_sums(judged: DataFrame, heads: tuple[str, ...] = HEADS) -> DataFrame:
    """judged(host, path, and a belief for each head) to a row for each path: n and sums, of itself and of its host."""
    paths = materialize(
        judged.groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(x).alias(f"{x}_s") for x in heads)),
        "paths",
    )
    hosts = paths.groupBy(F.col("host").alias("h")).agg(
        F.sum("n").alias("host_n"), *(F.sum(f"{x}_s").alias(f"{x}_host_s") for x in heads),
    )
    return materialize(paths.join(materialize(hosts, "hosts"), F.col("host").eqNullSafe(F.col("h"))).drop("h"), "sites")


def shrinkage(sites: DataFrame, head: str) -> Shrinkage:
    n, s = sites.agg(F.sum("n"), F.sum(f"{head}_s")).first()
    world = ((s or 0.0) + 0.5) / ((n or 0) + 1)
    hosts = sites.groupBy("host").agg(F.first("host_n").alias("n"), F.first(f"{head}_host_s").alias("s"))
    found = Shrinkage(n or 0, s or 0.0, prior_weight(hosts, "s", F.lit(world)), 0.0)
    host, _ = found.rates(F.col(f"{head}_s"), F.col(f"{head}_host_s"))
    return found._replace(path_weight=prior_weight(sites, f"{head}_s", host))


def site_rates(judged: DataFrame, head: str) -> tuple[DataFrame, DataFrame]:
    """judged(host, path, belief of the head) to the rates of hosts, and of paths under hosts."""
    sites = site_sums(judged, (head,))
    host, path = shrinkage(sites, head).rates(F.col(f"{head}_s"), F.col(f"{head}_host_s"))
    paths = sites.select("host", "path", host.alias("host_rate"), path.alias("path_rate"))
    return paths.select(F.col("host").alias("h"), "host_rate").distinct(), paths


def _maybe_labelled(bitmap) -> Callable:
    @F.arrow_udf(T.BooleanType())
    def maybe_labelled(h: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(h.to_numpy().view(np.uint64), bitmap.value, BITMAP_BITS))

    return maybe_labelled


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("fold")), F.lit(FOLDS)).cast("int")


def _fitted(slim: DataFrame, known: DataFrame, ratios: np.ndarray, by_fold: list[np.ndarray], sample: int) -> Model:
    """The regression over `sample` labelled rows of the smallest hash of their id, each by the ratios of the other folds."""
    sent = slim.sparkSession.sparkContext.broadcast(by_fold)
    chosen = F.broadcast(smallest_hashes(known, "l_id", sample, known.count()))
    rows = slim.join(chosen, F.col("doc_id") == F.col("l_id")).select(
        "doc_id", F.xxhash64("text").alias("key"), "text",
        *(F.col(f"l_{x}").cast("double").alias(f"l_{x}") for x in HEADS),
    )
    labels = [f"l_{x}" for x in HEADS]
    keys = ["doc_id", "key", *labels]
    some = rows.dropDuplicates(keys).withColumn("f", _active_udf(sent)("text", fold_of(F.col("doc_id"))))
    few = materialize(some.select("doc_id", "key", "f.at", "f.x", *((F.col(x) > 0).cast("double").alias(x) for x in labels)), "fit")
    if few.count() > sample:  # an id has several texts or labels
        first = few.select(*(F.col(x).alias(f"k_{x}") for x in keys)).orderBy(
            F.xxhash64("k_doc_id"), *(f"k_{x}" for x in keys),
        ).limit(sample)
        same = [F.col(x).eqNullSafe(F.col(f"k_{x}")) for x in keys]
        few = materialize(few.join(F.broadcast(first), same, "left_semi"), "fit_few")
    fit = regress(few)
    sums = few.agg(*(f(x).alias(f"{n}{x}") for x in labels for n, f in (("n", F.count), ("s", F.sum)))).first()
    share = np.array([((sums[f"s{x}"] or 0) + 1) / (sums[f"n{x}"] + 2) for x in labels])
    return Model(ratios, fit.w[:-1], fit.w[-1] - np.log(share / (1 - share)))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    path_col: str = "lang", label_id: str = "doc_id", sample: int = SAMPLE,
) -> DataFrame:
    """One row for each row of docs: id, evidence, site rate (of the site's other documents) and posterior of each head, and kept."""
    spark = docs.sparkSession
    slim = docs.select(
        col(id_col).alias("doc_id"), col(text_col).alias("text"), col(host_col).alias("host"),
        col(path_col).alias("path"),
    )
    known = labels.where(col(label_id).isNotNull()).select(
        col(label_id).alias("l_id"), *(col(x).cast("int").alias(f"l_{x}") for x in HEADS),
    )
    bitmap = spark.sparkContext.broadcast(bitmap_of(known.select(F.xxhash64("l_id").alias("h")), "h", BITMAP_BITS))
    some = slim.select("doc_id", "text").where(_maybe_labelled(bitmap)(F.xxhash64("doc_id")))  # spares the shuffle most texts without a label
    # one way to join at every size, as Spark would send few labels to all tasks
    labelled = some.join(known.hint("merge"), F.col("doc_id") == F.col("l_id")).select(
        "text", fold_of(F.col("doc_id")), *(f"l_{x}" for x in HEADS),
    )
    each = counts(labelled)
    sums = each.sum(1)
    ratios = log_ratios(sums)
    rates = {x: (sums[-1, 2 * i + 1] + 1) / (sums[-1, 2 * i : 2 * i + 2].sum() + 2) for i, x in enumerate(HEADS)}
    prior = {x: float(np.log(p / (1 - p))) for x, p in rates.items()}
    model = spark.sparkContext.broadcast(_fitted(
        slim, known, ratios, [log_ratios(each[:, 1 - k]) for k in range(FOLDS)], sample,
    ))
    once = known.groupBy("l_id").agg(*(F.avg((F.col(f"l_{x}") > 0).cast("double")).alias(f"l_{x}") for x in HEADS))
    judged = slim.select("doc_id", "host", "path", _evidence_udf(model)("text").alias("e"))
    judged = judged.select(
        "doc_id", "host", "path", *(F.get("e", F.lit(i)).alias(f"{x}_evidence") for i, x in enumerate(HEADS)),
    )
    judged = judged.join(once, F.col("doc_id") == F.col("l_id"), "left")
    judged = materialize(
        judged.withColumns({x: F.coalesce(f"l_{x}", _belief(F.col(f"{x}_evidence") + prior[x])) for x in HEADS}),
        "evidence",
    )
    sites = site_sums(judged)
    known_sites = sites.withColumnsRenamed({"host": "site_host", "path": "site_path"})
    out = judged.join(
        known_sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")),
    )
    site = {x: shrinkage(sites, x).rates(F.col(f"{x}_s"), F.col(f"{x}_host_s"), F.col(x), 1)[1] for x in HEADS}
    out = out.withColumns({f"{x}_site": F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), c)) for x, c in site.items()})
    p = {x: _belief(F.col(f"{x}_evidence") + _log_odds(F.col(f"{x}_site"))) for x in HEADS}
    shown = [c for x in HEADS for c in (F.col(f"{x}_evidence"), F.col(f"{x}_site"), p[x].alias(f"{x}_posterior"))]
    return out.select(F.col("doc_id").alias(id_col), *shown, ((p["quality"] >= 0.5) & (p["toxic"] < 0.5)).alias("kept"))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
