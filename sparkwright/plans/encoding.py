"""Texts as dense vectors without a trained model: signed feature hashing of sub-words, idf weights, and a sparse random projection.

A term is the bag of its runs of three characters, ends marked. Each run is hashed to one of 2 ** 16 features with a sign, and each feature has SPARSE
components of plus or minus one at random places of the vector, so terms of common parts are near. A text's vector is the sum of its terms' vectors, by (1 + ln tf) times a
smoothed idf, brought to length one. Places and signs come from MD5, so any engine gives the same vectors; documents and passages share one space.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written
from .postings import Block, StoredIndex, each_row, spread, stored, stored_index, tokens
from .vectors import nearest

DIMS, SPARSE, GRAM = 64, 4, 3
#: Texts that are summed at once, and terms.
LOT, TERMS = 256, 4096


@functools.lru_cache(maxsize=1 << 17)
def gram_vector(run: int) -> np.ndarray:
    """The components of a run of characters, 21 bits each: its feature's sign times the feature's projection."""
    gram = "".join(chr(run >> 21 * i & 0x1FFFFF) for i in reversed(range(GRAM)))
    feature = hashlib.md5(gram.encode()).hexdigest()[:5]  # four digits of place, one of sign
    row = hashlib.md5(feature[:4].encode()).hexdigest()
    sign, out = 1 if feature[4] < "8" else -1, np.zeros(DIMS, np.int32)
    for j in range(SPARSE):
        out[int(row[2 * j : 2 * j + 2], 16) % DIMS] += sign if row[2 * SPARSE + j] < "8" else -sign
    return out


def term_vectors(terms: list[str]) -> np.ndarray:
    """A row for each term, none of them empty: the sum of its runs' components by the root of their number."""
    out = np.zeros((len(terms), DIMS))
    for at in range(0, len(terms), TERMS):
        marked = [f"<{t}>" for t in terms[at : at + TERMS]]
        n = np.array([len(m) - GRAM + 1 for m in marked])
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begins = np.arange(n.sum()) + np.repeat((GRAM - 1) * np.arange(len(n)), n)
        runs = sum(points[begins + i] << 21 * (GRAM - 1 - i) for i in range(GRAM))
        runs, which = np.unique(runs, return_inverse=True)
        vectors = np.array([gram_vector(r) for r in runs.tolist()])
        sums = np.add.reduceat(vectors[which], np.cumsum(n) - n)
        out[at : at + TERMS] = sums / np.sqrt(n * SPARSE)[:, None]
    return out


def unit(terms: pa.Array, weights: np.ndarray, begins: np.ndarray) -> pa.Array:
    """The unit vector of each text: the weighted terms from its begin to the next one, none of them empty."""
    words = terms if isinstance(terms, pa.DictionaryArray) else terms.dictionary_encode()
    vectors = term_vectors(words.dictionary.to_pylist())
    each, out = words.indices.to_numpy(), np.zeros((len(begins), DIMS))
    ends = np.append(begins[1:], len(each))
    for at in range(0, len(begins), LOT):
        low, high = begins[at], ends[min(at + LOT, len(begins)) - 1]
        out[at : at + LOT] = np.add.reduceat(vectors[each[low:high]] * weights[low:high, None], begins[at : at + LOT] - low)
    norm = np.sqrt((out**2).sum(1))[:, None]
    out = np.round(np.divide(out, norm, out=np.zeros_like(out), where=norm > 0), 6) + 0.0  # no negative zero
    return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), DIMS).cast(pa.list_(pa.float64()))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def summed(terms: pa.Array) -> pa.Array:
    """The unit vector of each list of (term, weight), none of them empty."""
    pairs, begins = terms.flatten(), np.cumsum([0, *terms.value_lengths().to_pylist()])[:-1]
    return unit(pairs.field("term"), pairs.field("weight").to_numpy(zero_copy_only=False), begins)


def _block_vectors(index: StoredIndex) -> Callable:
    """(*keys, vector) of a block's documents that have a term."""
    keys, n, buckets = index.keys, index.n, index.buckets

    def block_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (Block(row, keys, buckets) for row in each_row(batches)):
            if len(b.df):
                order = np.argsort(b.at, kind="stable")  # by document, then by term
                at, of_term = b.at[order], b.of_term[order]
                begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                idf = np.log((1.0 + n) / (b.known + 1)) + 1
                weights = (np.log(b.tf[order].astype(np.float64)) + 1) * idf[of_term]
                vectors = unit(pa.DictionaryArray.from_arrays(pa.array(of_term.astype(np.int32)), b.terms), weights, begins)
                yield pa.RecordBatch.from_pydict({k: v.take(pa.array(at[begins])) for k, v in b.keys.items()} | {"vector": vectors})

    return block_vectors


def smoothed_idf(index: StoredIndex) -> DataFrame:
    """(term, idf); a term that no document has counts as one of df 0, see `encoded`."""
    idf = F.ln(F.lit(1.0 + index.n) / (F.col("df") + 1)) + 1
    return index.terms().select("term", idf.alias("idf"))


def _by_text(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, vector) of weighted(*keys, term, tf, idf): a text's distinct terms meet, no more."""
    w = (F.ln(F.col("tf").cast("double")) + 1) * F.col("idf")
    return weighted.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("term", w.alias("weight")))).alias("terms"),
    ).select(*keys, summed("terms").alias("vector"))


def encoded_documents(index: StoredIndex) -> DataFrame:
    """(*keys, vector) of the documents of an index that have a term, each block in one task. No text is read."""
    kinds = dict(index.blocks.dtypes)
    return index.with_df().mapInArrow(_block_vectors(index), ", ".join(f"{c} {kinds[c][6:-1]}" for c in index.keys) + ", vector array<double>")


def encoded(index: StoredIndex, texts: DataFrame) -> DataFrame:
    """(*keys, vector) of texts(*keys, text) that have a term, with the weights of the index's documents."""
    tf = spread(texts).select(*index.keys, F.explode(tokens(F.col("text"))).alias("term")).groupBy(*index.keys, "term").agg(
        F.count("*").alias("tf"),
    )
    unseen = float(np.log(1.0 + index.n) + 1)
    return _by_text(tf.join(smoothed_idf(index), "term", "left").fillna(unseen, ["idf"]), index.keys)


def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, v) of the table documents, encoded at their first use."""
    def build(_: DataFrame) -> DataFrame:
        rows = encoded_documents(stored_index(spark, d))
        return written(rows.select(F.col("doc_id").alias("vec_id"), F.col("vector").alias("v")), "encoded")

    return stored(spark, d, "vectors", build)


def dense_ranks(index: StoredIndex, rows: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score, rank) of the k of rows(vec_id, v) nearest to each of passages(item_id, text), by exact search in blocks of vectors."""
    asked = encoded(index, passages.select(F.col("item_id").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("query_id"), F.col("vector").alias("q"),
    )
    return nearest(written(asked, "asked"), rows, k, apart=False).select(
        F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), "score", "rank",
    )


def _hex(text: str, at: str, n: int) -> str:
    return f"('0x' || substr({text}, {at}, {n}))::INT"


#: Common table expressions that end in encoded(kind, id, vector).
ENCODE_SQL = rf"""et AS (SELECT 'documents' AS kind, doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM documents
 UNION ALL SELECT 'benchmark', item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) FROM benchmark),
 ef AS (SELECT kind, id, term, count(*) AS tf FROM et GROUP BY ALL),
 ei AS (SELECT term, ln((1e0 + (SELECT count(*) FROM documents)) / (1 + count(*) FILTER (WHERE kind = 'documents'))) + 1 AS idf FROM ef GROUP BY term),
 eg AS (SELECT term, unnest(list_transform(range(1, length(term) + 1), lambda i: substr('<' || term || '>', i, {GRAM}))) AS gram FROM ei),
 eh AS (SELECT term, md5(gram) AS h, md5(substr(md5(gram), 1, 4)) AS r FROM eg),
 ec AS (SELECT term, {_hex("r", "2 * j + 1", 2)} % {DIMS} AS dim, (CASE WHEN substr(h, 5, 1) < '8' THEN 1 ELSE -1 END) * (CASE WHEN substr(r, {2 * SPARSE + 1} + j, 1) < '8' THEN 1 ELSE -1 END) AS s FROM eh, range(0, {SPARSE}) u(j)),
 ev AS (SELECT term, dim, sum(s) / sqrt(any_value(length(term)) * {SPARSE}e0) AS x FROM ec GROUP BY term, dim),
 es AS (SELECT kind, id, dim, sum((1 + ln(tf)) * idf * x) AS y FROM ef JOIN ei USING (term) JOIN ev USING (term) GROUP BY ALL),
 en AS (SELECT kind, id, sqrt(sum(y * y)) AS norm FROM es GROUP BY kind, id),
 encoded AS (SELECT p.kind, p.id, list(round(CASE WHEN norm > 0 THEN coalesce(y, 0) / norm ELSE 0 END, 6) + 0e0 ORDER BY k) AS vector
 FROM (SELECT kind, id, norm, unnest(range({DIMS})) AS k FROM en) p LEFT JOIN es ON es.kind = p.kind AND es.id = p.id AND es.dim = p.k GROUP BY p.kind, p.id)"""
