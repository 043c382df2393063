"""Line dedup: lines that many documents share stay in one document only.

Lines are exploded by their 128-bit key, distinct documents are counted for each key, keys
over the threshold are joined back to the documents that hold them, and each document is put
together again from the lines left, in their old order.

Defined results: a null or empty text is one empty line. Rows that repeat a doc_id count as one
document and are each rewritten. A row with a null doc_id does not count as a document and is never the
one that keeps a shared line. Other columns are passed over (`dedup_lines`) or kept
(`apply_line_dedup`), whatever their names. An empty table gives an empty result. A very long text is handled whole, and each of its
lines counts. There are no ties: a row's id alone says whether it keeps a line.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, col, fresh, materialize, table, text_bytes

RESULT = "struct<kept_text:string,n_lines:bigint,n_dropped:bigint>"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of the stripped line with A-Z lower-cased; None for lines too short to count."""
    key = line.strip(WHITE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _keys_udf(min_chars: int) -> Callable:
    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def line_keys(text: pa.Array) -> pa.Array:
        return pa.array(
            [[*{k: 0 for x in text_bytes(t.as_py()).split(b"\n") if (k := line_key(x, min_chars))}] for t in text],
            pa.list_(pa.binary()),
        )

    return line_keys


def _drop_udf(min_chars: int) -> Callable:
    @F.arrow_udf(RESULT)
    def without_lines(text: pa.Array, drops: pa.Array) -> pa.Array:
        texts, counts, gone = [], [], []
        for t, d in zip(text, drops, strict=True):
            lines, drop = text_bytes(t.as_py()).split(b"\n"), set(d.as_py() or ())
            kept = [x for x in lines if line_key(x, min_chars) not in drop] if drop else lines
            texts.append(b"\n".join(kept).decode())
            counts.append(len(lines))
            gone.append(len(lines) - len(kept))
        return pa.StructArray.from_arrays(
            [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())],
            ["kept_text", "n_lines", "n_dropped"],
        )

    return without_lines


def shared_lines(keys: DataFrame, min_docs: int) -> DataFrame:
    """(key, holder) of the keys found in at least min_docs documents; the distinct count is dealt by key and document first, so a hot line is spread."""
    return keys.groupBy("key").agg(
        F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("holder"),
    ).where(F.col("n") >= min_docs).select("key", "holder")


def _with_result(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> tuple[DataFrame, str]:
    # rows without an id are told apart by their text, so they do not all meet in one task
    text_key = F.when(col(id_col).isNull(), F.xxhash64(col(text_col)))
    keys = materialize(
        docs.select(
            col(id_col).alias("doc_id"), text_key.alias("text_key"),
            F.explode(_keys_udf(min_chars)(col(text_col))).alias("key"),
        ),
        "line_keys",
    )
    hot = materialize(shared_lines(keys, min_docs), "shared_lines")  # a table, so Spark can split the join's hot keys
    drops = keys.join(hot, "key").where(~F.col("doc_id").eqNullSafe(F.col("holder"))).groupBy(
        "doc_id", "text_key",
    ).agg(F.collect_set("key").alias("drops"))
    out, did, key, drop = fresh(docs, "line_dedup"), fresh(docs, "drop_doc_id"), fresh(
        docs, "drop_text_key",
    ), fresh(docs, "drop_keys")
    drops = drops.select(F.col("doc_id").alias(did), F.col("text_key").alias(key), F.col("drops").alias(drop))
    joined = docs.join(drops, col(id_col).eqNullSafe(F.col(did)) & text_key.eqNullSafe(F.col(key)), "left")
    return joined.withColumn(out, _drop_udf(min_chars)(col(text_col), F.col(drop))).drop(did, key, drop), out


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3,
) -> DataFrame:
    """One row for each row of docs: its id, kept_text, n_lines (before) and n_dropped."""
    slim = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    done, out = _with_result(slim, "doc_id", "text", min_chars, min_docs)
    return done.select(F.col("doc_id").alias(id_col), F.col(f"{out}.*"))


def apply_line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3,
) -> DataFrame:
    """docs with the shared lines taken out of the text; a column n_chars, if there is one, follows."""
    done, out = _with_result(docs, id_col, text_col, min_chars, min_docs)
    new = {text_col: F.col(f"{out}.kept_text"), "n_chars": F.length(f"{out}.kept_text").cast("long")}
    return done.select(*((new[c] if c in new else col(c)).alias(c) for c in docs.columns))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.doc_id, k.line, k.pos, hot.key IS NOT NULL AND k.doc_id <> hot.holder AS dropped FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
