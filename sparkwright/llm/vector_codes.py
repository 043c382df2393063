"""Vector code compression: product quantisation of whole-number vectors, by a trie over the distinct parts.

Each component x becomes floor(SCALE * x); a vector is cut into PARTS equal parts, and each part becomes the index of its codebook's nearest entry. Codebooks begin as the
parts of the ENTRIES smallest ids; each of ROUNDS rounds assigns every part and replaces each entry by the floored mean of its parts.

Equal parts are counted first, so copies are assigned once a round, with their number as weight. Sorted parts are a trie whose levels are the dimensions: parts
with a common beginning lie together. It is walked depth first, in blocks of leaves: a node adds its dimension's squared distances to all entries to what
its parent has gathered, once for all leaves below it. A leaf with no neighbour further down adds the rest of its dimensions at once, takes the nearest entry, and adds
its weighted part to that entry's sums. Entries are few and of fixed number, so their sums are what the driver gets from a round.

All is exact: 64-bit integers, or doubles while every distance stays below 2 ** 53.

Defined results: rows whose vector is null, or holds a null or a component that is not finite, are dropped, as are vectors without components, of a length that PARTS does
not divide, or of another length than the one of the smallest id left. Scaled components beyond MOST count as MOST. Null ids come last; of one id, vectors in their order. Rows
that repeat are each returned and count each. Equal distances go to the lower index; entries without parts stay. With fewer than ENTRIES rows there are fewer entries. A null
label is a label; an error that a long cannot hold is null. Further columns are passed over, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialize, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
MOST = 1 << 25
#: Leaves that are walked at once: their distances to all entries are in memory.
BLOCK = 2048

Codebook = np.ndarray  # (entries, width), whole numbers


def shared_beginnings(parts: np.ndarray) -> np.ndarray:
    """For each row of sorted parts, how many first components it shares with the row before; 0 at both ends."""
    differs = parts[1:] != parts[:-1]
    equal = np.where(differs.any(1), differs.argmax(1), parts.shape[1])
    return np.concatenate(([0], equal, [0]))


def walk(parts: np.ndarray, book: Codebook) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, nearest entry, squared distance) of each block of sorted parts."""
    width = parts.shape[1]
    reach = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if width * (2 * reach) ** 2 < 1 << 53 else np.int64
    parts, book = parts.astype(kind), book.astype(kind)
    shared = shared_beginnings(parts)
    for at in range(0, len(parts), BLOCK):
        rows = slice(at, min(at + BLOCK, len(parts)))
        x, before = parts[rows], shared[at : rows.stop].copy()
        leaves = np.maximum(before, shared[at + 1 : rows.stop + 1])  # depth from which a leaf is alone
        before[0] = 0  # the path to a block's first leaf is gone through anew
        total = np.empty((len(x), len(book)), kind)
        gathered, node = np.zeros((1, len(book)), kind), np.zeros(len(x), np.int64)
        for depth in range(width + 1):
            alone = leaves == depth
            rest, entries = x[alone, depth:], book[:, depth:]
            total[alone] = gathered[node[alone]] + (rest**2).sum(1)[:, None] - 2 * rest @ entries.T + (entries**2).sum(1)
            deeper = leaves > depth
            if not deeper.any():
                break
            begins = np.flatnonzero(deeper & (before <= depth))
            gathered = gathered[node[begins]] + (x[begins, depth, None] - book[:, depth]) ** 2
            node = np.searchsorted(begins, np.arange(len(x)), "right") - 1
        nearest = total.argmin(1)
        yield rows, nearest, total[np.arange(len(x)), nearest].astype(np.int64)


def sorted_rows(parts: np.ndarray) -> np.ndarray:
    return np.lexsort(parts.T[::-1])


def whole(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(batches: Iterator[pa.RecordBatch], books: list[Codebook]) -> Iterator[pa.RecordBatch]:
    """Weighted sums and counts of the parts nearest to each entry, of all the parts of a task."""
    sums = [np.zeros(b.shape, np.int64) for b in books]
    counts = [np.zeros(len(b), np.int64) for b in books]
    for batch in batches:
        which, weight = batch["place"].to_numpy(), batch["n"].to_numpy()
        parts = whole(batch["part"], books[0].shape[1])
        for p in np.unique(which):
            own, n = parts[which == p], weight[which == p]
            order = sorted_rows(own)  # sorted already, but where two files meet
            own, n = own[order], n[order]
            for rows, nearest, _ in walk(own, books[p]):
                np.add.at(sums[p], nearest, own[rows] * n[rows, None])
                np.add.at(counts[p], nearest, n[rows])
    used = [(p, e) for p, c in enumerate(counts) for e in np.flatnonzero(c)]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()),
            pa.array([counts[p][e] for p, e in used], pa.int64()),
            pa.array([sums[p][e] for p, e in used], pa.list_(pa.int64())),
        ],
        names=["place", "entry", "n", "sums"],
    )


def _codes(batches: Iterator[pa.RecordBatch], books: list[Codebook]) -> Iterator[pa.RecordBatch]:
    """The code and error of each vector; within a batch, equal parts are walked once."""
    width = books[0].shape[1]
    for batch in batches:
        vectors = whole(batch["v"], width * len(books))
        codes, errors = np.empty((len(vectors), len(books)), np.uint8), np.zeros(len(vectors), np.int64)
        for p, book in enumerate(books):
            own = vectors[:, p * width : (p + 1) * width]
            order = sorted_rows(own)
            own = own[order]
            new = np.concatenate(([True], (own[1:] != own[:-1]).any(1)))
            back = np.cumsum(new) - 1
            distinct, nearest, far = own[new], np.empty(new.sum(), np.uint8), np.empty(new.sum(), np.int64)
            for rows, at, distance in walk(distinct, book):
                nearest[rows], far[rows] = at, distance
            codes[order, p] = nearest[back]
            errors[order] += far[back]
        yield pa.RecordBatch.from_arrays(
            [batch["vec_id"], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors), batch["label"]],
            names=["vec_id", "code", "error", "label"],
        )


def scaled(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, v) of rows(vec_id, embedding, label) with a usable vector, in whole numbers."""
    e = col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = e.isNotNull() & (F.size(e) > 0) & (F.size(e) % parts == 0) & finite
    number = F.transform(
        e, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(MOST)), F.lit(-MOST)).cast("int"),
    )
    return rows.where(usable).select(col("vec_id").alias("vec_id"), col("label").alias("label"), number.alias("v"))


def distinct_parts(vectors: DataFrame, width: int, parts: int = PARTS) -> DataFrame:
    """(place, part, n): the distinct parts of each place with their number, sorted within each task."""
    each = F.array(*(F.slice("v", p * width + 1, width) for p in range(parts)))
    counted = vectors.select(F.posexplode(each).alias("place", "part")).groupBy("place", "part").agg(F.count("*").alias("n"))
    return counted.sortWithinPartitions("place", "part")


def fitted(counted: DataFrame, books: list[Codebook], rounds: int = ROUNDS) -> list[Codebook]:
    """The codebooks after some rounds of assignment and replacement; counted: what `distinct_parts` gives, written."""
    width = books[0].shape[1]
    for _ in range(rounds):
        sums = counted.mapInArrow(
            partial(_sums, books=books), "place int, entry int, n bigint, sums array<bigint>",
        ).groupBy("place", "entry").agg(
            F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums"),
        )
        books = [b.copy() for b in books]
        for r in sums.collect():  # one row for each entry at most
            books[r["place"]][r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return books


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[Codebook]]:
    """(vec_id, code, error, label) of each usable row of rows(vec_id, embedding, label), and the codebooks; entries: 256 at most, as a part's code is a byte."""
    vectors = scaled(rows, parts)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(1).collect()
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, code string, error bigint, label {vectors.schema['label'].dataType.simpleString()}"
    if not first:
        return vectors.sparkSession.createDataFrame([], schema), []
    dims = len(first[0]["v"])
    vectors = vectors.where(F.size("v") == dims)
    begin = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = np.split(np.array([r["v"] for r in begin], np.int64), parts, axis=1)
    books = fitted(materialize(distinct_parts(vectors, dims // parts, parts), "parts"), books, rounds)
    return vectors.mapInArrow(partial(_codes, books=books), schema), books


def digest(books: list[Codebook]) -> str:
    """The sha256 of all entries' components, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error, the errors of equal labels added; a label's sum is joined back, so no label's rows meet."""
    codes = materialize(codes, "codes")
    sums = codes.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    def assign(book: str) -> str:
        far = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"SELECT vec_id, p, any_value(v) AS v, min((far * 256 + entry)) % 256 AS entry, (min(far * 256 + entry) // 256)::BIGINT AS far FROM (SELECT x.vec_id, x.p, x.v, c.entry, {far} AS far FROM x JOIN {book} c USING (p)) GROUP BY vec_id, p"

    steps = []
    for k in range(ROUNDS):
        steps += [
            f"a{k} AS MATERIALIZED ({assign(f'c{k}')})",
            f"m{k} AS (SELECT p, entry, list(y ORDER BY i) AS v FROM (SELECT p, entry, i, floor(sum(v[i]) / count(*)::DOUBLE)::BIGINT AS y FROM a{k}, range(1, 17) u(i) GROUP BY ALL) GROUP BY ALL)",
            f"c{k + 1} AS MATERIALIZED (SELECT p, entry, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (p, entry))",
        ]
    last = f"c{ROUNDS}"
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT vec_id, p::INT AS p, v[p * 16 + 1 : p * 16 + 16] AS v FROM kept, range(0, {PARTS}) u(p)),
c0 AS MATERIALIZED (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::BIGINT AS entry, v FROM x QUALIFY entry < {ENTRIES}),
{", ".join(steps)},
z AS MATERIALIZED ({assign(last)}),
r AS (SELECT vec_id, string_agg(lpad(lower(to_hex(entry::BIGINT)), 2, '0'), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM z GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM {last})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN kept USING (vec_id), h
"""


SQL = _sql()
