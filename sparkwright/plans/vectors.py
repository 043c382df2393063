"""Vector search, exact in blocks and approximate by an inverted file or by hyperplanes, and diverse reranking."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import small
from ..operators.sets import closure_by_hub
from ..registry import query
from ..sources.shared import written
from ..sources.tables import table

BLOCK, TOP = 4096, 10


#: Of the exact search: parts of queries times parts of rows that small tables are cut into at most, and numbers in a part of the rows at most.
MEETINGS, PART_NUMBERS = 64, 1 << 23


def _meet(k: int, metric: str, apart: bool = True) -> Callable:
    """The k best of some rows for each of some queries; apart: not the row of the query's own id."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _best(*[np.zeros(0, np.int64), np.zeros((0, 1))] * 2, k, metric, apart)
        a, b = (np.stack(t.column(c).to_numpy(zero_copy_only=False)) for t, c in ((left, "q"), (right, "v")))
        return _best(left.column("query_id").to_numpy(), a, right.column("vec_id").to_numpy(), b, k, metric, apart)

    return meet


def _best(qi: np.ndarray, a: np.ndarray, vi: np.ndarray, b: np.ndarray, k: int, metric: str, apart: bool) -> pa.Table:
    """As products of matrices of a few queries each."""
    out = {"query_id": [], "vec_id": [], "score": []}
    a, b = a.astype(np.float64), b.astype(np.float64)
    few = max(1, min(512, PART_NUMBERS // max(1, len(b))))
    for at in range(0, len(a), few):
        s = a[at : at + few] @ b.T
        if metric == "l2":
            s = -np.sqrt(np.maximum(0, (a[at : at + few] ** 2).sum(1)[:, None] + (b**2).sum(1) - 2 * s))
        np.round(s, 6, out=s)
        for i, row in enumerate(s):
            if apart:
                row[vi == qi[at + i]] = -np.inf
            cut = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
            cut = cut[vi[cut] != qi[at + i]] if apart else cut
            best = cut[np.lexsort((vi[cut], -row[cut]))[:k]]
            out["query_id"] += [qi[at + i]] * len(best)
            out["vec_id"] += vi[best].tolist()
            out["score"] += row[best].tolist()
    return pa.table({
        "query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
        "score": pa.array(out["score"], pa.float64()),
    })


def _cut(queries: int, rows: int, width: int, block: int) -> tuple[int, int]:
    """Parts of the queries and of the rows. A part of the rows may be large, as each gives a query's k best of its own; small tables are cut so that there are tasks enough."""
    wanted = min(MEETINGS, -(-queries * rows // block**2))
    n_q = max(1, -(-queries // (4 * block)), -(-queries * width // (PART_NUMBERS // 8)))
    n_r = max(1, -(-rows // (32 * block)), -(-rows * width // PART_NUMBERS))
    if n_q * n_r < wanted:
        n_q = max(n_q, min(-(-queries // max(1, block // 8)), -(-wanted // n_r)))
        n_r = max(n_r, -(-wanted // n_q))
    return n_q, n_r


def _packed(vectors: DataFrame, parts: int, names: str) -> DataFrame:
    """(ids, vectors) as bytes, a row for each of so many parts of equal size."""
    kind = _kind(vectors)

    def pack(batches):
        held = [(b.column(0).to_numpy(), np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(kind)) for b in batches if b.num_rows]
        if held:
            yield pa.record_batch([pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in zip(*held, strict=True)], names.split())

    return vectors.repartition(parts).mapInArrow(pack, ", ".join(f"{x} binary" for x in names.split()))


def _kind(vectors: DataFrame) -> str:
    return "f8" if vectors.schema[1].dataType.elementType.typeName() == "double" else "f4"


def nearest(
    queries: DataFrame, rows: DataFrame, k: int = TOP, metric: str = "dot", block: int = BLOCK, apart: bool = True,
) -> DataFrame:
    """(query_id, vec_id, score, rank) of the k best rows for each of queries(query_id, q); rows(vec_id, v). Ties go to the smaller id.

    Every part of the queries meets every part of the rows once, as products of matrices in one task; k rows of each meeting go on. Parts are of bounded size, so memory
    is too. Each vector is shuffled once: a meeting reads the two parts where they lie, no copies are made for it. A row is never its own neighbour, unless the ids are of
    different things (apart=False).
    """
    q, r = queries.select("query_id", "q"), rows.select("vec_id", "v")
    (of_q, width), (of_r, _) = (df.agg(F.count("*"), F.coalesce(F.max(F.size(df.columns[1])), F.lit(1))).first() for df in (q, r))
    n_q, n_r = _cut(of_q, of_r, max(1, width), block)
    kinds = _kind(q), _kind(r)

    def meet(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                qi, a, vi, b = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in enumerate(("i8", kinds[0], "i8", kinds[1])))
                yield from _best(qi, a.reshape(len(qi), -1), vi, b.reshape(len(vi), -1), k, metric, apart).to_batches()

    pairs = _packed(q, n_q, "query_ids q").hint("shuffle_replicate_nl").crossJoin(_packed(r, n_r, "vec_ids v"))
    met = pairs.mapInArrow(meet, "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"),
    ), e.select("vec_id", F.col("embedding").alias("v"))


def _sql(score: str, more: str = "") -> str:
    return f"""SELECT query_id, vec_id, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM
 (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round({score}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0{more})) WHERE rank <= {TOP}"""


PAIR = "a.embedding::DOUBLE[], b.embedding::DOUBLE[]"


@query("knn_exact", _sql(f"list_inner_product({PAIR})"))
def knn_exact(spark, d) -> DataFrame:
    """Queries are all rows whose id is divisible by 20, against all rows."""
    return nearest(*_sides(spark, d))


@query("knn_l2", _sql(f"-list_distance({PAIR})"))
def knn_l2(spark, d) -> DataFrame:
    return nearest(*_sides(spark, d), metric="l2")


@query("knn_filtered", _sql(f"list_inner_product({PAIR})", " AND b.label < 5"))
def knn_filtered(spark, d) -> DataFrame:
    """The filter on the label comes before the ranking and reaches the scan."""
    q, _ = _sides(spark, d)
    return nearest(q, table(spark, d, "embeddings").where("label < 5").select("vec_id", F.col("embedding").alias("v")))


#: Of the cells' training: rows of the sample at most, rounds, and cells at most, which bounds what is broadcast.
IVF_SAMPLE, IVF_ROUNDS, IVF_CELLS, IVF_SEED = 20_000, 8, 4096, 3
#: Queries whose exact neighbours set the number of probes, and the share of those neighbours that the probes must reach.
IVF_TRIED, IVF_REACH = 64, 0.97


class Cells(NamedTuple):
    """An inverted file: rows(cell, part, vec_id, v), all of them, and the cells' centres."""

    rows: DataFrame
    centres: np.ndarray


def _near_cells(centres, probes: int) -> Callable:
    """The nearest cells of each vector, by distance."""

    @F.arrow_udf("array<int>")
    def near_cells(v: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(v), BLOCK):
            x = np.stack(v[at : at + BLOCK].to_numpy(zero_copy_only=False)).astype(np.float32)
            far = (centres.value**2).sum(1) - 2 * x @ centres.value.T
            out += list(np.argsort(far, axis=1, kind="stable")[:, :probes].astype(np.int32))
        return pa.array(out, pa.list_(pa.int32()))

    return near_cells


def ivf_index(rows: DataFrame, cells: int | None = None, block: int = BLOCK) -> Cells:
    """rows(vec_id, v) dealt to cells by k-means; the centres come from a bounded sample, but every row is indexed. Cells of more than a block are cut into parts."""
    spark, n = rows.sparkSession, rows.count()
    cells = min(cells or max(1, round(np.sqrt(n))), IVF_CELLS)
    h = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 32))
    few = rows.where(h < int(min(1.0, (3 * IVF_SAMPLE + 100) / max(1, n)) * (1 << 32))).orderBy(
        h, "vec_id",
    ).limit(IVF_SAMPLE).select("v").toArrow()
    x = np.stack(few.column(0).to_numpy()).astype(np.float32) if len(few) else np.zeros((1, 1), np.float32)
    centres = x[np.random.default_rng(IVF_SEED).permutation(len(x))[:cells]]
    for _ in range(IVF_ROUNDS):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], centres)
    sent = spark.sparkContext.broadcast(centres)
    dealt = written(rows.select(F.get(_near_cells(sent, 1)("v"), F.lit(0)).alias("cell"), "vec_id", "v"), "ivf")
    parts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    rows = dealt.join(F.broadcast(parts), "cell")  # IVF_CELLS rows at most
    return Cells(rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")), centres)


def ivf_probes(index: Cells, queries: DataFrame, rows: DataFrame, k: int = TOP, metric: str = "dot") -> int:
    """The fewest cells of a query that reach IVF_REACH of the exact neighbours of IVF_TRIED queries: one exact pass for them."""
    sent = rows.sparkSession.sparkContext.broadcast(index.centres)
    tried = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(IVF_TRIED)
    order = tried.select("query_id", _near_cells(sent, len(index.centres))("q").alias("order"))
    found = nearest(tried, rows, k, metric).join(index.rows.select("vec_id", "cell"), "vec_id").join(order, "query_id")
    ranks = sorted(r[0] for r in found.select(F.array_position("order", F.col("cell"))).collect())  # IVF_TRIED * k numbers at most
    return int(ranks[max(0, int(np.ceil(IVF_REACH * len(ranks))) - 1)]) if ranks else 1


def ivf_search(index: Cells, queries: DataFrame, probes: int, k: int = TOP, metric: str = "dot") -> DataFrame:
    """(query_id, vec_id, score, rank) of the k best rows in the `probes` cells nearest to each of queries(query_id, q).

    Rows and queries of a cell are cut into parts of about a block, and each pair of parts meets once: an equi-join on the cell and both parts.
    """
    sent = queries.sparkSession.sparkContext.broadcast(index.centres)
    asked = written(queries.select("query_id", "q", F.explode(_near_cells(sent, probes)("q")).alias("cell")), "asked")
    lots = F.broadcast(asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("lots")))  # a row for each cell
    parts = F.broadcast(index.rows.select("cell", "parts").distinct())
    asked = asked.join(lots, "cell").join(parts, "cell").withColumn(
        "lot", F.pmod(F.xxhash64("query_id"), F.col("lots")).cast("int"),
    )
    asked = asked.select(
        "cell", "lot", "query_id", "q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    rows = index.rows.join(lots, "cell").select(
        "cell", "part", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"),
    )
    met = asked.groupBy("cell", "part", "lot").cogroup(rows.groupBy("cell", "part", "lot")).applyInArrow(
        _meet(k, metric), "query_id bigint, vec_id bigint, score double",
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@query("knn_ivf")
def knn_ivf(spark, d) -> DataFrame:
    """Approximate neighbours of the same queries as knn_exact; tests/ measure recall against it."""
    q, rows = _sides(spark, d)
    index = ivf_index(rows)
    return ivf_search(index, q, ivf_probes(index, q, rows))


#: Tables of hyperplanes, hyperplanes of a table at most, and rows of a bucket that their number aims at.
LSH_TABLES, LSH_BITS, LSH_ROWS, LSH_SEED = 8, 24, 64, 5
#: Probes of a query's buckets turn over subsets of its so many nearest hyperplanes.
LSH_TURNED = 8
#: Rows of a region, neighbouring buckets of a table that meet in one task, and queries of a lot that come there, about.
LSH_REGION, LSH_LOT = 1 << 15, 1 << 16


class Hashed(NamedTuple):
    """Rows by bucket: rows(cell, vec_id), each once for each table; vectors(vec_id, v), the planes(table, plane, dimension), and the lowest bits of a bucket that its region leaves out. Regions have about `block` rows."""

    rows: DataFrame
    vectors: DataFrame
    planes: np.ndarray
    shift: int
    block: int


def _signs(x: np.ndarray, planes: np.ndarray, probes: int) -> np.ndarray:
    """The first probes buckets of each vector in a table, as signs: its own, then those on the other side of the planes it is nearest to, by the sum of the squared distances."""
    side = x @ planes.T
    own = ((side > 0).astype(np.int64) << np.arange(len(planes))).sum(1)
    if probes == 1:
        return own[:, None]
    turned = min(len(planes), LSH_TURNED)
    subsets = (np.arange(1 << turned)[:, None] >> np.arange(turned) & 1).astype(np.float32)
    near = np.argsort(np.abs(side), axis=1, kind="stable")[:, :turned]
    best = np.argsort(np.take_along_axis(side, near, 1) ** 2 @ subsets.T, axis=1, kind="stable")[:, :probes]
    return own[:, None] ^ np.stack([(subsets[b].astype(np.int64) << n).sum(1) for b, n in zip(best, near)])


def _matrix(v: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.stack(v.to_numpy(zero_copy_only=False)).astype(kind)


def _buckets(planes, probes: int) -> Callable:
    """The first probes buckets of each vector in each table, as table << LSH_BITS | signs."""

    @F.arrow_udf("array<array<bigint>>")
    def buckets(v: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(v), BLOCK):
            x = _matrix(v[at : at + BLOCK], np.float32)
            found = [_signs(x, p, probes) | t << LSH_BITS for t, p in enumerate(planes.value)]
            out += [list(cells) for cells in zip(*found)]
        return pa.array(out, pa.list_(pa.list_(pa.int64())))

    return buckets


def _regions(planes, probes: int, shift: int) -> Callable:
    """The regions, each once, of the first probes buckets of each vector in all tables."""

    @F.arrow_udf("array<bigint>")
    def regions(v: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(v), BLOCK):
            x = _matrix(v[at : at + BLOCK], np.float32)
            found = np.concatenate([(_signs(x, p, probes) | t << LSH_BITS) >> shift for t, p in enumerate(planes.value)], 1)
            out += [np.unique(row) for row in found]
        return pa.array(out, pa.list_(pa.int64()))

    return regions


def _meet_buckets(planes, probes: int, shift: int, k: int, metric: str) -> Callable:
    """The k best rows of a part of a region for each query, of those that are in one of its probed buckets there; not the row of the query's own id."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            of_table = planes.value[(left.column("region")[0].as_py() << shift) >> LSH_BITS]
            vi, b = right.column("vec_id").to_numpy(), _matrix(right.column("v"), np.float32)
            cell = _signs(b, of_table, 1)[:, 0]
            order = np.lexsort((vi, cell))
            vi, b = vi[order], b[order].astype(np.float64)
            cells, begins, n = np.unique(cell[order], return_index=True, return_counts=True)
            for low in range(0, len(left), 512):
                few = left.slice(low, 512)
                a, qi = _matrix(few.column("q"), np.float32), few.column("query_id").to_numpy()
                probed = _signs(a, of_table, probes)
                place = np.minimum(np.searchsorted(cells, probed), len(cells) - 1)
                here, a = cells[place] == probed, a.astype(np.float64)
                for i, q in enumerate(a):
                    p = place[i][here[i]]
                    rows = np.repeat(begins[p] - (np.cumsum(n[p]) - n[p]), n[p]) + np.arange(n[p].sum())
                    rows = rows[vi[rows] != qi[i]]
                    x = b[rows]
                    s = x @ q
                    if metric == "l2":
                        s = -np.sqrt(np.maximum(0, (q**2).sum() + (x**2).sum(1) - 2 * s))
                    s = np.round(s, 6)
                    if len(s) > k:
                        cut = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                        rows, s = rows[cut], s[cut]
                    best = np.lexsort((vi[rows], -s))[:k]
                    out.append((np.full(len(best), qi[i]), vi[rows[best]], s[best]))
        found = [np.concatenate(x) for x in zip(*out)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    return meet


def lsh_index(rows: DataFrame, tables: int = LSH_TABLES, bits: int | None = None, block: int = LSH_REGION) -> Hashed:
    """rows(vec_id, v), every one, in a bucket of each table of random hyperplanes."""
    n, one = rows.count(), rows.select(F.size("v")).first()
    bits = min(LSH_BITS, max(1, round(np.log2(max(2, n) / LSH_ROWS)))) if bits is None else bits
    planes = np.random.default_rng(LSH_SEED).normal(size=(tables, bits, one[0] if one else 1)).astype(np.float32)
    sent = rows.sparkSession.sparkContext.broadcast(planes)
    of = min(bits, max(0, int(np.ceil(np.log2(max(1, n) / block)))))  # bits that tell regions apart
    return Hashed(rows.select(F.explode(F.flatten(_buckets(sent, 1)("v"))).alias("cell"), "vec_id"), rows, planes, bits - of, block)


def lsh_probes(index: Hashed, queries: DataFrame, rows: DataFrame, k: int = TOP, metric: str = "dot") -> int:
    """The fewest probes of a table that reach IVF_REACH of the exact neighbours of IVF_TRIED queries in any table, or all that there are: one exact pass for them."""
    sent, most = rows.sparkSession.sparkContext.broadcast(index.planes), 1 << min(index.planes.shape[1], LSH_TURNED)
    tried = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(IVF_TRIED)
    order = tried.select("query_id", _buckets(sent, most)("q").alias("order"))
    found = written(nearest(tried, rows, k, metric), "near")  # IVF_TRIED * k rows at most
    near = rows.join(F.broadcast(found), "vec_id").select("query_id", "vec_id", F.explode(F.flatten(_buckets(sent, 1)("v"))).alias("cell")).join(order, "query_id")
    place = F.array_position(F.get("order", F.shiftright("cell", LSH_BITS).cast("int")), F.col("cell"))
    first = near.groupBy("query_id", "vec_id").agg(F.min(F.when(place > 0, place)).alias("first"))
    ranks = sorted(r[0] if r[0] else most for r in first.select("first").collect())  # IVF_TRIED * k numbers at most
    return int(ranks[max(0, int(np.ceil(IVF_REACH * len(ranks))) - 1)]) if ranks else 1


def lsh_candidates(index: Hashed, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, q, cell) for each bucket that a query is compared with."""
    sent = queries.sparkSession.sparkContext.broadcast(index.planes)
    return queries.select("query_id", "q", F.explode(F.flatten(_buckets(sent, probes)("q"))).alias("cell"))


def lsh_search(index: Hashed, queries: DataFrame, probes: int, k: int = TOP, metric: str = "dot") -> DataFrame:
    """(query_id, vec_id, score, rank) of the k best rows that share one of the probed buckets of a table with each of queries(query_id, q).

    A query comes once to each region where it probes, not to each bucket, and takes k rows from there; buckets are told anew from the vectors there. Regions of more than
    `block` rows, as of equal vectors, are cut into parts, and their queries into lots: an equi-join on region, part and lot.
    """
    sent = queries.sparkSession.sparkContext.broadcast(index.planes)
    own, probed = (F.explode(_regions(sent, n, index.shift)(v)).alias("region") for n, v in ((1, "v"), (probes, "q")))
    cut = index.vectors.select(own).groupBy("region").agg(F.ceil(F.count("*") / index.block).cast("int").alias("parts"))
    lots = queries.select(probed).groupBy("region").agg(F.ceil(F.count("*") / LSH_LOT).cast("int").alias("lots"))
    cuts = small(written(cut.join(lots, "region"), "regions"))
    asked = queries.select("query_id", "q", probed).join(cuts, "region").withColumn("lot", F.pmod(F.xxhash64("query_id"), F.col("lots")).cast("int"))
    asked = asked.select("region", "lot", "query_id", "q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = index.vectors.select("vec_id", "v", own).join(cuts, "region").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    rows = rows.select("region", "part", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    met = asked.groupBy("region", "part", "lot").cogroup(rows.groupBy("region", "part", "lot")).applyInArrow(
        _meet_buckets(sent, probes, index.shift, k, metric), "query_id bigint, vec_id bigint, score double",
    )
    once = met.repartition("query_id").dropDuplicates(["query_id", "vec_id"])  # a pair may meet in several tables
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@query("knn_lsh")
def knn_lsh(spark, d) -> DataFrame:
    """Approximate neighbours of the same queries as knn_exact by random hyperplanes; tests/ measure recall against it."""
    q, rows = _sides(spark, d)
    index = lsh_index(rows)
    return lsh_search(index, q, lsh_probes(index, q, rows))


@query("mmr")
def mmr(spark, d) -> DataFrame:
    """Maximal marginal relevance: of each query's ten nearest, five that differ from each other. Greedy, so no SQL; tests/ hold a brute-force version."""
    q, rows = _sides(spark, d)
    near = nearest(q, rows).join(rows, "vec_id").join(q.select("query_id"), "query_id").select(
        "query_id", "vec_id", "score", "v",
    )
    return near.groupBy("query_id").applyInPandas(lambda g: diverse(g), "query_id bigint, vec_id bigint, place int")  # TOP rows of a query


def diverse(g: pd.DataFrame, keep: int = 5, trade: float = 0.7) -> pd.DataFrame:
    g = g.sort_values(["score", "vec_id"], ascending=[False, True]).reset_index(drop=True)
    v = np.stack(g["v"].to_numpy()).astype(np.float64)
    like, chosen = v @ v.T, []
    while len(chosen) < min(keep, len(g)):
        worst = like[:, chosen].max(1) if chosen else np.zeros(len(g))
        gain = np.round(trade * g["score"].to_numpy() - (1 - trade) * worst, 9)
        gain[chosen] = -np.inf
        chosen.append(int(np.argmax(gain)))
    return pd.DataFrame({
        "query_id": g["query_id"].iloc[chosen], "vec_id": g["vec_id"].iloc[chosen],
        "place": np.arange(1, len(chosen) + 1, dtype=np.int32),
    })


GRAPH = 5


@query("cte_closure", f"""WITH RECURSIVE near AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM
 (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_inner_product({PAIR}), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= {GRAPH}),
 r(start, node) AS (SELECT vec_id, vec_id FROM embeddings WHERE vec_id % 20 = 0 UNION SELECT start, dst FROM r JOIN near ON node = src) SELECT start, node FROM r""")
def cte_closure(spark, d) -> DataFrame:
    """What each query vector reaches over the graph of every vector's GRAPH nearest."""
    q, rows = _sides(spark, d)
    near = nearest(rows.toDF("query_id", "q"), rows, GRAPH)
    edges = near.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"))
    return closure_by_hub(edges, q.select(F.col("query_id").alias("start")))
