"""Benchmark decontamination by greedy string tiling.

Texts become words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased and ASCII punctuation taken out. Seeds are runs of
`min_match` words, hashed by Karp-Rabin; documents and benchmark items that share seeds are joined. For
each such pair the longest common runs that do not overlap are marked, again and again, until none of
min_match words is left. A document is contaminated by an item if the marks cover `coverage` of the item's words;
as marks may lie in any order, reordered passages are caught.

Before the join a bitmap (2 MB, and up to 32 MB for a large benchmark, but never more) drops most seeds that no item has;
what it lets through by chance falls in the join. To reach the coverage a document must share so many of an item's
seeds that it has one of the rarer ones: only these are joined, and the commonest seeds of each item, as many as a document may
lack, bring no pairs. Pairs that share too few seeds are not tiled. Neither bound loses a pair.

Defined results: null and empty documents, and items without words, match nothing. An item shorter than
min_match words has one seed, its whole length, and must occur whole. Rows that repeat an id are judged each by its own text.
An item_id that repeats is one item for each row; its best coverage counts. Null ids are carried as null.
Other columns are passed over (`contaminated`) or kept (`decontaminate`). Empty tables give empty results, and an
empty benchmark leaves all documents. Of runs of one length the first in the document, then in the item, is marked. Of a very long or repetitive
document PAIR_LOT pairs of places are held at once.
"""

from __future__ import annotations

import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap_of, col, fresh, in_bitmap, materialize, table, text_bytes

MIN_MATCH, COVERAGE = 5, 0.5
#: Least and most bits of the seed bitmap, as powers of two, and bits for each seed between them.
BITMAP_BITS, BITS_PER_SEED = (24, 28), 32
#: Pairs of places with one seed, about, that tiling holds at once.
PAIR_LOT = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
PUNCTUATION = string.punctuation.encode()
PAIR = "struct<covered:int,n_tiles:int,tiles:array<struct<doc_pos:int,item_pos:int,length:int>>>"


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of the words."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in text_bytes(text).lower().translate(None, PUNCTUATION).split()], np.uint64)


def rolled(t: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `width` tokens, modulo 2**64."""
    if width < 1 or len(t) < width:
        return np.zeros(0, np.uint64)
    h = np.full(len(t) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = h * BASE + t[k : len(t) - width + 1 + k]
        return h * BASE ^ (h >> np.uint64(29))


def longest_runs(
    d: np.ndarray, low: np.ndarray, high: np.ndarray, i: np.ndarray, lot: int,
) -> tuple[int, list[tuple[int, int]]]:
    """Windows of the longest runs and where they begin; place d[k] of the document meets the places i[low[k]:high[k]] of the item.

    Runs lie on diagonals. Those that reach the end of a lot are open and may go on in the next, so lots change nothing.
    """
    most, found = 0, []
    opened: dict[int, int] = {}  # diagonal to where its run began
    last = -2

    def take(length: int, runs: list[tuple[int, int]]) -> None:
        nonlocal most, found
        if length > most:
            most, found = length, runs
        elif length == most:
            found += runs

    some = np.flatnonzero(high > low)
    d, low, high = d[some], low[some], high[some]
    sizes = high - low
    parts = np.split(np.arange(len(d)), np.flatnonzero(np.diff(np.cumsum(sizes) // lot)) + 1) if len(d) else []
    for part in parts:
        n = sizes[part]
        p = np.repeat(d[part], n)
        q = i[np.repeat(low[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        order = np.lexsort((p, p - q))  # along diagonals
        p, q = p[order], q[order]
        follows = (np.diff(p) == 1) & (np.diff(q) == 1)
        first, end = np.concatenate([[0], np.flatnonzero(~follows) + 1]), np.concatenate([
            np.flatnonzero(~follows), [len(p) - 1],
        ])
        start, stop, diagonal = p[first], p[end], p[first] - q[first]
        before, opened_now = opened if d[part[0]] == last + 1 else {}, {}
        for k in np.flatnonzero(start == d[part[0]]) if before else ():
            start[k] = before.pop(int(diagonal[k]), start[k])
        for x, s in (before or opened).items():  # closed at the end of the lot before
            take(last - s + 1, [(s, s - x)])
        last = int(d[part[-1]])
        closed = stop != last
        opened_now = dict(zip(diagonal[~closed].tolist(), start[~closed].tolist(), strict=True))
        if closed.any():
            length = (stop - start + 1)[closed]
            longest = length == length.max()
            take(
                int(length.max()),
                list(zip(start[closed][longest].tolist(), (start - diagonal)[closed][longest].tolist(), strict=True)),
            )
        opened = opened_now
    for x, s in opened.items():
        take(last - s + 1, [(s, s - x)])
    return most, sorted(found)


def greedy_tiles(
    doc: np.ndarray, pos: np.ndarray, item: np.ndarray, min_match: int, lot: int = PAIR_LOT,
) -> list[tuple[int, int, int]]:
    """(doc position, item position, length) of the tiles; pos are the positions of the tokens of doc, which may have gaps."""
    doc_free, item_free, out = np.ones(len(doc), bool), np.ones(len(item), bool), []
    joined = np.concatenate([np.diff(pos) == 1, [False]]) if len(pos) else np.zeros(0, bool)

    def runs(t: np.ndarray, free: np.ndarray, glued: np.ndarray) -> np.ndarray:
        n = len(t) - min_match + 1
        if n < 1:
            return np.zeros(0, np.int64)
        whole = np.convolve(free, np.ones(min_match, np.int64), "valid") == min_match
        if min_match > 1:
            whole &= np.convolve(glued[: len(t) - 1], np.ones(min_match - 1, np.int64), "valid") == min_match - 1
        return np.flatnonzero(whole)

    dh, ih = rolled(doc, min_match), rolled(item, min_match)
    while True:
        d, i = runs(doc, doc_free, joined), runs(item, item_free, np.ones(len(item), bool))
        i = i[np.argsort(ih[i], kind="stable")] if len(i) else i
        windows, found = longest_runs(
            d, np.searchsorted(ih[i], dh[d], "left"), np.searchsorted(ih[i], dh[d], "right"), i, lot,
        ) if len(d) and len(i) else (0, [])
        if not found:
            return out
        most = windows + min_match - 1
        for s, e in found:
            if doc_free[s : s + most].all() and item_free[e : e + most].all():
                doc_free[s : s + most] = item_free[e : e + most] = False
                out.append((int(pos[s]), e, most))


def _item_udf(min_match: int) -> Callable:
    @F.arrow_udf("struct<words:array<bigint>,seeds:array<bigint>>")
    def item_words(text: pa.Array) -> pa.Array:
        words = [tokens(t.as_py()) for t in text]
        seeds = [rolled(w, min(min_match, len(w))).view(np.int64).tolist() for w in words]
        kind = pa.list_(pa.int64())
        return pa.StructArray.from_arrays(
            [pa.array([w.view(np.int64).tolist() for w in words], kind), pa.array(seeds, kind)], ["words", "seeds"],
        )

    return item_words


def _hits(text: pa.Array, widths: list[int], bitmap: bytes, bits: int) -> pa.Array:
    """The parts of each document that may match: words, their positions, and the seeds; null if there are none."""
    words, positions, seeds, null = [], [], [], []
    for t in text:
        w, found = tokens(t.as_py()), [np.zeros(0, np.uint64)]
        hit = np.zeros(len(w) + 1, np.int64)
        for width in widths:
            h = rolled(w, width)
            k = np.flatnonzero(in_bitmap(h, bitmap, bits))
            np.add.at(hit, k, 1)
            np.add.at(hit, k + width, -1)
            found.append(np.unique(h[k]))
        k = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
        words.append(w[k].view(np.int64))
        positions.append(k.astype(np.int32))
        seeds.append(np.concatenate(found).view(np.int64))
        null.append(not len(k))
    kind = pa.list_(pa.int64())
    return pa.StructArray.from_arrays(
        [pa.array(words, kind), pa.array(positions, pa.list_(pa.int32())), pa.array(seeds, kind)],
        ["words", "pos", "seeds"], mask=pa.array(null, pa.bool_()),
    )


def shared_seeds(doc_seeds: np.ndarray, item: np.ndarray, width: int) -> int:
    """How many of the item's seeds, repeats included, the document has."""
    return int(np.isin(rolled(item, width), doc_seeds.view(np.uint64)).sum())


def _tile_udf(min_match: int, coverage: float) -> Callable:
    @F.arrow_udf(PAIR)
    def tile_pairs(words: pa.Array, pos: pa.Array, seeds: pa.Array, item: pa.Array) -> pa.Array:
        rows = []
        for w, p, h, i in zip(words, pos, seeds, item, strict=True):
            w, p, h, i = (np.asarray(x.values) for x in (w, p, h, i))
            i, width = i.view(np.uint64), min(min_match, len(i))
            enough = shared_seeds(h, i, width) * min_match >= coverage * len(i)
            tiles = greedy_tiles(w.view(np.uint64), p, i, width) if enough else []
            rows.append({
                "covered": sum(t[2] for t in tiles), "n_tiles": len(tiles),
                "tiles": [dict(zip(("doc_pos", "item_pos", "length"), t, strict=True)) for t in tiles],
            })
        tile = pa.struct([("doc_pos", pa.int32()), ("item_pos", pa.int32()), ("length", pa.int32())])
        return pa.array(rows, pa.struct([("covered", pa.int32()), ("n_tiles", pa.int32()), ("tiles", pa.list_(tile))]))

    return tile_pairs


def rare_seeds(seeds: DataFrame, held: DataFrame, min_match: int, coverage: float) -> DataFrame:
    """seeds(item_id, item_key, n, seed, times) to (seed, item_id, item_key) of those of which a document that can reach the coverage has one at least.

    held(seed) has a row for each document and seed. An item's seeds are taken from the rarest on until the rest would not do without them.
    """
    often = materialize(held.groupBy(F.col("seed").alias("s")).agg(F.count("*").alias("docs")), "seed_counts")
    placed = seeds.join(often, F.col("seed") == F.col("s"))  # a seed that no document has needs no join
    rarest = Window.partitionBy("item_id", "item_key", "n").orderBy(F.desc("docs"), "seed").rowsBetween(
        Window.unboundedPreceding, 0,
    )
    up_to = placed.withColumn("up_to", F.sum("times").over(rarest))  # of this seed and the commoner ones
    return up_to.where(F.col("up_to") * min_match >= coverage * F.col("n")).select(
        "seed", F.col("item_id").alias("c_item_id"), F.col("item_key").alias("c_item_key"),
    ).distinct()


def _pairs(
    docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, min_match: int,
    coverage: float,
) -> DataFrame:
    """(doc_id, text_key, item_id, n_words, covered, n_tiles, tiles, coverage) of contaminated rows."""
    spark = docs.sparkSession
    items = bench.select(
        F.xxhash64(col(item_text)).alias("item_key"), col(item_col).alias("item_id"),
        _item_udf(min_match)(col(item_text)).alias("i"),
    )
    items = materialize(
        items.where(F.size("i.words") > 0).select(
            "item_id", "item_key", F.col("i.words").alias("item_words"), F.col("i.seeds").alias("item_seeds"),
        ),
        "bench_items",
    )
    seeds = items.select("item_id", "item_key", F.size("item_words").alias("n"), F.explode("item_seeds").alias("seed"))
    seeds = materialize(
        seeds.groupBy("item_id", "item_key", "n", "seed").agg(F.count("*").alias("times")), "bench_seeds",
    )
    widths = sorted(r[0] for r in seeds.select(F.least("n", F.lit(min_match))).distinct().collect())  # min_match values at most
    bits = min(BITMAP_BITS[1], max(BITMAP_BITS[0], (BITS_PER_SEED * seeds.count()).bit_length()))
    bitmap = spark.sparkContext.broadcast(bitmap_of(seeds, "seed", bits))
    hits = docs.select(
        col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("text_key"),
        _hits_of(bitmap, widths, bits)(col(text_col)).alias("h"),
    )
    hits = materialize(
        hits.where(F.col("h").isNotNull()).select("doc_id", "text_key", "h.*").dropDuplicates(["doc_id", "text_key"]),
        "seed_hits",
    )
    held = hits.select("doc_id", "text_key", F.explode("seeds").alias("seed"))
    joined = materialize(rare_seeds(seeds, held.select("seed"), min_match, coverage), "rare_seeds")
    near = held.join(joined, "seed").select(
        F.col("doc_id").alias("c_doc_id"), F.col("text_key").alias("c_text_key"), "c_item_id", "c_item_key",
    ).distinct()
    both = near.join(hits, F.col("c_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("c_text_key") == F.col("text_key")))
    both = both.join(
        items.dropDuplicates(["item_id", "item_key"]),
        F.col("c_item_id").eqNullSafe(F.col("item_id")) & (F.col("c_item_key") == F.col("item_key")),
    )
    tiled = both.withColumn(
        "t", _tile_udf(min_match, coverage)("words", "pos", "seeds", "item_words"),
    ).withColumn("n_words", F.size("item_words"))
    out = tiled.select(
        "doc_id", "text_key", "item_id", "n_words", "t.*",
    ).withColumn("coverage", F.col("covered") / F.col("n_words"))
    return out.where(F.col("coverage") >= coverage)


def _hits_of(bitmap, widths: list[int], bits: int) -> Callable:
    """The hits of a batch, by the bitmap that Spark sent to each executor once."""

    @F.arrow_udf("struct<words:array<bigint>,pos:array<int>,seeds:array<bigint>>")
    def seed_hits(text: pa.Array) -> pa.Array:
        return _hits(text, widths, bitmap.value, bits)

    return seed_hits


def contaminated(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE,
) -> DataFrame:
    """One row for each contaminated document and item: ids, n_words of the item, covered, coverage, n_tiles and the tiles."""
    out = _pairs(docs, bench, id_col, text_col, item_col, item_text, min_match, coverage)
    best = out.groupBy(
        "doc_id", "item_id",
    ).agg(F.max_by(
        F.struct("n_words", "covered", "coverage", "n_tiles", "tiles"), F.struct("coverage", "covered", "text_key"),
    ).alias("b"))
    return best.select(F.col("doc_id").alias(id_col), "item_id", "b.*")


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs without the rows that an item contaminates."""
    args = {"item_col": "item_id", "item_text": "text", "min_match": MIN_MATCH, "coverage": COVERAGE} | kw
    found = _pairs(docs, bench, id_col, text_col, **args)
    did, key = fresh(docs, "bad_id"), fresh(docs, "bad_key")
    bad = found.select(F.col("doc_id").alias(did), F.col("text_key").alias(key)).distinct()
    return docs.join(bad, col(id_col).eqNullSafe(F.col(did)) & (F.xxhash64(col(text_col)) == F.col(key)), "left_anti")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "covered", "n_tiles", "coverage")
