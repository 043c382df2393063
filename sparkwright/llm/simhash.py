"""SimHash near-dedup: tiled exact comparison of 64-bit fingerprints.

Distinct fingerprints are dealt into tiles: with a radius of r bits and r + 2 blocks of bits, two linked
fingerprints agree in two blocks at least, so a tile holds fingerprints that agree in one pair of blocks. Tiles are
also dealt by bands of the population count, r + 1 counts wide: a fingerprint is a member of its own band's tile and a
guest of the tile below, so bands whose counts differ beyond the radius never meet. A tile that is too large is cut
into smaller ones, each pair of which is compared. Inside, numpy exclusive-or and bit counts compare sub-tiles sorted
by population count, and pairs of sub-tiles whose counts differ beyond the radius, or that hold guests
only, are skipped. Nothing is approximated: every link within the radius is found. A tile hands on a spanning
forest of its links, never all pairs, and components are joined from those.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other. Rows with
the same text always share a component. A null id has a fingerprint and a component but is never a
component's id, which is null only if the component has no other. Other columns are passed over. An
empty table gives an empty result. A very long text is hashed 2**15 shingles at a time, so its memory grows with its words only. There
are no ties: a bit set in exactly half of the shingles is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, col, fresh, in_bitmap, materialize, table, text_bytes
from .graph import components

BITS, SEED = 64, 42
#: Bands of minima of the shingle hashes, and minima in a band: of pairs of similarity 0.8, 0.04 % share no band.
BANDS, MINIMA = 20, 5
MULTIPLIERS = np.random.default_rng(SEED).integers(
    1 << 63, size=BANDS * MINIMA, dtype=np.uint64,
) * np.uint64(2) + np.uint64(1)
#: Shingles, about, of a side of a tile of texts that are compared exactly.
TILE_SHINGLES = 1 << 18
#: Bits of the bitmap of texts with a candidate, as a power of two: 2 MB, however many there are.
BITMAP_BITS = 24
#: Fingerprints of a tile, about, before it is cut; and of a sub-tile that numpy compares at once.
TILE, SUB = 4096, 1024


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """Bit i is set if it is set in over half the XXH64 of the shingles, repeats included."""
    return fingerprints(text, width, (seed,))[0]


def fingerprints(text: str | None, width: int, seeds: tuple[int, ...]) -> list[int]:
    words = text_bytes(text).lower().split()
    if not words:
        return [0] * len(seeds)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        return [digest(joined, seed) for seed in seeds]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans, counts = list(zip(
        starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True,
    )), np.zeros((len(seeds), BITS), np.int64)
    for at in range(0, len(spans), 1 << 15):
        shingles = [joined[s:e] for s, e in spans[at : at + (1 << 15)]]
        for i, seed in enumerate(seeds):
            h = np.array([digest(x, seed) for x in shingles], np.uint64)
            counts[i] += np.unpackbits(
                h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little",
            ).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(spans), axis=1, bitorder="little").view(np.uint64).ravel().tolist()


def _fingerprint_udf(width: int, seeds: tuple[int, ...]) -> Callable:
    @F.arrow_udf("array<bigint>")
    def simhash64(text: pa.Array) -> pa.Array:
        rows = np.array([fingerprints(t.as_py(), width, seeds) for t in text], np.uint64).view(np.int64)
        return pa.array(list(rows.reshape(-1, len(seeds))), pa.list_(pa.int64()))

    return simhash64


def block_masks(radius: int) -> list[int]:
    """Masks of each pair out of radius + 2 blocks, as signed longs."""
    cuts = np.linspace(0, BITS, radius + 3).astype(int).tolist()
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in (a | b for a, b in combinations(blocks, 2))]


class SubTile(NamedTuple):
    at: np.ndarray  # places in the tile
    fps: np.ndarray
    low: int  # the least population count
    high: int
    guest: bool


def _sub_tiles(fps: np.ndarray, at: np.ndarray, guest: np.ndarray, size: int = SUB) -> list[SubTile]:
    """The fingerprints at these places, members and guests apart, each sorted by population count."""
    pops = np.bitwise_count(fps)
    out = []
    for g in (False, True):
        of = at[guest[at] == g]
        of = of[np.argsort(pops[of], kind="stable")]
        out += [SubTile(
            i, fps[i], int(pops[i[0]]), int(pops[i[-1]]), g,
        ) for i in (of[k : k + size] for k in range(0, len(of), size))]
    return out


def tile_pairs(
    fps: np.ndarray, side: np.ndarray, guest: np.ndarray, radius: int, size: int = SUB,
) -> Iterator[tuple[SubTile, SubTile]]:
    """Pairs of sub-tiles of one tile, or of its two sides, that can hold links of a member."""
    halves = [_sub_tiles(fps, np.flatnonzero(side == s), guest, size) for s in np.unique(side)]
    for n, x in enumerate(halves[0]):
        for y in halves[-1][n if len(halves) == 1 else 0 :]:
            if not (x.guest and y.guest or y.low - x.high > radius or x.low - y.high > radius):
                yield x, y


def link_forest(
    fps: np.ndarray, side: np.ndarray, radius: int, more: np.ndarray | None = None, more_radius: int = BITS,
    guest: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Places (node, root) of a spanning forest of the links of one tile, or of those between its two sides; more: second fingerprints that must agree too."""
    ids = np.arange(len(fps))
    root = ids.copy()
    for x, y in tile_pairs(fps, side, np.zeros(len(fps), bool) if guest is None else guest, radius):
        a, b = np.nonzero(np.bitwise_count(x.fps[:, None] ^ y.fps[None, :]) <= radius)
        a, b = x.at[a], y.at[b]
        if more is not None:
            near = np.bitwise_count(more[a] ^ more[b]) <= more_radius
            a, b = a[near], b[near]
        while True:  # hook the larger root under the smaller one and shorten the paths, until no link is left between trees
            p, q = root[a], root[b]
            apart = p != q
            if not apart.any():
                break
            a, b, p, q = a[apart], b[apart], p[apart], q[apart]
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while (shorter := root[root]).tobytes() != root.tobytes():
                root = shorter
    node = np.flatnonzero(root != ids)
    return node, root[node]


def _compare(radius: int, more_radius: int | None) -> Callable:
    keys = 5  # pair, block, band, x, y; then side, whether a guest, and one or two fingerprints

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def links(parts: list[np.ndarray], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
            side, guest, prints = parts[keys], parts[keys + 1], parts[keys + 2 :]
            fps, more = prints[0].view(np.uint64), prints[1].view(np.uint64) if more_radius is not None else None
            found = []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if e - s > 1:
                    node, root = link_forest(
                        fps[s:e], side[s:e], radius, more[s:e] if more is not None else None, more_radius or 0,
                        guest[s:e],
                    )
                    if len(node):
                        found.append([p[s:e][k] for k in (node, root) for p in prints])
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)],
                    [f"{k}{i}" for k in "ab" for i in range(len(prints))],
                )

        for batch in batches:
            parts = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                parts = [np.concatenate(x) for x in zip(rest, parts, strict=True)]
            if not len(parts[0]):
                continue
            starts = np.flatnonzero(np.logical_or.reduce([p[1:] != p[:-1] for p in parts[:keys]])) + 1
            last = int(starts[-1]) if len(starts) else 0
            yield from links(parts, np.concatenate([[0], starts]))
            rest = [p[last:] for p in parts]  # the tile that may go on in the next batch
        if rest is not None:
            yield from links(rest, np.array([0, len(rest[0])]))

    return compare


def fingerprint_links(fps: DataFrame, radius: int = 3, more_radius: int | None = None, tile: int = TILE) -> DataFrame:
    """Distinct fps(fp0), or fps(fp0, fp1) if more_radius is given, to links (a0, b0) or (a0, a1, b0, b1) that join the same components as all pairs within the radius would."""
    prints = ["fp0"] if more_radius is None else ["fp0", "fp1"]
    masks = F.array(*(F.lit(m).cast("long") for m in block_masks(radius)))
    dealt = fps.select(
        *prints, F.posexplode(masks).alias("pair", "mask"),
        F.floor(F.bit_count("fp0") / (radius + 1)).cast("int").alias("own"),
    )
    dealt = dealt.select(
        "pair", F.col("fp0").bitwiseAND(F.col("mask")).alias("block"), "own",
        F.explode(F.array(F.lit(False), F.lit(True))).alias("guest"), *prints,
    )
    dealt = dealt.withColumn("band", F.col("own") - F.col("guest").cast("int")).drop("own")
    tile_of = ["pair", "block", "band"]
    sizes = dealt.groupBy(*tile_of).agg(
        F.count("*").alias("n"), F.count_if(~F.col("guest")).alias("members"),
    ).where("n > 1 AND members > 0")
    # most tiles are small: only the large ones are joined, to be cut
    large = materialize(
        sizes.where(F.col("n") > tile).select(*tile_of, F.ceil(F.col("n") / tile).cast("int").alias("cuts")),
        "large_tiles",
    )
    cut = dealt.join(large, tile_of, "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    cut = cut.withColumn("side", F.pmod(F.xxhash64(*prints), F.col("cuts")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    tiles = met.select(
        *tile_of, F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "guest", *prints,
    )
    sorted_tiles = tiles.repartition(*tile_of, "x", "y").sortWithinPartitions(*tile_of, "x", "y")
    return sorted_tiles.mapInArrow(
        _compare(radius, more_radius), ", ".join(f"{k}{i} bigint" for k in "ab" for i in range(len(prints))),
    )


def _classified(
    docs: DataFrame, id_col: str, text_col: str, radius: int, width: int, more_radius: int | None,
) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id) of each row; fp and root are fingerprints, or structs of two of them."""
    text, n = col(text_col), 1 if more_radius is None else 2

    def node(prefix: str) -> Column:
        return F.col(f"{prefix}0") if n == 1 else F.struct(
            F.col(f"{prefix}0").alias("fp0"), F.col(f"{prefix}1").alias("fp1"),
        )

    prints = docs.select(
        col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"),
        _fingerprint_udf(width, tuple(range(SEED, SEED + n)))(text).alias("f"),
    )
    prints = materialize(
        prints.select("doc_id", "text_key", *(F.get("f", F.lit(i)).alias(f"fp{i}") for i in range(n))), "fingerprints",
    )
    classes = materialize(
        prints.groupBy(*(f"fp{i}" for i in range(n))).agg(F.min("doc_id").alias("least")), "fp_classes",
    )
    roots = components(fingerprint_links(classes, radius, more_radius).select(
        node("a").alias("a"), node("b").alias("b"),
    ))
    rooted = classes.select(node("fp").alias("fp"), "least").join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"),
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(named, "root").select(F.col("fp").alias("of"), "root", "component_id")
    return prints.select("doc_id", "text_key", node("fp").alias("fp")).join(of, F.col("fp") == F.col("of")).drop("of")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3,
    more_radius: int | None = None,
) -> DataFrame:
    """One row for each row of docs: id, fp (long) and component_id, the smallest id reachable by links.

    With more_radius, a second fingerprint of another seed must lie within it too; fp is then a struct of both.
    """
    return _classified(docs, id_col, text_col, radius, width, more_radius).select(
        F.col("doc_id").alias(id_col), "fp", "component_id",
    )


def _chosen(docs: DataFrame, best: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that best(best) names by doc_id and text_key, each once. best.n is how many rows have both: only those of more are grouped."""
    kid, key, n = fresh(docs, "kept_id"), fresh(docs, "kept_key"), fresh(docs, "kept_n")
    best = best.select(
        F.col("best.doc_id").alias(kid), F.col("best.text_key").alias(key), F.col("best.n").alias(n),
    ).distinct()
    found = docs.join(best, col(id_col).eqNullSafe(F.col(kid)) & (F.xxhash64(col(text_col)) == F.col(key)))
    once = found.where(F.col(n) > 1).groupBy(kid, key).agg(F.min_by(F.struct(*map(col, docs.columns)), F.struct(col(text_col))).alias("row"))  # in a struct, so a null text is a row too
    return found.where(F.col(n) == 1).select(*map(col, docs.columns)).union(once.select("row.*"))


def _best(n: str = "n") -> Column:
    """Of rows (doc_id, text_key, n) the one of the smallest id, ids before null."""
    return F.min_by(
        F.struct("doc_id", "text_key", n), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"),
    ).alias("best")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3,
    more_radius: int | None = None,
) -> DataFrame:
    """docs with one row of each component, that of its smallest id (ids before null; of rows that repeat it, one of the smallest text)."""
    rows = _classified(
        docs, id_col, text_col, radius, width, more_radius,
    ).groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    return _chosen(docs, materialize(rows.groupBy("root").agg(_best()), "best"), id_col, text_col)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles; of all words if they are fewer than width, so never empty."""
    words = text_bytes(text).lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    return np.unique(np.fromiter(
        (digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :], strict=False)), np.uint64,
        len(words) - width + 1,
    ))


def _set_sketch(h: np.ndarray) -> list[int]:
    """Key of a set of hashes, its fingerprint, and a key for each band of minima."""
    ones, least = np.zeros(BITS, np.int64), np.full(BANDS * MINIMA, (1 << 64) - 1, np.uint64)
    for at in range(0, len(h), 1 << 13):
        x = h[at : at + (1 << 13)]
        ones += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        least = np.minimum(least, ((x[:, None] ^ x[:, None] >> np.uint64(31)) * MULTIPLIERS).min(axis=0))
    fp = int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])
    return [
        xxhash.xxh64_intdigest(h.tobytes(), SEED), fp,
        *(xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, MINIMA))),
    ]


def _sketch_udf(width: int) -> Callable:
    @F.arrow_udf("array<bigint>")
    def sketch(text: pa.Array) -> pa.Array:
        rows = np.array([_set_sketch(shingle_set(t.as_py(), width)) for t in text], np.uint64).view(np.int64)
        return pa.array(list(rows.reshape(-1, 2 + BANDS)), pa.list_(pa.int64()))

    return sketch


def _sets(width: int, lot: int = TILE_SHINGLES) -> Callable:
    """(key, text) to (key, shingles) in batches of about `lot` shingles, as a batch of texts may have many times more of them than fit in memory twice."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held, size, first = batch.column(0), [], 0, 0
            for i, t in enumerate(batch.column(1)):
                held.append(shingle_set(t.as_py(), width).view(np.int64))
                size += len(held[-1])
                if size >= lot or i == batch.num_rows - 1:
                    ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [keys[first : i + 1], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))],
                        ["key", "shingles"],
                    )
                    held, size, first = [], 0, i + 1

    return shingles


def _maybe_wanted(bitmap) -> Callable:
    @F.arrow_udf("boolean")
    def maybe_wanted(key: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(key.to_numpy().view(np.uint64), bitmap.value, BITMAP_BITS))

    return maybe_wanted


def similar_forest(
    values: np.ndarray, starts: np.ndarray, side: np.ndarray, similarity: float, known: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Places (node, root) of a forest that joins the pairs of sets, of one tile or between its two sides, whose Jaccard similarity is reached.

    values holds the sets one after the other and starts where each begins; sets of one number in known are joined already. A set
    is compared with all others at once, unless they are joined to it by then.
    """
    n = len(starts)
    sizes = np.diff(np.append(starts, len(values)))
    _, heads, tree = np.unique(np.arange(n) if known is None else known, return_index=True, return_inverse=True)
    root = heads[tree]
    codes = np.unique(values, return_inverse=True)[1]
    left, right = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    of_right = codes[np.isin(np.repeat(side, sizes), side.max())]
    right_starts = np.concatenate([[0], np.cumsum(sizes[right])[:-1]])
    mark = np.zeros(codes.max() + 1, bool)
    for i in left:
        if (root[right] == root[i]).all():
            continue
        own = codes[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        shared = np.add.reduceat(mark[of_right].astype(np.int64), right_starts)
        mark[own] = False
        near = right[shared + 1e-9 >= similarity * (sizes[right] + sizes[i] - shared)]
        trees = np.unique(np.append(root[near], root[i]))
        if len(trees) > 1:
            root[np.isin(root, trees)] = trees[0]
    node = heads[root[heads] != heads]
    return node, root[node]


def _verify(similarity: float) -> Callable:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the tile so far: its keys, and what its batches hold of it
        tile: tuple | None = None

        def links() -> Iterator[pa.RecordBatch]:
            side, key, comp, sizes, values = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(key) > 1:
                node, root = similar_forest(values, np.cumsum(sizes) - sizes, side, similarity, comp)
                if len(node):
                    yield pa.RecordBatch.from_arrays([pa.array(key[node]), pa.array(key[root])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            *keys, side, key, comp = (batch.column(i).to_numpy() for i in range(6))
            sets = batch.column(6)
            sizes, values = sets.value_lengths().to_numpy().astype(np.int64), sets.flatten().to_numpy()
            ends = np.cumsum(sizes)
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            for s, e in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                this = tuple(k[s] for k in keys)
                if held and this != tile:
                    yield from links()
                    held.clear()
                tile = this
                held.append([side[s:e], key[s:e], comp[s:e], sizes[s:e], values[ends[s] - sizes[s] : ends[e - 1]]])
        if held:
            yield from links()

    return verify


def similar_links(sets: DataFrame, similarity: float, tile: int = TILE_SHINGLES) -> DataFrame:
    """sets(root, key, shingles) to links (a, b) that join the same components as all pairs under one root whose similarity is reached.

    With a column comp, keys of one comp are joined already and are not compared: the largest comp under a root is cut into
    blocks that meet the blocks of the others only, and a root with one comp falls out.
    """
    sets = sets if "comp" in sets.columns else sets.withColumn("comp", F.col("key"))
    by_comp = sets.groupBy("root", "comp").agg(F.sum(F.size("shingles").cast("long")).alias("n"))
    roots = by_comp.groupBy("root").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"),
        F.count("*").alias("comps"),
    ).where("comps > 1")
    blocks = [F.greatest(F.lit(1), F.ceil(n / tile)).cast("int").alias(k) for n, k in ((F.col("all") - F.col("most"), "few"), (F.col("most"), "many"))]
    cut = sets.join(materialize(roots.select("root", "main", *blocks), "similar_tiles"), "root")
    in_main = F.col("comp") == F.col("main")
    cut = cut.withColumn(
        "side",
        F.when(
            in_main, F.col("few") + F.pmod(F.xxhash64("key"), F.col("many")),
        ).otherwise(F.pmod(F.xxhash64("key"), F.col("few"))).cast("int"),
    )
    met = cut.withColumn(
        "other",
        F.explode(F.sequence(F.lit(0), F.when(in_main, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)),
    )
    tiles = met.select(
        "root", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "key", "comp",
        "shingles",
    )
    return tiles.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y").mapInArrow(
        _verify(similarity), "a bigint, b bigint",
    )


def candidate_links(classes: DataFrame, radius: int) -> DataFrame:
    """classes(key, fp, bands) to (a, b, n): how often b is linked to a, the least key of a band of minima or of a fingerprint, or one near it."""
    first = materialize(classes.groupBy("fp").agg(F.min("key").alias("a")), "fp_keys")
    same_fp = classes.join(first, "fp").select("a", F.col("key").alias("b"))
    names = first.select("fp", F.col("a").alias("of"))
    near = fingerprint_links(first.select(F.col("fp").alias("fp0")), radius)
    near = near.join(names.toDF("a0", "a"), "a0").join(names.toDF("b0", "b"), "b0").select("a", "b")
    banded = classes.select("key", F.explode("bands").alias("band"))
    least = materialize(
        banded.groupBy("band").agg(F.min("key").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "band_keys",
    )
    every = same_fp.union(near).union(banded.join(least, "band").select("a", F.col("key").alias("b")))
    return every.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def verified(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of links(a, b) whose sets(key, shingles) reach the similarity."""
    one, two = sets.select(
        F.col("key").alias("a"), F.col("shingles").alias("x"),
    ), sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return links.select(
        "a", "b",
    ).join(
        one, "a",
    ).join(two, "b").where(shared + 1e-9 >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def similar_components(
    classes: DataFrame, links: DataFrame, sets: DataFrame, similarity: float, tile: int = TILE_SHINGLES,
) -> DataFrame:
    """(node, root) of classes(key, bands) that verified links join. Three steps, each on what those before left apart:

    the likeliest link of each class; its other links; then all pairs of a band. A large group of near copies is one component after the first
    two, whose work grows in proportion, so that the last one compares what the group leaves apart with it and not the group with itself.
    """
    likely = links.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    found = materialize(verified(likely, sets, similarity), "likely_links")
    joined = components(found)

    def tree(of: str) -> DataFrame:
        return joined.select(F.col("node").alias(of), F.col("root").alias(f"tree_{of}"))

    rest = links.join(
        likely.withColumnRenamed("a", "tried"), "b",
    ).where("a <> tried").join(tree("a"), "a", "left").join(tree("b"), "b", "left")
    rest = rest.where(F.coalesce("tree_a", "a") != F.coalesce("tree_b", "b"))
    found = materialize(found.union(verified(rest, sets, similarity)), "band_links")
    joined = materialize(components(found), "joined")
    banded = classes.select("key", F.explode("bands").alias("band")).join(
        joined, F.col("key") == F.col("node"), "left",
    ).select("band", "key", F.coalesce("root", "key").alias("comp"))
    apart = materialize(
        banded.groupBy("band").agg((F.min("comp") != F.max("comp")).alias("apart")).where("apart").select("band"),
        "bands_apart",
    )
    left = banded.join(apart, "band").join(sets, "key").select(F.col("band").alias("root"), "key", "comp", "shingles")
    return components(found.union(similar_links(left, similarity, tile)))


def one_of_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = 5,
    radius: int = 3,
) -> DataFrame:
    """docs with one row, as in one_of_each, of each group that links of texts join whose sets of shingles have the Jaccard similarity or more.

    Texts of near fingerprints, or with a band of minima of the shingles in common, are candidates, and a link is made only if the
    whole sets reach the similarity. Texts of the same set are one class.
    """
    text = col(text_col)
    prints = docs.select(
        col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), _sketch_udf(width)(text).alias("f"),
    )
    prints = prints.select(
        "doc_id", "text_key", F.get("f", F.lit(0)).alias("key"), F.get("f", F.lit(1)).alias("fp"),
        F.slice("f", 3, BANDS).alias("bands"),
    )
    same = prints.groupBy("key", "doc_id", "text_key").agg(
        F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"),
    )
    classes = materialize(
        materialize(same, "sketches").groupBy("key").agg(
            _best(), F.first("fp").alias("fp"), F.first("bands").alias("bands"),
        ),
        "set_classes",
    )
    links = materialize(candidate_links(classes.select("key", "fp", "bands"), radius), "candidates")
    linked = links.select(F.col("a").alias("of")).union(links.select("b")).distinct()
    wanted = materialize(
        classes.join(linked, F.col("key") == F.col("of")).select(
            "key", F.col("best.doc_id").alias("w_id"), F.col("best.text_key").alias("w_key"),
        ),
        "wanted",
    )
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted, "w_key", BITMAP_BITS))
    texts = docs.select(col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key")).where(_maybe_wanted(bitmap)("text_key"))  # spares the shuffle most texts without a candidate
    # as many partitions as the session asks for, so that no task gets many long texts at once
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same_row = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key"))
    held = texts.join(wanted, same_row).repartition(parts, "key").dropDuplicates(["key"])
    sets = held.select("key", "text").mapInArrow(_sets(width), "key bigint, shingles array<bigint>")
    sets = materialize(sets, "shingle_sets")
    roots = similar_components(classes.select("key", "bands"), links, sets, similarity)
    rooted = classes.select("key", "best").join(roots, F.col("key") == F.col("node"), "left").select(
        F.coalesce("root", "key").alias("root"), "best.*",
    )
    return _chosen(docs, materialize(rooted.groupBy("root").agg(_best()), "best"), id_col, text_col)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
