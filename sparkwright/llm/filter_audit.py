"""Filter interaction audit: what each of several filters removes in every order of them, by part of the corpus.

A document's failures make a mask, one bit for each filter; documents are counted by part and mask, which leaves 2 ** n rows of a part
at most. Each part's counts become a decision diagram: a node asks one filter, its two edges lead to what passes and what fails, and it
weighs what its masks weigh; equal nodes are one. Two neighbouring filters are exchanged by rebuilding their two levels alone,
and a sequence of such swaps visits every order. In each order the path of passes from the root tells the steps: the weight of a
node's failing edge is what its filter removes there, that of the passing edge what is kept.

Filters: A, under MIN_WORDS words; B, under MIN_DISTINCT percent of the words distinct; C, over MOST_CAPITALS percent of the code points in A-Z;
D, any of SYMBOLS; E, the same text as a document of a smaller id.

Defined results: a null text is an empty one, which has no words: it fails A, and E if not the first. A null language is the part of empty strings.
A row without an id comes after all ids: it fails E where any row with an id has its text, and else passes. Rows that repeat an id and text are counted each, and none of them makes
another fail. A document with several labels counts as good or toxic if any of them says so; labels without an id belong to no document. Further columns are passed
over, whatever their names. An empty table gives no rows. Very long texts are read whole. There are no ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, materialize, table, text_bytes

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What is counted of each mask, besides all documents.
WEIGHTS = ("n", "good", "toxic")
RESULT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)


def own_failures(raw: bytes) -> int:
    """Bits 0 to 3: whether a text fails A to D."""
    words = raw.split()
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MOST_CAPITALS * len(raw.decode())) << 2
        | (len(raw) > len(raw.translate(None, SYMBOLS))) << 3
    )


@F.arrow_udf(T.StructType().add("mask", "integer").add("key", "binary"))
def judged(text: pa.Array) -> pa.Array:
    """The own failures of each text, and a 128-bit key of it."""
    raws = (text_bytes(t.as_py()) for t in text)
    rows = [(own_failures(raw), xxhash.xxh3_128_digest(raw)) for raw in raws]
    return pa.StructArray.from_arrays(
        [pa.array([m for m, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.binary())], ["mask", "key"],
    )


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of docs(doc_id, text, lang) and labels(doc_id, quality, toxic).

    The first id of each text is a minimum, so copies are counted where they lie. It is joined by id and text, and labels by id, so no group of copies meets.
    """
    each = materialize(
        docs.select(
            col("doc_id").alias("id"), F.coalesce(col("lang").cast("string"), F.lit("")).alias("part"),
            judged(col("text")).alias("j"),
        ).select("id", "part", "j.*"),
        "failures",
    )
    first = each.groupBy("key").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    says = labels.where(col("doc_id").isNotNull()).groupBy(col("doc_id").alias("id")).agg(
        F.max(F.coalesce(col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    )
    same = each["key"].eqNullSafe(first["key"]) & each["id"].eqNullSafe(first["id"])
    placed = each.join(first, same, "left").select(
        each["id"], "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + 16).alias("mask"),
    )
    return placed.join(says, "id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
    )


class Diagram:
    """A decision diagram over masks of n filters whose terminals are counts.

    levels[d] maps a node of depth d to its (passing, failing) nodes of depth d + 1; terminals have depth n. weight[d][node] is the sum below.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], n: int, width: int):
        self.order = list(range(n))
        self.levels: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.weight: list[list[np.ndarray]] = [[] for _ in range(n + 1)]
        zero, found = (0,) * width, {}
        terminals: list[tuple[int, ...]] = []

        def build(depth: int, mask: int) -> int:
            if depth == n:
                w = tuple(counts.get(mask, zero))
                if w not in found:
                    found[w] = len(terminals)
                    terminals.append(w)
                return found[w]
            return self.node(depth, build(depth + 1, mask), build(depth + 1, mask | 1 << depth), made[depth])

        made: list[dict[tuple[int, int], int]] = [{} for _ in range(n)]
        self.root = build(0, 0)
        self.weight[n] = [np.array(w, np.int64) for w in terminals]
        for depth in reversed(range(n)):
            self.weigh(depth)

    def node(self, depth: int, passing: int, failing: int, made: dict[tuple[int, int], int]) -> int:
        """The node of that depth with those two edges; equal ones are one."""
        edges = (passing, failing)
        if edges not in made:
            made[edges] = len(self.levels[depth])
            self.levels[depth].append(edges)
        return made[edges]

    def weigh(self, depth: int) -> None:
        below = self.weight[depth + 1]
        self.weight[depth] = [below[p] + below[f] for p, f in self.levels[depth]]

    def swap(self, depth: int) -> None:
        """Exchanges the filters of depth and depth + 1: only these two levels are built again."""
        upper, lower = self.levels[depth], self.levels[depth + 1]
        self.levels[depth + 1], made, top = [], {}, []
        for p, f in upper:
            (pp, pf), (fp, ff) = lower[p], lower[f]
            top.append((self.node(depth + 1, pp, fp, made), self.node(depth + 1, pf, ff, made)))
        self.levels[depth] = top  # as many nodes as before, so what leads to them holds
        self.weigh(depth + 1)
        self.order[depth], self.order[depth + 1] = self.order[depth + 1], self.order[depth]

    def steps(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(filter, weight kept, weight removed) along the path of passes."""
        at = self.root
        for depth, which in enumerate(self.order):
            p, f = self.levels[depth][at]
            yield which, self.weight[depth + 1][p], self.weight[depth + 1][f]
            at = p


def swaps(n: int) -> Iterator[int]:
    """Positions whose swaps, one after the other, lead through every order of n things once."""
    if n < 2:
        return
    inner = [*swaps(n - 1), None]
    for k, move in enumerate(inner):
        yield from range(n - 2, -1, -1) if k % 2 == 0 else range(n - 1)
        if move is not None:
            yield move + (k % 2 == 0)  # the moving thing stands first, or else last


def audit(counts: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step."""
    n = len(filters)
    diagram = Diagram(counts, n, len(WEIGHTS))
    fails, alone, shared, seen = [0] * n, [0] * n, [0] * n, []
    for move in (None, *swaps(n)):
        if move is not None:
            diagram.swap(move)
        path = [*diagram.steps()]
        seen.append((diagram.order.copy(), path))
        fails[path[0][0]] = int(path[0][2][0])  # asked first, a filter removes all that fail it
        alone[path[-1][0]] = int(path[-1][2][0])  # asked last, those that fail nothing else
        for which, _, removed in path:
            shared[which] += int(removed[0])
    return [
        (
            "".join(filters[i] for i in order), step, int(kept[0]), int(removed[0]), fails[which] - int(removed[0]),
            alone[which], int(removed[1]), int(removed[2]), shared[which],
        )
        for order, path in seen
        for step, (which, kept, removed) in enumerate(path, 1)
    ]


def _audit_part(key: tuple, rows: pa.Table, filters: str) -> pa.Table:
    counts = {r["mask"]: tuple(r[w] for w in WEIGHTS) for r in rows.to_pylist()}
    found = audit(counts, filters)
    columns = [[key[0].as_py()] * len(found), *map(list, zip(*found, strict=True))]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    names = [x.split()[0] for x in RESULT.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def filter_audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """RESULT for each part of counts(part, mask, *WEIGHTS): a group holds 2 ** len(filters) rows at most."""
    run: Callable = partial(_audit_part, filters=filters)
    return counts.groupBy("part").applyInArrow(lambda key, rows: run(key, rows), RESULT)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
f AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
w AS (SELECT d.*, regexp_extract_all(d.text, '[^\x20\x09-\x0D]+') AS words, doc_id > first AS copy FROM d JOIN f USING (text)),
m AS (SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
  100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(text) AS c,
  length(text) > length(translate(text, '#$%&*|', '')) AS d, copy AS e, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM w LEFT JOIN labels USING (doc_id)),
g AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest([1, 2, 4, 8, 16]) AS bit, unnest(['A', 'B', 'C', 'D', 'E']) AS name),
o AS (SELECT p.name || q.name || r.name || s.name || t.name AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM x p, x q, x r, x s, x t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
k AS (SELECT filter_order, i::INT AS step, bits[i] AS bit, coalesce(list_sum(bits[1 : i - 1]), 0)::INT AS before FROM o, range(1, 6) u(i)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM g, k GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
