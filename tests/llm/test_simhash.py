import re

import numpy as np
import pytest
import xxhash

from sparkwright.llm import simhash
from sparkwright.llm.graph import components
from tests.llm.helpers import empty, odd, prose


def brute_print(t, width=3, seed=42):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64(s.encode(), seed=seed).intdigest() for s in ([" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius, width=3):
    """rows: (id, text) to {id: (fingerprint, smallest id reachable)}."""
    prints = [brute_print(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, prints[i], least.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def shown(df):
    return sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in simhash.op2_simhash(spark, sf).collect()), key=str)
    assert got == brute_components(docs, 3)


@pytest.mark.parametrize("radius", [0, 3, 10])
def test_odd_documents(spark, radius):
    df = odd(spark, "fp root component_id text_key")
    assert shown(simhash.near_duplicates(df, radius=radius)) == brute_components([(r["doc_id"], r["text"]) for r in df.collect()], radius)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_tiles_cut_and_dense_groups(spark):
    """Fingerprints of a dense ball, in tiles far smaller than the groups, link as all pairs do."""
    rng = np.random.default_rng(1)
    fps = {int(rng.integers(1 << 62))}
    base = list(fps)[0]
    for _ in range(300):
        x = base
        for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(1 << 62, size=200)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp0 bigint"), 3, tile=16)
    assert links.count() < 300 * 299 / 2
    got = {r["node"]: r["root"] for r in components(links.toDF("a", "b")).collect()}
    v = np.array(signed, np.int64).view(np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    label = np.arange(len(v))
    for _ in range(len(v)):
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    groups, found = {}, {}
    for x, k in zip(signed, label, strict=True):
        groups.setdefault(int(k), set()).add(x)
        found.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_block_masks_leave_no_pair_out():
    rng = np.random.default_rng(2)
    for radius in (0, 3, 10):
        masks = simhash.block_masks(radius)
        for _ in range(200):
            x = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(not x & (m & (1 << 64) - 1) for m in masks)


def test_components_of_a_long_chain(spark):
    got = components(spark.createDataFrame([(i, i + 1) for i in range(50)] + [(90, 80), (80, 85)], "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in got} == {i: 0 for i in range(51)} | {80: 80, 85: 80, 90: 80}


def test_one_of_each(spark):
    df = odd(spark, "row kept_id kept_key")
    out = simhash.one_of_each(df)
    want = {c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in df.collect()], 3)}
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} == want and out.count() == len(want)


def test_second_fingerprint(spark):
    text = prose(5, 400)
    rows = [(1, text), (2, text.replace(text.split()[200], "changed")), (3, prose(6, 400)), (4, "")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), radius=10, width=5, more_radius=12).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_tile_pairs_skip_by_population_count():
    """Of two bands whose counts differ, only pairs of sub-tiles within the radius meet, and guests never meet guests."""
    rng = np.random.default_rng(4)
    fps = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(8, 56, 400)], np.uint64)
    pops, guest, one = np.bitwise_count(fps).astype(int), np.arange(400) % 2 == 1, np.zeros(400, np.int64)
    met = {(int(i), int(j)) for x, y in simhash.tile_pairs(fps, one, guest, 3, size=16) for i in x.at for j in y.at}
    assert len(met) < 400 * 401 / 4
    near = {(i, j) for i in range(400) for j in range(i) if abs(pops[i] - pops[j]) <= 3 and not (guest[i] and guest[j])}
    assert near <= met | {(j, i) for i, j in met}
    every = simhash._sub_tiles(fps, np.arange(400), guest, 16)
    assert sum(1 for _ in simhash.tile_pairs(fps, one, guest, 3, size=16)) < len(every) * (len(every) + 1) // 3


def test_bands_of_population_meet_their_neighbours_only(spark):
    """Fingerprints that agree in all dealt blocks but one, with counts 0, 1 ... : links go to counts within the radius, as for all pairs."""
    fps = [(1 << k) - 1 for k in range(20)]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp0 bigint"), 1)
    got = {r["node"]: r["root"] for r in components(links.toDF("a", "b")).collect()}
    assert got == {x: 0 for x in fps}
    far = [(1 << k) - 1 for k in range(0, 40, 4)]
    assert simhash.fingerprint_links(spark.createDataFrame([(x,) for x in far], "fp0 bigint"), 3).count() == 0
