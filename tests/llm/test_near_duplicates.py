"""SimHash components against all pairs of distinct fingerprints."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from deskgauge.llm import common, components, near_duplicates as N
from llm import samples


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = ([b" ".join(words)] if len(words) < 3
                else [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, near):
    nodes = sorted(set(nodes))
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def linked(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count() <= 3


@pytest.mark.parametrize("crowd", [64, 1])
def test_documents(spark, crowd):
    docs = samples.documents(spark)
    rows = samples.rows(docs, "doc_id", "text")
    prints = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(prints, linked)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    wanted = sorted(((i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints)), key=repr)
    found = N.near_duplicates(docs, crowd)
    assert samples.rows(found) == wanted
    kept = N.representatives(docs, crowd)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(root.values()))
    assert sorted(i for i in ids if i is not None) == sorted(least.values())


def test_empty_table(spark):
    assert N.near_duplicates(samples.empty(spark)).count() == 0
    assert N.representatives(samples.empty(spark)).count() == 0


def signed(p):
    return p - 2**64 if p >= 2**63 else p


@pytest.mark.parametrize("crowd", [64, 3, 1])
def test_any_fingerprints(spark, crowd, tmp_path):
    """Clusters of all distances, chains, and a crowd around one point."""
    rnd = random.Random(11)
    points = [rnd.getrandbits(64) for _ in range(20)]
    prints = set(points)
    for p in points:
        for bits in (1, 2, 3, 3, 4, 5):
            prints.add(p ^ sum(1 << b for b in rnd.sample(range(64), bits)))
    chain = points[0]
    for _ in range(30):
        chain ^= sum(1 << b for b in rnd.sample(range(64), 3))
        prints.add(chain)
    center = rnd.getrandbits(64)
    prints |= {center ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(150)}
    prints |= {0, 2**64 - 1, 1 << 63}
    wanted = plain_components([signed(p) for p in prints], linked)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    edges = N.link_edges(frame, str(tmp_path), crowd).collect()
    assert all(linked(e["u"], e["v"]) for e in edges)
    roots = {r["node"]: r["root"] for r in components.roots(
        N.link_edges(frame, str(tmp_path / "again"), crowd), str(tmp_path / "c")).collect()}
    assert {n: roots.get(n, n) for n in wanted} == wanted


def test_edges_do_not_grow_with_the_square_of_a_crowd(spark, tmp_path):
    """400 fingerprints within two bits: 79,800 links, but a star per point."""
    prints = [0] + [1 << b for b in range(62)] + [3 << b for b in range(62)]
    prints += [(1 << a) | (1 << b) for a in range(0, 62, 3) for b in range(a + 2, 62, 4)]
    frame = spark.createDataFrame([(p,) for p in set(prints)], "fp bigint")
    n = frame.count()
    assert N.crowded_keys(frame).count() > 0
    crowded = common.stored(N.crowded_keys(frame), str(tmp_path), "k")
    pairs = N.pair_edges(frame, crowded).count()
    roots = components.roots(N.link_edges(frame, str(tmp_path / "l")), str(tmp_path / "c"))
    assert pairs < 64 * 36 * n and roots.select("root").distinct().count() == 1
    assert roots.count() == n - 1


def test_components_of_a_long_path(spark, tmp_path):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    edges = edges.unionByName(edges).unionByName(
        spark.createDataFrame([(500, 501), (501, 500), (700, 700)], "u bigint, v bigint"))
    found = {r["node"]: r["root"] for r in components.roots(edges, str(tmp_path)).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, 501: 500}
