"""Connected components of an edge table, in rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deskgauge.llm import common


def _least_neighbour(edges: DataFrame, of: str, other: str) -> DataFrame:
    """For each node of column ``of``: its least neighbour; a partial aggregate."""
    return edges.groupBy(of).agg(F.min(other).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both, "u", "v").select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them (u > v in all edges)."""
    least = _least_neighbour(edges, "u", "v")
    others = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v")))


def roots(edges: DataFrame, folder: str) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node that
    is not a root itself.

    ``edges`` has columns u and v; loops, repeats and either direction are fine.
    Large-star and small-star rounds alternate until the edges stay the same, a
    few rounds in practice and about log2 of the longest path at most.  Each
    round is a written table; the driver gets a count and a checksum.
    """
    edges = edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = common.stored(edges, folder, "edges0")
    before, turn = _fingerprint(edges), 0
    while before[0]:
        turn += 1
        edges = common.stored(_small_star(_large_star(edges).distinct()).distinct(),
                              folder, f"edges{turn}")
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _fingerprint(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(hashed), F.sum(F.xxhash64("v", "u").cast(
        "decimal(38,0)"))).first())
