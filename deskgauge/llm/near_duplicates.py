"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint is 64 bits over the 3-word shingles of a text: ASCII capitals are
lowered, words are runs of anything but ASCII white space, shingles repeat as
they occur, and a bit is set if it is set in over half of the shingles' XXH64
(seed 42).  Two fingerprints link if they differ in 3 bits or fewer.

Candidates.  The 64 bits are a ring of four segments.  If all four differ in 3
bits together, there is a segment from which the first l segments of the ring
differ in at most l * 3/4 bits together, for each l: 0, then 1, 2 and 3.  So for
some start the first segment is equal and the second differs in one bit at most;
a key is the start with both segments.  Every fingerprint is filed under its
four keys; if the second segment has even parity it also asks for the sixteen
keys one bit away, which pairs each even segment with its odd neighbours once.
The budgets of 2 and 3 then cut the candidates before the full Hamming check.

Only distinct fingerprints are joined, so exact copies cost nothing.  A key that
holds over ``CROWD`` fingerprints is not paired: whatever touches such a key goes
the other exact way.  There every fingerprint is an anchor of the 65 points
within one bit of it, and one of odd parity also reaches the 2016 points two
bits away.  Anchors of a point differ in 2 bits at most, and an anchor and a
reaching one in 3; every pair within 3 bits meets at some point in one of these
ways.  So linking all at a point to its least anchor is right and whole, and the
work grows with the number of fingerprints, not with its square.

Cases: null and empty texts have fingerprint zero and are linked like any other;
a text of one or two words is one shingle; repeated rows each get their row; a
component whose rows all lack a doc_id has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from deskgauge.llm import common, components

BITS = 3
SEGMENTS = 4
WIDTH = 16
CROWD = 64
_BLOCK = 1 << 16


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = ([b" ".join(words)] if len(words) < 3 else
                map(b" ".join, zip(words, words[1:], words[2:])))
    count = max(1, len(words) - 2)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), ">u8", count)
    set_in = np.zeros(64, np.int64)
    for start in range(0, count, _BLOCK):
        block = hashes[start:start + _BLOCK].view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > count).tobytes(), "big")


def _hashed(texts: Iterator[bytes]) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _hashed(common.utf8(batch.column(1)))], ["doc_id", "fp"])

    return common.documents(docs).mapInArrow(run, "doc_id bigint, fp bigint")


def _segment(fp: str, index: int) -> Column:
    shifted = F.shiftrightunsigned(F.col(fp), WIDTH * (index % SEGMENTS))
    return shifted.bitwiseAND(F.lit((1 << WIDTH) - 1))


def _key(start: int, first: Column, second: Column) -> Column:
    packed = F.shiftleft(first, WIDTH).bitwiseOR(second)
    return packed.bitwiseOR(F.lit(start << (2 * WIDTH)))


def _own_keys(fps: DataFrame) -> DataFrame:
    keys = [_key(i, _segment("fp", i), _segment("fp", i + 1)) for i in range(SEGMENTS)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _asked_keys(fps: DataFrame) -> DataFrame:
    """Own keys (``own``) and, from even second segments, the keys one bit away."""
    own = _own_keys(fps).withColumn("own", F.lit(True))
    even = F.bit_count(F.col("key").bitwiseAND(F.lit((1 << WIDTH) - 1))) % 2 == 0
    flips = F.array(*[F.lit(1 << b).cast("bigint") for b in range(WIDTH)])
    near = own.filter(even).select("fp", "key", F.explode(flips).alias("flip")).select(
        "fp", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), F.lit(False).alias("own"))
    return own.unionByName(near)


def _differences(segments: list[Column]) -> Column:
    total = segments[0]
    for more in segments[1:]:
        total = total + more
    return total


def _chain_holds() -> Column:
    """For the start of the key: 2 bits in three segments and 3 in four at most."""
    apart = F.col("fp").bitwiseXOR(F.col("other"))
    start = F.shiftright("key", 2 * WIDTH)
    count = lambda i: F.bit_count(F.shiftrightunsigned(apart, WIDTH * (i % SEGMENTS))
                                  .bitwiseAND(F.lit((1 << WIDTH) - 1)))
    holds = F.lit(False)
    for i in range(SEGMENTS):
        chain = F.lit(True)
        for length in range(1, SEGMENTS + 1):
            chain = chain & (_differences([count(i + k) for k in range(length)])
                             <= F.lit(length * BITS // SEGMENTS))
        holds = holds | ((start == i) & chain)
    return holds


def crowded_keys(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    return _own_keys(fps).groupBy("key").count().filter(F.col("count") > crowd).select("key")


def pair_edges(fps: DataFrame, crowded: DataFrame) -> DataFrame:
    """Linked pairs that meet at a key which is not crowded."""
    filed = _own_keys(fps).join(crowded, "key", "left_anti").withColumnRenamed("fp", "other")
    met = _asked_keys(fps).join(filed.hint("shuffle_hash"), "key")
    once = ~F.col("own") | (F.col("fp") < F.col("other"))
    return (
        met.filter(once & _chain_holds())
        .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= BITS)
        .select(F.col("fp").alias("u"), F.col("other").alias("v"))
    )


def point_edges(crowd: DataFrame) -> DataFrame:
    """Links of all fingerprints of a crowd with others of it, as stars at points."""
    ones = [1 << b for b in range(63)] + [-(1 << 63)]
    twos = [a ^ b for i, a in enumerate(ones) for b in ones[i + 1:]]
    array = lambda masks: F.lit(masks).cast("array<bigint>")
    point = F.col("fp").bitwiseXOR(F.col("mask")).alias("point")
    anchors = crowd.select("fp", F.explode(array([0, *ones])).alias("mask")).select("fp", point)
    reach = (crowd.filter(F.bit_count("fp") % 2 == 1)
             .select("fp", F.explode(array(twos)).alias("mask")).select("fp", point))
    least = anchors.groupBy("point").agg(F.min("fp").alias("least"))
    return (anchors.unionByName(reach).join(least.hint("shuffle_hash"), "point")
            .filter(F.col("fp") != F.col("least"))
            .select(F.col("fp").alias("u"), F.col("least").alias("v")))


def link_edges(fps: DataFrame, folder: str, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs within 3 bits."""
    crowded = common.stored(crowded_keys(fps, crowd), folder, "crowded")
    edges = pair_edges(fps, crowded)
    if crowded.limit(1).count():
        members = _asked_keys(fps).join(crowded, "key", "left_semi").select("fp").distinct()
        members = common.stored(members, folder, "crowd")
        edges = edges.unionByName(point_edges(members))
    return edges


def component_ids(rows: DataFrame, folder: str, crowd: int = CROWD) -> DataFrame:
    """``fp`` and ``component_id`` from stored rows of ``doc_id`` and ``fp``."""
    fps = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), folder, "fps")
    roots = components.roots(link_edges(fps.select("fp"), folder, crowd), folder)
    rooted = (fps.join(roots, fps["fp"] == roots["node"], "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` of every row."""
    folder = common.scratch(docs.sparkSession)
    rows = common.stored(fingerprints(docs), folder, "rows")
    ids = common.stored(component_ids(rows, folder, crowd), folder, "ids")
    return rows.join(ids, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row of every component, all columns: the least doc_id, then the first row.

    Rows without a doc_id come last.  The rows are numbered in a written table,
    so that the choice holds however often a task runs; the rows that go are
    joined away by number.
    """
    folder = common.scratch(docs.sparkSession)
    row, fp = (f"{name}_{folder[-12:]}" for name in ("row", "fp"))
    at_text = docs.columns.index("text")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    schema = T.StructType([*numbered.schema.fields, T.StructField(fp, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _hashed(common.utf8(batch.column(at_text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes], [*batch.schema.names, fp])

    numbered = common.stored(numbered.mapInArrow(run, schema), folder, "docs")
    rows = numbered.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                           F.col(fp).alias("fp"), F.col(row).alias("row"))
    fps = common.stored(
        rows.groupBy("fp").agg(F.min(_rank()).alias("first"), F.min("doc_id").alias("least")),
        folder, "firsts")
    roots = components.roots(link_edges(fps.select("fp"), folder, crowd), folder)
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "first", F.coalesce("root", "fp").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row, fp)


def _rank() -> Column:
    """Orders rows: by doc_id, rows without one last, then by number."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
