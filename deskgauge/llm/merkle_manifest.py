"""Merkle manifest of a dataset: one tree per group, one over the groups' roots.

A row's leaf is the SHA-256 of its named columns, each with its length, so that a null,
an empty text and shifted borders all differ.  Rows of a group stand in the order of
their doc_id.  Their places come from bitmaps, not from sorting them: the ids of a
group are a compressed bitmap - its non-zero 64-bit words by number, merged by OR as
partial aggregates - and popcounts are summed in a directory of 1,024 nodes a level.  A
row's place is the sum before its word and the popcount below its bit.  Only ids that
repeat are told apart by their leaves, in range-sorted partitions.

The tree is reduced 256 slots at a time: nodes meet by (group, place / 256) in a slot
array, a task reduces it by up to eight levels, and the roots are the nodes of the next
stage.  Proofs go back down the same arrays, so no task holds more than one array of a
group, however large that is.  Two neighbours become the hash of their hex digests, a
last one alone the hash of itself, until one node remains.

Cases: null ids come first in their group, like ids that repeat in the order of their
leaves; equal rows have leaves of their own; a null group is a group, before all others,
which follow bytewise; any 64-bit id, also negative; an empty text is not a null; texts
of any length are hashed in the JVM, once; a group of one row has its leaf as root; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from deskgauge.llm import common

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_WORD_BITS = 6
_DIRECTORY_BITS = 10
_SLOT_BITS = 8
_ROW = ["grp", "known", "id"]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(values: list[Column]) -> Column:
    """Hash of the values: ``-`` for null, else bytes, a colon, the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[
        F.when(t.isNull(), F.lit("-"))
        .otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts
    ]), 256)


def _group(lang: str) -> Column:
    """A key without nulls in the groups' order: null, then bytewise."""
    return F.when(F.col(lang).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(lang)))


def _leaves(docs: DataFrame, columns: tuple[str, ...], group: str,
            claims: dict[str, Column]) -> DataFrame:
    """Narrow rows: key, leaf, and the leaf of the claimed row where that is another."""
    docs = docs.select(*columns)
    claimed = _leaf([claims.get(c, F.col(c)) for c in columns]) if claims else F.lit(None)
    differs = F.lit(False)
    for name, value in claims.items():
        differs |= ~value.cast("string").eqNullSafe(F.col(name).cast("string"))
    return docs.select(
        _group(group).alias("grp"), F.col("doc_id").isNotNull().alias("known"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"),
        _leaf([F.col(c) for c in columns]).alias("leaf"),
        F.when(differs, claimed).alias("claimed"),
    )


# ------------------------------------------------------------------ bitmaps and ranks

def _bit(column: str = "id") -> Column:
    return F.col(column).bitwiseAND(F.lit(63)).cast("int")


def _word() -> Column:
    return F.shiftright("id", _WORD_BITS)


def bitmap_words(rows: DataFrame) -> DataFrame:
    """The ids of a group as words of a bitmap, with the number of rows behind each."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit())
    return rows.filter("known").groupBy("grp", _word().alias("word")).agg(
        F.bit_or(one).alias("bits"), F.count("*").alias("n"))


def directory(words: DataFrame) -> DataFrame:
    """``words`` with ``before``: rows of the group in all words of a smaller number.

    The levels above hold 1,024 nodes of the level below in one; sums run inside one
    parent, so no window holds more rows than that.
    """
    least, most = words.agg(F.min("word"), F.max("word")).first()
    levels = 0
    while least is not None and (most >> _DIRECTORY_BITS * levels) - (
            least >> _DIRECTORY_BITS * levels) >= 1 << _DIRECTORY_BITS:
        levels += 1

    def sums(nodes: DataFrame, depth: int) -> DataFrame:
        parent = F.shiftright("word", _DIRECTORY_BITS)
        if depth == 0:
            order = Window.partitionBy("grp").orderBy("word")
            return nodes.withColumn("before", _preceding("n", order))
        upper = nodes.groupBy("grp", parent.alias("word")).agg(F.sum("n").alias("n"))
        upper = sums(upper, depth - 1).select(
            "grp", F.col("word").alias("parent"), F.col("before").alias("above"))
        order = Window.partitionBy("grp", "parent").orderBy("word")
        inside = nodes.withColumn("parent", parent).withColumn("before", _preceding("n", order))
        return inside.join(upper, ["grp", "parent"]).withColumn(
            "before", F.col("before") + F.col("above")).drop("parent", "above")

    return sums(words, levels)


def _preceding(name: str, order) -> Column:
    frame = order.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(frame), F.lit(0))


def _copy_numbers(rows: DataFrame, keys: list[str], order: list[str], folder: str,
                  name: str) -> DataFrame:
    """``rows`` with ``copy``: their number, from 0, among rows of equal ``keys``.

    Sorted by ranges, with a drawn number to part rows that are equal in all of
    ``order``; the parts of one key, one per partition at most, add up.
    """
    by = [*keys, *order, "draw"]
    placed = common.stored(
        rows.withColumn("draw", F.rand(12)).repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumn("at", F.monotonically_increasing_id()).drop("draw"), folder, name)
    placed = placed.withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy(*keys, "part").agg(F.min("at").alias("start"), F.count("*").alias("m"))
    parts = parts.withColumn("earlier", _preceding("m", Window.partitionBy(*keys).orderBy("part")))
    return placed.join(parts, [*keys, "part"]).withColumn(
        "copy", F.col("at") - F.col("start") + F.col("earlier")
    ).drop("part", "at", "start", "m", "earlier")


def _ranked(rows: DataFrame, sizes: DataFrame, folder: str) -> DataFrame:
    """``rows`` with ``place``, their number from 0 in their group."""
    words = common.stored(bitmap_words(rows), folder, "words")
    crowded = words.filter(F.col("n") > F.bit_count("bits")).select("grp", "word")
    repeated = common.stored(
        rows.filter("known").withColumn("word", _word())
        .join(crowded, ["grp", "word"], "left_semi")
        .groupBy(*_ROW).agg(F.count("*").alias("n")).filter("n > 1"), folder, "repeated")
    # What ids that repeat add to the popcount: 64 entries a word at most.
    more = repeated.groupBy("grp", _word().alias("word")).agg(
        F.collect_list(F.struct(_bit().alias("bit"), (F.col("n") - 1).alias("n"))).alias("more"))
    ranks = directory(words).join(more, ["grp", "word"], "left").drop("n")

    many = rows.join(repeated.drop("n"), _ROW, "left_semi").unionByName(rows.filter("NOT known"))
    single = rows.filter("known").join(repeated, _ROW, "left_anti")
    placed = single.withColumn("copy", F.lit(0).cast("bigint")).unionByName(
        _copy_numbers(many, _ROW, ["leaf"], folder, "copies"))

    below = F.col("bits").bitwiseAND(
        F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), _bit())))
    extra = F.aggregate(
        F.coalesce("more", F.array().cast("array<struct<bit:int,n:bigint>>")),
        F.lit(0).cast("bigint"),
        lambda sum_, e: sum_ + F.when(e["bit"] < _bit(), e["n"]).otherwise(F.lit(0)))
    rank = F.col("before") + F.bit_count(below) + extra + F.col("n_unknown")
    return (
        placed.withColumn("word", F.when(F.col("known"), _word()))
        .join(ranks, ["grp", "word"], "left").join(sizes.select("grp", "n_unknown"), "grp")
        .select("grp", "known", "id", "leaf", "claimed",
                (F.when(F.col("known"), rank).otherwise(F.lit(0)) + F.col("copy")).alias("place"))
    )


# ------------------------------------------------------------------------------ trees

def depth(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    return max(0, (n - 1).bit_length())


def _levels(slots: list[str], count: int) -> list[list[str]]:
    """The nodes of an array, level by level."""
    out = [slots]
    for _ in range(count):
        nodes = out[-1]
        out.append([digest(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)])
    return out


def _own_levels(n: int, stage: int) -> int:
    return min(_SLOT_BITS, max(0, depth(n) - _SLOT_BITS * stage))


def siblings(levels: list[list[str]], slot: int) -> list[str]:
    """What a slot meets on its way up through ``levels``, the last of which is a root."""
    found = []
    for nodes in levels[:-1]:
        if slot ^ 1 < len(nodes):
            found.append(nodes[slot ^ 1])
        slot >>= 1
    return found


def fold(leaf: str, path: Iterator[str], place: int, n: int) -> str:
    """The root over a leaf at ``place`` of ``n``, from its siblings in order."""
    while n > 1:
        if place % 2:
            leaf = digest(next(path), leaf)
        elif place + 1 < n:
            leaf = digest(leaf, next(path))
        else:
            leaf = digest(leaf)
        place, n = place // 2, (n + 1) // 2
    return leaf


def _blocks(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Slot arrays: 256 nodes of a group that stand side by side, keyed by their block."""
    slot = F.col("place").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1)).cast("int").alias("slot")
    return nodes.groupBy("grp", F.shiftright("place", _SLOT_BITS).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct(slot, *columns))).alias("slots"))


def _mapped(frame: DataFrame, schema: str, rows: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """``rows`` of every row of the frame, a batch of Arrow at a time."""
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(),
             "array<string>": pa.list_(pa.string())}
    types = [kinds[field.split()[1]] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):  # 16 arrays: 4,096 proofs at most
                out = [r for block in batch.slice(at, 16).to_pylist() for r in rows(block)]
                columns = zip(*out) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(columns, types)], names)

    return frame.mapInArrow(run, schema)


@dataclass(frozen=True)
class _Tree:
    """Stored slot arrays of every stage, the lowest first, and the roots above them."""

    stages: list[DataFrame]
    roots: DataFrame  # grp, leaf

    def paths(self, above: DataFrame, downto: int) -> DataFrame:
        """grp, block, above: the siblings over each block of stage ``downto``."""
        found = above
        for stage in range(len(self.stages) - 1, downto, -1):
            def below(block, stage=stage):
                levels = _levels([s["leaf"] for s in block["slots"]],
                                 _own_levels(block["n"], stage))
                for slot in range(len(block["slots"])):
                    yield (block["grp"], (block["block"] << _SLOT_BITS) + slot,
                           siblings(levels, slot) + block["above"])

            found = _mapped(self.stages[stage].join(found, ["grp", "block"]),
                            "grp string, block bigint, above array<string>", below)
        return found


def _tree(nodes: DataFrame, sizes: DataFrame, most: int, columns: list[str],
          folder: str, name: str) -> _Tree:
    """Stages over nodes (grp, place, leaf, ...) of groups with ``sizes`` (grp, n)."""
    stages = []
    for stage in range(max(1, -(-depth(most) // _SLOT_BITS))):
        def root(block, stage=stage):
            levels = _levels([s["leaf"] for s in block["slots"]], _own_levels(block["n"], stage))
            yield block["grp"], block["block"], levels[-1][0]

        blocks = _blocks(nodes, columns if stage == 0 else ["leaf"]).join(sizes, "grp")
        stages.append(common.stored(blocks, folder, f"{name}{stage}"))
        nodes = _mapped(stages[-1], "grp string, place bigint, leaf string", root)
    return _Tree(stages, nodes.select("grp", "leaf"))


@dataclass(frozen=True)
class Manifest:
    """The trees of a table; ``groups``: grp, n, rank, subroot."""

    rows: _Tree
    top: _Tree
    groups: DataFrame
    count: int
    root: str | None

    def _proved(self) -> DataFrame:
        """Slot arrays of leaves with the siblings above each array."""
        one = F.lit("").alias("grp")
        top = self.top.stages[-1].sparkSession.range(1).select(
            one, F.lit(0).cast("bigint").alias("block"),
            F.array().cast("array<string>").alias("above"))

        def ranks(block):
            levels = _levels([s["leaf"] for s in block["slots"]], _own_levels(block["n"], 0))
            for slot in range(len(block["slots"])):
                yield ((block["block"] << _SLOT_BITS) + slot,
                       siblings(levels, slot) + block["above"])

        lowest = self.top.stages[0].join(self.top.paths(top, 0), ["grp", "block"])
        over = _mapped(lowest, "rank bigint, above array<string>", ranks)
        over = over.join(self.groups, "rank").select(
            "grp", F.lit(0).cast("bigint").alias("block"), "above")
        return (
            self.rows.stages[0].join(self.rows.paths(over, 0), ["grp", "block"])
            .join(self.groups.drop("n"), "grp")
        )

    def proofs(self) -> DataFrame:
        """Per row its leaf, its place in its group, and all its siblings upwards."""
        def rows(block):
            for doc_id, place, leaf, _, path in _members(block):
                yield doc_id, block["grp"][1:] if block["grp"] != "0" else None, place, leaf, path

        return _mapped(self._proved(), "doc_id bigint, grp string, place bigint, leaf string, "
                                       "path array<string>", rows)

    def verified(self) -> DataFrame:
        """Per row its proof's digest and the root that its claimed row leads to."""
        count, root = self.count, self.root

        def rows(block):
            for doc_id, place, leaf, claimed, path in _members(block):
                way = iter(path)
                folded = fold(claimed or leaf, way, place, block["n"])
                folded = fold(folded, way, block["rank"], count)
                yield (doc_id, leaf, block["subroot"], root, digest(*path), folded,
                       folded == root)

        return _mapped(self._proved(), "doc_id bigint, leaf string, subroot string, root string, "
                                       "proof_sha256 string, folded_root string, "
                                       "verified boolean", rows)


def _members(block: dict) -> Iterator[tuple]:
    slots = block["slots"]
    levels = _levels([s["leaf"] for s in slots], _own_levels(block["n"], 0))
    for at, slot in enumerate(slots):
        yield (slot["id"] if slot["known"] else None, (block["block"] << _SLOT_BITS) + at,
               slot["leaf"], slot["claimed"], siblings(levels, at) + block["above"])


def build(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang",
          claims: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table; ``claims`` are columns of a copy to verify against it."""
    folder = common.scratch(docs.sparkSession)
    leaves = common.stored(_leaves(docs, columns, group, claims or {}), folder, "leaves")
    sizes = common.stored(leaves.groupBy("grp").agg(
        F.count("*").alias("n"), F.count_if(~F.col("known")).alias("n_unknown")), folder, "sizes")
    most, count = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    rows = _tree(_ranked(leaves, sizes, folder), sizes.select("grp", "n"), most,
                 ["known", "id", "leaf", "claimed"], folder, "rows")

    subroots = common.stored(rows.roots.select("grp", F.col("leaf").alias("subroot")),
                             folder, "subroots")
    everything = subroots.withColumn("all", F.lit(""))
    ranked = _copy_numbers(everything, ["all"], ["grp"], folder, "ranks").select(
        "grp", "subroot", F.col("copy").alias("rank"))
    groups = common.stored(ranked.join(sizes.select("grp", "n"), "grp"), folder, "groups")
    nodes = groups.select(F.lit("").alias("grp"), F.col("rank").alias("place"),
                          F.col("subroot").alias("leaf"))
    whole = docs.sparkSession.range(1).select(
        F.lit("").alias("grp"), F.lit(count).cast("bigint").alias("n"))
    top = _tree(nodes, whole, count, ["leaf"], folder, "top")
    root = top.roots.first()
    return Manifest(rows, top, groups, count, root["leaf"] if root else None)


def tampered() -> dict[str, Column]:
    """A copy in which n_chars is one too large where 7 divides the id's crc32."""
    changed = F.col("n_chars").cast("decimal(20,0)") + F.lit(1)
    return {"n_chars": F.when(common.crc_column() % 7 == 0, changed.cast("string"))
            .otherwise(F.col("n_chars").cast("string"))}
