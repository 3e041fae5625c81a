"""Multi-party perspective rotation of dialogues, in DataFrame operations alone.

Every speaker of a dialogue in turn becomes the assistant: that speaker's
messages are rendered as the assistant's and count for the loss, all others
become users with their names, and system messages stay as they are.  One row is
one message seen from one side: its rendered segment, its place, where it starts
in the rendered dialogue, and the span of its text and end mark that is learned
(empty for all but the assistant's).  The segments of a side, joined by
position, are its dialogue; no dialogue is ever collected, however long.

Places and starts are prefix sums in three steps - within groups of messages of
one turn, role and text hash, over those groups within 64 turns, and over the
spans of 64 turns - so a dialogue of any length is spread over many tasks, and
each step hands on one row per group.  Places are found without the texts, which
are written once with a number and joined to their places last.

Cases: messages go by turn (null last), role (null last), XXH64 and MD5 of the
text; equal rows are one message, ``copies`` says how many; a null text is
empty; a null role is a user named "unknown" and no side of its own; rows
without a conv_id form one dialogue; a dialogue without speakers has no rows; an
empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deskgauge.llm import common

SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>"
SPAN = 64

_GROUP = ["conv_id", "side", "span", "turn", "role", "bucket"]
_SPAN = ["conv_id", "side", "span"]


def _before(name: str, window) -> Column:
    rows = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(rows), F.lit(0))


def _nulls_last(*names: str) -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in names]


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join whose null keys are equal."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(renamed, match).drop(*[f"_{k}" for k in keys])


def messages(conversations: DataFrame) -> DataFrame:
    """Distinct messages with their number of copies."""
    return conversations.groupBy(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).agg(F.count("*").alias("copies"))


def sides(conversations: DataFrame, system: str = SYSTEM) -> DataFrame:
    """One row per dialogue and speaker."""
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("role").cast("string").alias("side"),
    ).filter(F.col("side") != system).distinct()


def _learned() -> Column:
    return F.coalesce(F.col("role") == F.col("side"), F.lit(False))


def _as_role(system: str) -> Column:
    """What the speaker is, seen from the side."""
    return F.when(_learned(), "assistant").when(F.col("role") == system, "system").otherwise("user")


def _name(system: str) -> Column:
    return F.when(_as_role(system) == "user", F.coalesce("role", F.lit("unknown")))


def _head(system: str) -> Column:
    name = F.coalesce(F.concat(F.lit(" name="), _name(system)), F.lit(""))
    return F.concat(F.lit(START), _as_role(system), name, F.lit("\n"))


def _stored_messages(conversations: DataFrame) -> DataFrame:
    """The messages as a written table, numbered; their texts are not needed for places."""
    told = messages(conversations).withColumns({
        "message": F.monotonically_increasing_id(),
        "length": F.char_length("text"),
        "hash": F.xxhash64("text"),
        "digest": F.md5(F.col("text").cast("binary")),
    })
    return common.stored(told, common.scratch(conversations.sparkSession), "messages")


def _views(told: DataFrame, system: str) -> DataFrame:
    """Every message from every side with the length it will have, without its text."""
    seen = _joined(told.drop("text", "copies"), sides(told, system), ["conv_id"])
    length = F.char_length(_head(system)) + F.col("length") + len(END) + 1
    return seen.select(
        "conv_id", "side", "turn", "role", "message", "hash", "digest",
        F.floor(F.col("turn") / SPAN).alias("span"), F.shiftright("hash", 56).alias("bucket"),
        length.cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("one"),
    )


def rotate(conversations: DataFrame, system: str = SYSTEM) -> DataFrame:
    """One row per dialogue, side and message."""
    told = _stored_messages(conversations)
    views = _views(told, system)
    sums = [F.sum("size").alias("size"), F.sum("one").alias("one")]
    groups = views.groupBy(*_GROUP).agg(*sums)
    spans = groups.groupBy(*_SPAN).agg(*sums)

    in_span = Window.partitionBy(*_SPAN).orderBy(*_nulls_last("turn", "role"), "bucket")
    in_side = Window.partitionBy("conv_id", "side").orderBy(*_nulls_last("span"))
    in_group = Window.partitionBy(*_GROUP).orderBy("hash", "digest")
    span_starts = spans.select(*_SPAN, _before("size", in_side).alias("span_start"),
                               _before("one", in_side).alias("span_position"))
    group_starts = groups.select(*_GROUP, _before("size", in_span).alias("group_start"),
                                 _before("one", in_span).alias("group_position"))
    starts = _joined(group_starts, span_starts, _SPAN)
    places = _joined(
        views.withColumns({"own_start": _before("size", in_group),
                           "own_position": _before("one", in_group)}),
        starts, _GROUP).drop("hash", "digest")
    placed = places.join(told.select("message", "text", "copies"), "message")

    start = F.col("span_start") + F.col("group_start") + F.col("own_start")
    content = start + F.char_length(_head(system))
    end = start + F.col("size") - 1
    return placed.select(
        "conv_id", "side",
        (F.col("span_position") + F.col("group_position") + F.col("own_position")).alias("position"),
        "turn", _as_role(system).alias("role"), _name(system).alias("name"),
        F.concat(_head(system), F.col("text"), F.lit(END + "\n")).alias("segment"), "copies",
        start.alias("start"), _learned().alias("learned"),
        F.when(_learned(), content).otherwise(start).alias("mask_start"),
        F.when(_learned(), end).otherwise(start).alias("mask_end"),
    )
