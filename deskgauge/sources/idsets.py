"""Sets of ids as bitmaps, by which a big table is filtered where it is read.

A join with more ids than can be broadcast shuffles every whole row of the big side.
As one bit each the ids are few bytes, are sent to the executors, and only rows that
pass are shuffled.  Ids are whole numbers; 32,768 consecutive ones share a bitmap of
4 KB, so ids that lie far apart take more room: see :func:`can_be_sent`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

# 128 MB: a billion consecutive ids.
MOST_BITMAPS = 32_768

_HELD = ("(shiftright(CAST(conv(hex(substring(_bits, CAST({bit} DIV 8 AS INT) + 1, 1)), 16, 10) AS INT), "
         "CAST({bit} % 8 AS INT)) & 1) = 1")


def bitmaps(ids: DataFrame, key: str) -> DataFrame:
    """The ids that are not null, one row per bitmap.

    The ids, not partial bitmaps, are shuffled: each task might have one for every part
    of the range.
    """
    at = F.col(key).cast("bigint")
    return ids.filter(at.isNotNull()).select(
        F.bitmap_bucket_number(at).alias("_part"), F.bitmap_bit_position(at).alias("_bit")
    ).repartition("_part").groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def whole_numbers(table: DataFrame, key: str) -> bool:
    return isinstance(table.select(key).schema[0].dataType, IntegralType)


def can_be_sent(bits: DataFrame) -> bool:
    """Whether the bitmaps are few enough for every executor to hold them."""
    return bits.count() <= MOST_BITMAPS


def _tested(table: DataFrame, key: str, bits: DataFrame) -> tuple[DataFrame, Column]:
    """The table beside its bitmaps, and whether the key is in them; never null."""
    at = f"CAST(`{key}` AS BIGINT)"
    part = F.bitmap_bucket_number(F.col(key).cast("bigint"))
    beside = table.join(F.broadcast(bits), part == F.col("_part"), "left")
    held = F.expr(_HELD.format(bit=f"bitmap_bit_position({at})"))
    return beside, F.coalesce(held, F.lit(False))


def possible(table: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """Rows whose key is in the set, and those without a key."""
    beside, held = _tested(table, key, bits)
    return beside.filter(F.col(key).isNull() | held).select(*table.columns)


def without(table: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """Rows whose key is not in the set, those without a key included."""
    beside, held = _tested(table, key, bits)
    return beside.filter(~held).select(*table.columns)
