"""Join helpers shared by the feature and rule operators.

Joins with data of unknown size carry no broadcast hint.  Spark broadcasts a
side by itself when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise, and
adaptive execution splits the partitions of a hot key, so a lookup table that
outgrows memory changes the plan, not the job.  The one hint, in
:func:`top_ids`, is for the ids of a top-k result, which k bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


class ColumnCollision(ValueError):
    """Two joined frames share a column that is not a key."""


def merge(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
          how: str = "left") -> DataFrame:
    """Equi join of two frames that may share no column name.

    ``right_key`` is unique in ``right``; both key columns are kept.
    """
    shared = set(left.columns) & set(right.columns)
    if shared:
        raise ColumnCollision(f"columns on both sides: {sorted(shared)}")
    return left.join(right, left[left_key] == right[right_key], how)


def actions_of(actions: DataFrame, tickets: DataFrame) -> DataFrame:
    """Actions whose ticket is present."""
    ids = tickets.select("AP_SD_REQUEST_ID")
    return actions.join(
        ids, actions["AP_AM_REQUEST_ID"] == ids["AP_SD_REQUEST_ID"], "left_semi"
    )


def top_ids(top: DataFrame, key: str) -> DataFrame:
    """The ids of a top-k result, to be broadcast.

    ``top`` must come from ``limit``: k bounds what is broadcast.
    """
    return F.broadcast(top.select(F.col(key).alias("_kept")))


def reduce_to(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` that belong to ``top_ids``, found without a shuffle."""
    return df.join(ids, df[key] == ids["_kept"], "left_semi")


def unclassified(tickets: DataFrame, classification: DataFrame) -> DataFrame:
    """Tickets without a classification row."""
    known = classification.select("AP_REQUEST_ID")
    return tickets.join(
        known, tickets["AP_SD_REQUEST_ID"] == known["AP_REQUEST_ID"], "left_anti"
    )
