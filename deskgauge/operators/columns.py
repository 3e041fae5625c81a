"""Column expectations that operators check while the plan is built."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


class MissingColumns(ValueError):
    """A frame lacks columns an operator needs."""


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The frame itself; raises while the plan is built when columns lack."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise MissingColumns(f"missing columns: {missing}")
    return df
