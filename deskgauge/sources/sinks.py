"""Where results go: row lists, tables and events as JSON lines or parquet."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from deskgauge.operators import events as E
from deskgauge.operators import reports


def write_rows(rows: DataFrame, path: str) -> None:
    """Row list as JSON lines, one file per partition; nulls are written."""
    rows.write.option("ignoreNullFields", "false").json(path)


def write_events(events: DataFrame, path: str) -> None:
    """Calendar events as one JSON text per line."""
    E.as_json(events).write.text(path)


def write_table(table: DataFrame, path: str) -> None:
    """A table of any length: its rows, and beside them one line with its header."""
    write_rows(table, f"{path}/rows")
    header = json.dumps(reports.header(table), ensure_ascii=False)
    line = table.sparkSession.range(1, numPartitions=1).select(F.lit(header).alias("value"))
    line.write.text(f"{path}/header")


class TooManyRows(ValueError):
    """A table is too long to be one text on the driver."""


def table_json(table: DataFrame, rows: int = 1000) -> str:
    """A table of at most ``rows`` rows with its header as one JSON text.

    A longer one is refused, before more than ``rows`` + 1 rows reach the
    driver; it goes to :func:`write_table`.
    """
    lines = table.limit(rows + 1).toJSON().collect()
    if len(lines) > rows:
        raise TooManyRows(f"more than {rows} rows")
    data = [json.loads(line) for line in lines]
    return json.dumps({"columns": reports.header(table), "data": data}, ensure_ascii=False)
