"""Where frames come from: delimited files, parquet, JDBC, in-memory records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from deskgauge.schemas import with_text_dates

DELIMITER = ";"


def read_delimited(spark: SparkSession, path: str, schema: T.StructType,
                   *, multi_line: bool) -> DataFrame:
    """Delimited export with a header; dates stay text until cleaning.

    ``multi_line`` is the caller's choice: comments that span lines need it, but
    then one task reads a whole file, so a large table must come as many files.
    Without it Spark splits the files.
    """
    return spark.read.csv(
        path, schema=with_text_dates(schema), sep=DELIMITER, header=True,
        multiLine=multi_line, quote='"', escape='"',
    )


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str,
              lower: int, upper: int, partitions: int,
              properties: dict[str, str] | None = None) -> DataFrame:
    """A relational table, read in ``partitions`` key ranges in parallel.

    Filters and column lists on the result are pushed into the database.
    """
    return spark.read.jdbc(
        url, table, column=key, lowerBound=lower, upperBound=upper,
        numPartitions=partitions, properties=properties or {},
    )


def from_records(spark: SparkSession, records: Sequence[dict],
                 schema: T.StructType) -> DataFrame:
    """Records held by the caller; dates as text, absent keys as null."""
    rows = [tuple(record.get(name) for name in schema.names) for record in records]
    return spark.createDataFrame(rows, with_text_dates(schema))
