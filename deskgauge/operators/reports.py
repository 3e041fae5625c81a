"""Result shapes: row list, indicators, tables with a header, chart data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deskgauge.functions import text as X
from deskgauge.functions import time as XT
from deskgauge.operators.columns import require_columns

TOP_ROWS = 25
CHART_ROWS = 24
MAX_BINS = 50

# Ticket column -> row list column, in output order.
ROW_COLUMNS = {
    "AP_SD_RFC_NUMBER": "SPOT",
    "AP_SD_STATUS_FR": "Statut",
    "AP_SD_RECIPIENT_LAST_NAME": "Beneficiaire",
    "AP_SD_RECIPIENT_LOCATION_RH": "Location",
    "AP_SD_URGENCY": "Priorite",
    "AP_SD_CI_NAME": "CI",
    "AP_SD_COMMENT": "Description",
    "C_RDV_DATE": "C_RDV_DATE",
    "C_RDV_STATE": "C_RDV_STATE",
    "AP_AM_DONE_BY_OPERATOR_NAME": "AP_AM_DONE_BY_OPERATOR_NAME",
    "C_POINTS": "Score",
    "C_POINTS_JUSTIFICATION": "C_POINTS_JUSTIFICATION",
    "AP_INTERVENTION_TYPE": "AP_INTERVENTION_TYPE",
    "AP_TYPE_FR": "Inter_Type",
    "C_TICKET_TYPE": "C_TICKET_TYPE",
    "C_TICKET_TYPE_STRING_FR": "C_TICKET_TYPE_STRING_FR",
    "AP_SD_REQUEST_ID": "AP_SD_REQUEST_ID",
}

# Table column -> header label, in output order.
MAIL_TABLE = {
    "AP_SD_RFC_NUMBER": "Ticket",
    "AP_TYPE_FR": "Type",
    "AP_SD_RECIPIENT_LOCATION_RH": "Location",
    "AP_AM_DONE_BY_OPERATOR_NAME": "Technician",
}
EXPIRATION_TABLE = MAIL_TABLE | {"AP_SD_MAX_RESOLUTION_DATE": "SLA"}
TECHNICIAN_TABLE = {"tech_name": "Technicien", "total_tickets": "Total", "score": "Score"}


def format_rows(tickets: DataFrame) -> DataFrame:
    """The 17 output columns of a ticket row."""
    values = {name: F.col(name) for name in ROW_COLUMNS}
    values["AP_SD_RECIPIENT_LOCATION_RH"] = X.display_location(
        values["AP_SD_RECIPIENT_LOCATION_RH"]
    )
    values["C_RDV_DATE"] = XT.calendar_millis_text(values["C_RDV_DATE"])
    values["AP_SD_REQUEST_ID"] = X.shown(values["AP_SD_REQUEST_ID"])
    return tickets.select(*[
        values[name].alias(output) for name, output in ROW_COLUMNS.items()
    ])


def with_header(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Select the labelled columns; order and label go to the field metadata."""
    return df.select(*[
        F.col(name).alias(name, metadata={"order": order, "label": label})
        for order, (name, label) in enumerate(labels.items())
    ])


def header(df: DataFrame) -> list[dict]:
    """The table header kept in the schema, in display order."""
    fields = [f for f in df.schema.fields if "label" in f.metadata]
    return [
        {"col_order": f.metadata["order"], "name": f.metadata["label"], "id": f.name}
        for f in sorted(fields, key=lambda f: f.metadata["order"])
    ]


def soonest(tickets: DataFrame, rows: int = TOP_ROWS) -> DataFrame:
    """The tickets whose resolution date comes first.

    Sort and limit are one TakeOrderedAndProject: each task keeps ``rows`` rows.
    """
    return tickets.orderBy(
        F.col("AP_SD_MAX_RESOLUTION_DATE").asc_nulls_last(), "AP_SD_REQUEST_ID"
    ).limit(rows)


def _show_location(tickets: DataFrame) -> DataFrame:
    return tickets.withColumn(
        "AP_SD_RECIPIENT_LOCATION_RH",
        X.display_location(F.col("AP_SD_RECIPIENT_LOCATION_RH")),
    )


def mail_table(tickets: DataFrame, rows: int = TOP_ROWS) -> DataFrame:
    return with_header(_show_location(soonest(tickets, rows)), MAIL_TABLE)


def expiration_table(tickets: DataFrame, rows: int = TOP_ROWS) -> DataFrame:
    """Soonest to expire; the caller filters with ``selectors.is_unexpired``."""
    table = _show_location(soonest(tickets, rows)).withColumn(
        "AP_SD_MAX_RESOLUTION_DATE",
        XT.short_text(XT.local(F.col("AP_SD_MAX_RESOLUTION_DATE"))),
    )
    return with_header(table, EXPIRATION_TABLE)


def technician_totals(tickets: DataFrame) -> DataFrame:
    """Tickets and points per technician, by name."""
    totals = (
        tickets.filter(F.col("AP_AM_DONE_BY_OPERATOR_NAME").isNotNull())
        .groupBy(F.col("AP_AM_DONE_BY_OPERATOR_NAME").alias("tech_name"))
        .agg(F.count("*").alias("total_tickets"), F.sum("C_POINTS").alias("score"))
        .orderBy("tech_name")
    )
    return with_header(totals, TECHNICIAN_TABLE)


def total_score(tickets: DataFrame) -> DataFrame:
    require_columns(tickets, ["C_POINTS"])
    return tickets.agg(F.coalesce(F.sum("C_POINTS"), F.lit(0)).alias("value"))


def row_count(tickets: DataFrame) -> DataFrame:
    return tickets.agg(F.count("*").alias("value"))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("total")).orderBy(
        F.desc("total"), F.asc_nulls_last(column)
    )


def _bin_step(span: Column, max_bins: int) -> Column:
    """Smallest 1, 2 or 5 times a power of ten that needs ``max_bins`` at most."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(span / max_bins)))
    step = F.lit(None).cast("double")
    for factor in (10.0, 5.0, 2.0, 1.0):
        step = F.when(span / (base * factor) <= max_bins, base * factor).otherwise(step)
    return F.when(span > 0, step).otherwise(F.lit(1.0))


def histogram(df: DataFrame, value: Column, max_bins: int = MAX_BINS) -> DataFrame:
    """Rows per bin of ``value``; nulls are left out.

    Rows are first counted per value.  The range, a scalar subquery, and the
    bins both read that count (the range looks at it, so that both need the
    same columns), so Spark computes and shuffles it once.
    """
    counted = (
        df.select(value.cast("double").alias("_value")).filter("_value IS NOT NULL")
        .groupBy("_value").agg(F.count("*").alias("_rows"))
    )
    seen = F.when(F.col("_rows") > 0, F.col("_value"))
    span = counted.agg((F.max(seen) - F.min(seen)).alias("span"))
    step = span.select(_bin_step(F.col("span"), max_bins).alias("step")).scalar()
    start = F.floor(F.col("_value") / step) * step
    return (
        counted.select(start.alias("bin_start"), (start + step).alias("bin_end"), "_rows")
        .groupBy("bin_start", "bin_end")
        .agg(F.sum("_rows").alias("total"))
        .orderBy("bin_start")
    )


def first_rows(df: DataFrame, order_by: str, key: str, rows: int = CHART_ROWS) -> DataFrame:
    """The first rows with their number; ``key``, a unique column, settles ties.

    The limit comes first, so the unpartitioned window sees ``rows`` rows.
    """
    few = df.orderBy(order_by, key).limit(rows)
    number = F.row_number().over(Window.orderBy(order_by, key)).cast("bigint")
    return few.withColumn("row_number", number)
