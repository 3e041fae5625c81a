"""Data-quality expectations: each lists its violations as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deskgauge import constants as K
from deskgauge.functions import time as XT
from deskgauge.functions import text as X
from deskgauge.operators import features
from deskgauge.operators.columns import MissingColumns, require_columns  # noqa: F401


def tickets_without_action(tickets: DataFrame, actions: DataFrame,
                           eligible: Column | None = None) -> DataFrame:
    """Tickets that have no (eligible) action."""
    if eligible is not None:
        actions = actions.filter(eligible)
    ids = actions.select(features.ACTION_TICKET_ID).distinct()
    return tickets.join(
        ids, tickets[features.TICKET_ID] == ids[features.ACTION_TICKET_ID], "left_anti"
    )


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")


def repeated_answers(answers: DataFrame) -> DataFrame:
    return duplicates(answers, "REQUEST_ID", "QUESTION_ID")


def unparsed(df: DataFrame, text: Column, parsed: Column) -> DataFrame:
    """Count of present texts that gave no date."""
    bad = F.when(text.isNotNull() & parsed.isNull(), 1)
    return df.agg(F.count(bad).alias("unparsed"))


def has_old_action(actions: DataFrame, as_of: Column) -> DataFrame:
    """Whether some action lies a minute or more back, durations being rounded."""
    age = XT.minutes_between(F.col("AP_AM_START_DATE"), as_of)
    return actions.agg(F.coalesce(F.bool_or(age > 0), F.lit(False)).alias("has_old_action"))


# Measures of the actions: texts without a date, and the earliest start as text.
MEASURES = "unparsed bigint, oldest string"


def _measures(note: Column, start: Column, counted: Column) -> list[Column]:
    bad = counted & note.isNotNull() & XT.parse_day(note).isNull()
    return [F.count(F.when(bad, 1)).alias("unparsed"),
            F.min(F.when(counted, start)).cast("string").alias("oldest")]


def extract_measures() -> list[Column]:
    """The measures on extracted actions, of those that cleaning keeps."""
    start, text = F.col("START_DATE_UT"), lambda c: X.blank_to_null(F.col(c))
    kept = (start.isNotNull() | text("DONE_BY_NAME").isNotNull()
            | text("ACTION_LABEL_FR").isNotNull())
    kept &= ~X.member(F.col("REQUEST_ID"), K.REQUEST_IDS_KNOWN_BAD)
    return _measures(X.rdv_date_text(text("DESCRIPTION")), start, kept)


def _measured(actions: DataFrame, known: dict | None) -> DataFrame:
    """One row of measures: those noted with a snapshot, else from one pass."""
    if known is None:
        return actions.agg(*_measures(
            X.rdv_date_text(F.col("AP_AM_DESCRIPTION")), F.col("AP_AM_START_DATE"), F.lit(True)))
    return actions.sparkSession.range(1).select(
        F.lit(known["unparsed"]).cast("bigint").alias("unparsed"),
        F.lit(known["oldest"]).cast("string").alias("oldest"))


def report(tickets: DataFrame, actions: DataFrame, as_of: Column,
           answers: DataFrame | None = None, measured: dict | None = None) -> DataFrame:
    """One row per expectation: its name and the number of violations.

    Some action is old if the earliest is, so one pass over the actions, or none if
    ``measured`` has what a snapshot noted, gives what is asked of single actions.
    """
    age = XT.minutes_between(F.col("oldest").cast("timestamp_ntz"), as_of)
    single = F.map_from_arrays(
        F.array(F.lit("unparsed appointment"), F.lit("no old action")),
        F.array("unparsed", (~F.coalesce(age > 0, F.lit(False))).cast("bigint")))
    counts = {
        "ticket without assignment": tickets_without_action(
            tickets, actions, features.TECHNICIAN.rows()).agg(F.count("*")),
        "repeated ticket": duplicates(tickets, features.TICKET_ID).agg(F.count("*")),
        "repeated action": duplicates(actions, "AP_AM_ACTION_ID").agg(F.count("*")),
    }
    if answers is not None:
        counts["repeated answer"] = repeated_answers(answers).agg(F.count("*"))
    rows = [found.toDF("violations").select(F.lit(name).alias("expectation"), "violations")
            for name, found in counts.items()]
    rows.append(_measured(actions, measured).select(
        F.explode(single).alias("expectation", "violations")))
    whole = rows[0]
    for row in rows[1:]:
        whole = whole.unionByName(row)
    return whole
