"""Cleaning of the two extracts: one projection each, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from deskgauge import constants as K
from deskgauge import schemas
from deskgauge.functions import text as X
from deskgauge.functions import time as XT

# Source column -> cleaned column.
TICKET_COLUMNS = {
    "REQUEST_ID": "AP_SD_REQUEST_ID",
    "PARENT_REQUEST_ID": "AP_SD_PARENT_REQUEST_ID",
    "RFC_NUMBER": "AP_SD_RFC_NUMBER",
    "CREATION_DATE_UT": "AP_SD_CREATION_DATE_UT",
    "SUBMIT_DATE_UT": "AP_SD_SUBMIT_DATE_UT",
    "END_DATE_UT": "AP_SD_END_DATE_UT",
    "MAX_RESOLUTION_DATE_UT": "AP_SD_MAX_RESOLUTION_DATE",
    "REQUESTOR_LOCATION_RH": "AP_SD_REQUESTOR_LOCATION_RH",
    "LOCATION_ID": "AP_SD_LOCATION_ID",
    "REQUESTOR_PHONE": "AP_SD_REQUESTOR_PHONE",
    "RECIPIENT_ID": "AP_SD_RECIPIENT_ID",
    "RECIPIENT_LAST_NAME": "AP_SD_RECIPIENT_LAST_NAME",
    "RECIPIENT_LOCATION_RH": "AP_SD_RECIPIENT_LOCATION_RH",
    "SD_CATALOG_ID": "AP_SD_CATALOG_ID",
    "CATALOG_NAME": "AP_SD_CATALOG_NAME",
    "STATUS_ID": "AP_SD_STATUS_ID",
    "STATUS_FR": "AP_SD_STATUS_FR",
    "COMMENT": "AP_SD_COMMENT",
    "DESCRIPTION": "AP_SD_DESCRIPTION",
    "URGENCY_ID": "AP_SD_URGENCY_ID",
    "URGENCY_FR": "AP_SD_URGENCY",
    "CI_ID": "AP_SD_CI_ID",
    "CI_NAME": "AP_SD_CI_NAME",
    "OWNER_ID": "AP_SD_OWNER_ID",
    "LAST_NAME": "AP_SD_LAST_NAME",
    "OWNING_GROUP_ID": "AP_SD_OWNING_GROUP_ID",
    "GROUP_FR": "AP_SD_GROUP_FR",
    "DEPARTMENT_ID": "AP_SD_DEPARTMENT_ID",
    "REQUESTOR_FEEDBACK": "AP_SD_REQUESTOR_FEEDBACK",
    "ASSET_ID": "AP_SD_ASSET_ID",
    "ASSET_TAG": "AP_SD_MATERIAL_NAME",
    "FIRST_CALL_RESOLUTION": "AP_SD_FIRST_CALL_RESOLUTION",
    "SEVERITY_ID": "AP_SD_SEVERITY_ID",
    "TIME_USED_TO_SOLVE_REQUEST": "AP_SD_TIME_USED_TO_SOLVE_REQUEST",
    "REQUEST_ORIGIN_ID": "AP_SD_REQUEST_ORIGIN_ID",
    "DELAY": "AP_SD_DELAY",
    "SYSTEM_ID": "AP_SD_SYSTEM_ID",
    "LAST_GROUP_ID": "AP_SD_LAST_GROUP_ID",
    "LAST_DONE_BY_ID": "AP_SD_LAST_DONE_BY_ID",
    "SLA_ID": "AP_SD_SLA_ID",
    "IMPACT_ID": "AP_SD_IMPACT_ID",
    "E_INFRA_COMMENT": "AP_SD_E_INFRA_COMMENT",
    "IS_MAJOR_INCIDENT": "AP_SD_IS_MAJOR_INCIDENT",
    "E_TYPE_SUPPORT": "AP_SD_SUPPORT_TYPE",
}

# Action columns take the prefix AP_AM_ except for these names.
ACTION_COLUMNS = {
    "ACTION_LABEL_FR": "AP_AM_OPERATION_TYPE_NAME",
    "START_DATE_UT": "AP_AM_START_DATE",
    "DONE_BY_NAME": "AP_AM_DONE_BY_OPERATOR_NAME",
}
ACTION_PREFIX = "AP_AM_"

_TICKET_DATES = ("CREATION_DATE_UT", "SUBMIT_DATE_UT", "END_DATE_UT",
                 "MAX_RESOLUTION_DATE_UT")
_ACTION_DATES = ("START_DATE_UT", "END_DATE_UT", "CREATION_DATE_UT", "LAST_UPDATE")


def action_column(source: str) -> str:
    return ACTION_COLUMNS.get(source, ACTION_PREFIX + source)


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _projected(df: DataFrame, changed: dict[str, Column], then=None,
               names: dict[str, str] | None = None) -> list[Column]:
    """All columns of ``df`` for one ``select``: changed, changed again, renamed."""
    columns = {c: F.col(c) for c in df.columns} | changed
    if then is not None:
        columns |= then(columns)
    names = names or {}
    return [column.alias(names.get(c, c)) for c, column in columns.items()]


def _sentinels(df: DataFrame) -> dict[str, Column]:
    return {c: X.sentinel_to_null(F.col(c)) for c in _text_columns(df)}


def _blanks(df: DataFrame) -> dict[str, Column]:
    return {c: X.blank_to_null(F.col(c)) for c in _text_columns(df)}


def sentinels_to_null(df: DataFrame) -> DataFrame:
    """``N/A`` and anything that contains ``<NA>`` become null, in text columns."""
    return df.withColumns(_sentinels(df))


def blanks_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns(_blanks(df))


def drop_empty_actions(df: DataFrame) -> DataFrame:
    """Drop actions without start, operator and label."""
    return df.dropna("all", subset=["START_DATE_UT", "DONE_BY_NAME", "ACTION_LABEL_FR"])


def _present(df: DataFrame, columns: dict[str, Column]) -> dict[str, Column]:
    return {name: value for name, value in columns.items() if name in df.columns}


def _dates(df: DataFrame, names, pattern: str | None,
           columns: dict[str, Column]) -> dict[str, Column]:
    return {
        name: XT.as_utc(columns[name], df.schema[name].dataType, pattern)
        for name in names if name in columns
    }


def _ticket_defaults(df: DataFrame) -> dict[str, Column]:
    return _present(df, {
        "RECIPIENT_LAST_NAME": X.strip_accents(
            F.coalesce("RECIPIENT_LAST_NAME", F.lit(K.FILL_NAME))
        ),
        "URGENCY_FR": F.coalesce("URGENCY_FR", F.lit(K.FILL_URGENCY)),
        "RECIPIENT_LOCATION_RH": F.coalesce(
            "RECIPIENT_LOCATION_RH", F.lit(K.FILL_LOCATION)
        ),
    })


def fill_ticket_defaults(df: DataFrame) -> DataFrame:
    """Constant fill-ins of a raw ticket frame; names also lose their accents."""
    return df.withColumns(_ticket_defaults(df))


def _comment(df: DataFrame) -> dict[str, Column]:
    cleaned = X.strip_greeting(X.strip_tags(F.col("COMMENT")))
    return _present(df, {"COMMENT": cleaned})


def clean_comment(df: DataFrame) -> DataFrame:
    return df.withColumns(_comment(df))


def clean_tickets(df: DataFrame) -> DataFrame:
    """Ticket extract -> cleaned, renamed tickets with UTC timestamps.

    Two projections: what looks at raw values, then what builds on the result.
    """
    known = df.select(*_projected(df, _sentinels(df), lambda columns: _dates(
        df, _TICKET_DATES, None, columns)))
    return known.select(*_projected(
        known, _comment(known) | _ticket_defaults(known), names=TICKET_COLUMNS))


def _operator_or_group() -> Column:
    return F.coalesce("DONE_BY_NAME", "GROUP_FR")


def operator_or_group(df: DataFrame) -> DataFrame:
    """The group stands in for a missing operator name."""
    return df.withColumn("DONE_BY_NAME", _operator_or_group())


def clean_actions(df: DataFrame, date_format: str | None = None) -> DataFrame:
    """Action extract -> cleaned, renamed actions with UTC timestamps.

    ``date_format`` is a Spark datetime pattern for text dates that differ
    from the default.
    """
    known = drop_empty_actions(df.select(*_projected(df, _blanks(df))))
    columns = {c: F.col(c) for c in known.columns}
    changed = _dates(known, _ACTION_DATES, date_format, columns)
    changed["DONE_BY_NAME"] = _operator_or_group()
    return known.select(*_projected(
        known, changed, names={c: action_column(c) for c in schemas.ACTIONS.names}))


def drop_known_bad_tickets(df: DataFrame, ids=K.REQUEST_IDS_KNOWN_BAD) -> DataFrame:
    return df.filter(~X.member(F.col("AP_SD_REQUEST_ID"), ids))


def drop_known_bad_actions(df: DataFrame, ids=K.REQUEST_IDS_KNOWN_BAD) -> DataFrame:
    return df.filter(~X.member(F.col("AP_AM_REQUEST_ID"), ids))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)
