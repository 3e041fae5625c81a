"""Ticket segments as predicates.

Each predicate is a never-null ``Column`` over cleaned ticket columns, so it
can be filtered on, negated or combined, and Catalyst moves it below the
feature joins to the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from deskgauge import constants as K
from deskgauge.functions import text as X
from deskgauge.operators import features


def _ci_or_comment(ci: Column, pattern: str) -> Column:
    return ci | X.matches(F.col("AP_SD_COMMENT"), pattern)


def _ci_name(names: Sequence[str]) -> Column:
    return X.member(F.col("AP_SD_CI_NAME"), names)


def is_security() -> Column:
    return _ci_or_comment(
        X.member(F.col("AP_SD_CI_ID"), K.CI_ID_SECURITY), K.PATTERN_SECURITY
    )


def is_about(people: Sequence[str]) -> Column:
    """Requestor or recipient is one of ``people``."""
    if not people:
        return F.lit(False)
    return X.member(F.col("REQUESTOR_LAST_NAME"), people) | X.member(
        F.col("AP_SD_RECIPIENT_LAST_NAME"), people
    )


def is_industrial() -> Column:
    return _ci_or_comment(_ci_name(K.CI_INDUSTRIAL), K.PATTERN_INDUSTRIAL)


def is_digipass() -> Column:
    return _ci_or_comment(_ci_name(K.CI_DIGIPASS), K.PATTERN_DIGIPASS)


def is_skype() -> Column:
    return _ci_name(K.CI_SKYPE)


def is_outlook() -> Column:
    return _ci_name(K.CI_OUTLOOK)


def is_telephone() -> Column:
    return _ci_name(K.CI_TELEPHONE)


def _status(ids: Sequence[int]) -> Column:
    return X.member(F.col("AP_SD_STATUS_ID"), ids)


def is_not_suspended() -> Column:
    """Keeps requests as well as incidents, and tickets without a status."""
    return ~_status(K.STATUS_SUSPENDED)


def is_suspended_by_mail() -> Column:
    return _status(K.STATUS_SUSPENDED_BY_MAIL)


def is_suspended_by_technician() -> Column:
    return _status(K.STATUS_SUSPENDED_BY_TECHNICIAN)


def is_software_install() -> Column:
    return X.member(F.col("AP_SD_CATALOG_ID"), K.CATALOG_SOFTWARE_INSTALL)


def is_new_arrival() -> Column:
    return X.member(F.col("AP_SD_CATALOG_ID"), (K.CATALOG_NEW_ARRIVAL,))


def _urgency(*ids: int) -> Column:
    return X.member(F.col("AP_SD_URGENCY_ID"), ids)


def is_urgent() -> Column:
    return _urgency(K.URGENCY_MAJEUR, K.URGENCY_IMPORTANT)


def is_normal_urgency() -> Column:
    return _urgency(K.URGENCY_NORMAL)


def is_unexpired(as_of: Column) -> Column:
    due = F.col("AP_SD_MAX_RESOLUTION_DATE")
    return is_not_suspended() & X.never_null(due > as_of, due)


def has_dated_rdv() -> Column:
    return X.member(F.col("C_RDV_STATE"), (K.RDV_PENDING, K.RDV_LATE))


def is_contact_action() -> Column:
    """Predicate on actions: the user was called or written to."""
    return X.matches(F.col("AP_AM_OPERATION_TYPE_NAME"), K.PATTERN_CONTACT)


def _intervention(*ids: int) -> Column:
    return X.member(F.col("AP_INTERVENTION_TYPE"), ids)


def is_hotline() -> Column:
    return _intervention(K.INTERVENTION_HOTLINE)


def is_proxy() -> Column:
    return _intervention(*K.INTERVENTION_PROXY)


def is_unclassified() -> Column:
    return _intervention(K.INTERVENTION_UNCLASSIFIED)


def is_incident() -> Column:
    return X.member(F.col("C_TICKET_TYPE"), (K.INCIDENT,))


def is_request() -> Column:
    return X.member(F.col("C_TICKET_TYPE"), (K.REQUEST,))


# Segment name -> parts that must all hold.
SEGMENTS: dict[str, tuple[Callable[[], Column], ...]] = {
    "hotline": (is_hotline,),
    "proxy": (is_proxy,),
    "unclassified": (is_unclassified,),
    "incident": (is_incident,),
    "request": (is_request,),
    "incident+hotline": (is_incident, is_hotline),
    "incident+proxy": (is_incident, is_proxy),
    "request+hotline": (is_request, is_hotline),
    "request+proxy": (is_request, is_proxy),
}


def segment_parts(segment: str | None) -> tuple[Callable[[], Column], ...]:
    return SEGMENTS.get(segment, ())


def ticket_flow(tickets: DataFrame, segment: str | None = None,
                suspended: bool | None = None) -> DataFrame:
    """Tickets of a segment; an unknown or missing segment keeps all.

    Only ``suspended=False`` filters: it drops the suspended tickets.
    """
    if suspended is False:
        tickets = tickets.filter(is_not_suspended())
    for part in segment_parts(segment):
        tickets = tickets.filter(part())
    return tickets


def under_observation(tickets: DataFrame, actions: DataFrame) -> DataFrame:
    """Tickets with a pilot note that carries the observation tag."""
    noted = actions.filter(features.is_pilot_note(K.TAG_OBSERVATION)).select(
        features.ACTION_TICKET_ID
    ).distinct()
    return tickets.join(
        noted, tickets[features.TICKET_ID] == noted[features.ACTION_TICKET_ID], "left_semi"
    )
