"""Workflows: each takes the extracts and returns one lazy DataFrame.

A flow composes only the stages its result needs: a count never scores, and
the actions are not even read when no filter looks at them.  Ticket-only
selectors are applied before the features, so that the joins run on the
selected tickets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from deskgauge.functions import time as XT
from deskgauge.operators import classification as C
from deskgauge.operators import (
    cleaning, events, features, joins, quality, reports, rules, scoring,
)
from deskgauge.operators import selectors as S

Selector = Callable[[], Column]

_BY_CLASS = (S.is_hotline, S.is_proxy, S.is_unclassified)
_SCORE_FEATURES = (features.FIRST_ACTION,)
_ROW_FEATURES = (features.FIRST_ACTION, features.TECHNICIAN, features.RDV)


@dataclass(frozen=True)
class Desk:
    """Inputs of the workflows: the raw extracts, the side tables, settings.

    ``as_of`` is the one "now" of a run, the moment the desk is made unless
    given; every rule that looks at the clock uses it.
    """

    tickets: DataFrame
    actions: DataFrame
    classification: DataFrame
    intervention_types: DataFrame
    answers: DataFrame | None = None
    as_of: Column | None = None
    vip_names: Sequence[str] = ()
    date_format: str | None = None

    def __post_init__(self):
        if self.as_of is None:
            object.__setattr__(self, "as_of", XT.moment())

    @property
    def now(self) -> Column:
        return self.as_of

    def clean_tickets(self) -> DataFrame:
        return cleaning.drop_known_bad_tickets(cleaning.clean_tickets(self.tickets))

    def clean_actions(self) -> DataFrame:
        return cleaning.drop_known_bad_actions(
            cleaning.clean_actions(self.actions, self.date_format)
        )

    def classify(self, tickets: DataFrame) -> DataFrame:
        return C.with_classification(
            tickets, self.classification, self.intervention_types
        )


# ---------------------------------------------------------------- stages

def _typed_tickets(desk: Desk) -> DataFrame:
    return features.with_start_date(features.with_ticket_type(desk.clean_tickets()))


def _technician(desk: Desk, tickets: DataFrame, tech_filter: str | None) -> DataFrame:
    """Technician stage of flows that only filter by it."""
    if not tech_filter:
        return tickets
    return features.with_technician(tickets, desk.clean_actions(), tech_filter)


def _score(desk: Desk, tickets: DataFrame, now: Column) -> DataFrame:
    tickets = features.add_last_action_age(tickets, now)
    tickets = features.with_age(tickets, now)
    return scoring.with_score(tickets, desk.vip_names)


def _full(desk: Desk, tickets: DataFrame, tech_filter: str | None, now: Column,
          *more: features.ActionFeature,
          keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All row features: one pass over the actions, one join.

    ``keep`` filters by the features of ``more``.
    """
    actions = desk.clean_actions()
    tickets = features.with_action_features(
        features.assigned_to(tickets, actions, tech_filter), actions, *_ROW_FEATURES, *more
    )
    tickets = features.filter_technician(tickets, tech_filter)
    if keep:
        tickets = keep(tickets)
    tickets = _score(desk, features.add_rdv_state(tickets, now), now)
    return tickets if "AP_TYPE_FR" in tickets.columns else desk.classify(tickets)


def _soonest(desk: Desk, tickets: DataFrame, tech_filter: str | None) -> DataFrame:
    """The soonest tickets with technician and type label.

    Without a technician filter the order depends on ticket columns only, so
    the tickets are cut first, and only the actions and classification rows
    of the few that remain are aggregated and joined.  Their ids are one plan,
    the same for all three tables, so that Spark finds and broadcasts them once.
    """
    actions, known = desk.clean_actions(), desk.classification
    if tech_filter:
        tickets = features.with_technician(tickets, actions, tech_filter)
        tickets = reports.soonest(tickets)
    else:
        top = joins.top_ids(reports.soonest(tickets), features.TICKET_ID)
        tickets = joins.reduce_to(tickets, features.TICKET_ID, top)
        actions = joins.reduce_to(actions, features.ACTION_TICKET_ID, top)
        known = joins.reduce_to(known, "AP_REQUEST_ID", top)
        tickets = features.with_technician(tickets, actions)
    if "AP_TYPE_FR" in tickets.columns:
        return tickets
    return C.with_classification(tickets, known, desk.intervention_types)


def _rows(desk: Desk, tickets: DataFrame, tech_filter: str | None) -> DataFrame:
    return reports.format_rows(_full(desk, tickets, tech_filter, desk.now))


def _selected_rows(desk: Desk, selector: Selector, tech_filter: str | None) -> DataFrame:
    return _rows(desk, _typed_tickets(desk).filter(selector()), tech_filter)


def _selected_count(desk: Desk, selector: Selector, tech_filter: str | None) -> DataFrame:
    tickets = desk.clean_tickets().filter(selector())
    return reports.row_count(_technician(desk, tickets, tech_filter))


# ------------------------------------------------------------- calendars

def employee_movement_calendar(desk: Desk) -> DataFrame:
    return events.employee_events(features.pivot_answers(desk.answers))


def rdv_calendar(desk: Desk) -> DataFrame:
    tickets = features.with_rdv(desk.clean_tickets(), desk.clean_actions(), desk.now)
    return events.rdv_events(desk.classify(tickets.filter(S.has_dated_rdv())))


# ------------------------------------------------- selector rows and counts

def under_observation_rows(desk: Desk, tech_filter: str | None = None) -> DataFrame:
    tickets = _full(desk, _typed_tickets(desk), tech_filter, desk.now, features.OBSERVATION)
    return reports.format_rows(tickets.filter("C_UNDER_OBSERVATION"))


def under_observation_count(desk: Desk, tech_filter: str | None = None) -> DataFrame:
    """Without a technician filter only the tagged notes are read."""
    tickets, actions = desk.clean_tickets(), desk.clean_actions()
    if not tech_filter:
        return reports.row_count(S.under_observation(tickets, actions))
    tickets = features.with_action_features(
        features.assigned_to(tickets, actions, tech_filter), actions,
        features.OBSERVATION, features.TECHNICIAN
    ).filter("C_UNDER_OBSERVATION")
    return reports.row_count(features.filter_technician(tickets, tech_filter))


def software_install_rows(desk: Desk, tech_filter: str | None = None) -> DataFrame:
    return _selected_rows(desk, S.is_software_install, tech_filter)


def software_install_count(desk: Desk, tech_filter: str | None = None) -> DataFrame:
    return _selected_count(desk, S.is_software_install, tech_filter)


def new_arrivals_rows(desk: Desk, tech_filter: str | None = None) -> DataFrame:
    return _selected_rows(desk, S.is_new_arrival, tech_filter)


def new_arrivals_count(desk: Desk, tech_filter: str | None = None) -> DataFrame:
    return _selected_count(desk, S.is_new_arrival, tech_filter)


def not_suspended_rows(desk: Desk, tech_filter: str | None = None) -> DataFrame:
    return _selected_rows(desk, S.is_not_suspended, tech_filter)


def not_suspended_count(desk: Desk, tech_filter: str | None = None) -> DataFrame:
    return _selected_count(desk, S.is_not_suspended, tech_filter)


def industrial_rows(desk: Desk, tech_filter: str | None = None) -> DataFrame:
    return _selected_rows(desk, S.is_industrial, tech_filter)


def industrial_count(desk: Desk, tech_filter: str | None = None) -> DataFrame:
    return _selected_count(desk, S.is_industrial, tech_filter)


def security_rows(desk: Desk, tech_filter: str | None = None) -> DataFrame:
    return _selected_rows(desk, S.is_security, tech_filter)


def security_count(desk: Desk, tech_filter: str | None = None) -> DataFrame:
    return _selected_count(desk, S.is_security, tech_filter)


def vip_rows(desk: Desk, tech_filter: str | None = None) -> DataFrame:
    return _selected_rows(desk, lambda: S.is_about(desk.vip_names), tech_filter)


def vip_count(desk: Desk, tech_filter: str | None = None) -> DataFrame:
    return _selected_count(desk, lambda: S.is_about(desk.vip_names), tech_filter)


# ------------------------------------------------------- follow-up rules

def _not_recontacted(desk: Desk) -> DataFrame:
    return rules.suspended_mail_not_recontacted(
        _typed_tickets(desk), desk.clean_actions(), desk.now
    )


def suspended_mail_table(desk: Desk, tech_filter: str | None = None) -> DataFrame:
    return reports.mail_table(_soonest(desk, _not_recontacted(desk), tech_filter))


def suspended_mail_rows(desk: Desk, tech_filter: str | None = None) -> DataFrame:
    now = desk.now
    tickets = _typed_tickets(desk).filter(S.is_suspended_by_mail())
    return reports.format_rows(_full(
        desk, tickets, tech_filter, now, rules.CONTACTS_OR_NONE,
        keep=lambda found: rules.keep_not_recontacted(found, now)))


def suspended_mail_count(desk: Desk, tech_filter: str | None = None) -> DataFrame:
    return reports.row_count(_technician(desk, _not_recontacted(desk), tech_filter))


def suspended_too_long_rows(desk: Desk, inter_type: str | None = None,
                            tech_filter: str | None = None) -> DataFrame:
    now = desk.now
    tickets = desk.classify(_typed_tickets(desk).filter(S.is_suspended_by_technician()))
    tickets = tickets.filter(rules.is_of_suspended_kind(inter_type))
    tickets = _full(desk, tickets, tech_filter, now, features.SUSPENSION)
    return reports.format_rows(
        tickets.filter(rules.is_suspended_too_long(now, inter_type))
    )


def suspended_too_long_count(desk: Desk, inter_type: str | None = None,
                             tech_filter: str | None = None) -> DataFrame:
    tickets = desk.clean_tickets().filter(S.is_suspended_by_technician())
    tickets = rules.suspended_gt_x(
        desk.classify(tickets), desk.clean_actions(), desk.now, inter_type
    )
    return reports.row_count(_technician(desk, tickets, tech_filter))


def _contacted(desk: Desk, min_contacts: int) -> DataFrame:
    return rules.contacted_x_times(
        _typed_tickets(desk), desk.clean_actions(), min_contacts
    )


def contacted_rows(desk: Desk, tech_filter: str | None = None,
                   min_contacts: int = 3) -> DataFrame:
    tickets = _typed_tickets(desk).filter(rules.is_waiting())
    return reports.format_rows(_full(
        desk, tickets, tech_filter, desk.now, rules.CONTACTS,
        keep=lambda found: found.filter(rules.contacted_enough(min_contacts))))


def contacted_count(desk: Desk, tech_filter: str | None = None,
                    min_contacts: int = 3) -> DataFrame:
    return reports.row_count(
        _technician(desk, _contacted(desk, min_contacts), tech_filter)
    )


# ------------------------------------------------------------ ticket flow

def _flow_tickets(desk: Desk, inter_type: str | None) -> DataFrame:
    """Tickets of a segment, classified only if the segment asks for it."""
    tickets = _typed_tickets(desk)
    if any(part in _BY_CLASS for part in S.segment_parts(inter_type)):
        tickets = desk.classify(tickets)
    return S.ticket_flow(tickets, inter_type)


def ticket_flow_rows(desk: Desk, inter_type: str | None = None,
                     tech_filter: str | None = None) -> DataFrame:
    """The class of a segment is known before the actions are read."""
    return _rows(desk, _flow_tickets(desk, inter_type), tech_filter)


def ticket_flow_count(desk: Desk, inter_type: str | None = None,
                      tech_filter: str | None = None) -> DataFrame:
    return reports.row_count(
        _technician(desk, _flow_tickets(desk, inter_type), tech_filter)
    )


def ticket_flow_score(desk: Desk, inter_type: str | None = None,
                      tech_filter: str | None = None) -> DataFrame:
    wanted = _SCORE_FEATURES + ((features.TECHNICIAN,) if tech_filter else ())
    actions = desk.clean_actions()
    tickets = features.with_action_features(
        features.assigned_to(_flow_tickets(desk, inter_type), actions, tech_filter),
        actions, *wanted
    )
    tickets = features.filter_technician(tickets, tech_filter)
    return reports.total_score(_score(desk, tickets, desk.now))


def tickets_by_expiration(desk: Desk, tech_filter: str | None = None,
                          segment: str | None = None) -> DataFrame:
    """All types together; ``segment`` narrows the table to one segment."""
    tickets = _flow_tickets(desk, segment).filter(S.is_unexpired(desk.now))
    return reports.expiration_table(_soonest(desk, tickets, tech_filter))


def technician_table(desk: Desk) -> DataFrame:
    tickets = features.with_action_features(
        _typed_tickets(desk), desk.clean_actions(),
        features.FIRST_ACTION, features.TECHNICIAN,
    )
    return reports.technician_totals(_score(desk, tickets, desk.now))


def quality_report(desk: Desk, measured: dict | None = None) -> DataFrame:
    """Violations of the expectations on the extracts of a desk.

    ``measured`` is what a snapshot noted (``snapshots.action_measures``).
    """
    return quality.report(
        desk.clean_tickets(), desk.clean_actions(), desk.now, desk.answers, measured
    )


# ------------------------------------------------------------- side table

def change_classification(desk: Desk, updates: DataFrame) -> C.TypeChange:
    """Batch of type changes; see ``snapshots.change_stored_types`` to store it."""
    return C.change_types(
        desk.classification, desk.intervention_types, updates, desk.clean_tickets()
    )


# ------------------------------------------------------------- chart data

# Chart column -> the ticket column it shows.
_CHART_COLUMNS = {
    "ticket_number": lambda: F.col("AP_SD_RFC_NUMBER"),
    "configuration_item": lambda: F.col("AP_SD_CI_NAME"),
    "inter_type": lambda: F.col("AP_TYPE_FR"),
    "age": lambda: XT.fractional_days(F.col("C_TICKET_AGE")),
    "points": lambda: F.col("C_POINTS"),
}
_CHART_KEY = {"request_id": lambda: F.col("AP_SD_REQUEST_ID")}


def chart_tickets(desk: Desk, *columns: str) -> DataFrame:
    """Tickets with the chart columns asked for (default all).

    Only "points" reads the actions, only "inter_type" the classification;
    "age" is in days.  "request_id" can be asked for as well.
    """
    columns = columns or tuple(_CHART_COLUMNS)
    tickets, now = _typed_tickets(desk), desk.now
    if "points" in columns:
        tickets = _score(desk, features.with_action_features(
            tickets, desk.clean_actions(), *_SCORE_FEATURES
        ), now)
    elif "age" in columns:
        tickets = features.with_age(tickets, now)
    if "inter_type" in columns:
        tickets = desk.classify(tickets)
    shown = _CHART_COLUMNS | _CHART_KEY
    return tickets.select(*[shown[name]().alias(name) for name in columns])


def chart_data(desk: Desk, category: str = "configuration_item",
               value: str = "age") -> dict[str, DataFrame]:
    """Data of one chart: bars by ``category``, bins of ``value``, first rows.

    ``category`` is "configuration_item" or "inter_type", ``value`` is "age"
    or "points".
    """
    return {
        "bars": reports.counts_by(chart_tickets(desk, category), category),
        "bins": reports.histogram(chart_tickets(desk, value), F.col(value)),
        "rows": reports.first_rows(
            chart_tickets(desk, "ticket_number", category, *_CHART_KEY),
            "ticket_number", *_CHART_KEY,
        ).drop(*_CHART_KEY),
    }
