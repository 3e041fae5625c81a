"""Per-ticket features.

Everything a ticket takes from its actions is computed in one pass over them,
whatever the number of features.  A feature is a row condition, aggregates with
buffers of a fixed width (numbers, times, flags, a rank packed into one decimal),
which Spark keeps in a hash table, and what becomes of them per ticket.  A feature
that needs a text or the days of something groups by it as well: the actions are
hashed by (request, text), and only the few rows left per request meet again.
Nothing sorts the actions, and all aggregates are partial, so that a ticket that
owns a third of all actions is reduced inside each map task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from deskgauge import constants as K
from deskgauge.functions import text as X
from deskgauge.functions import time as XT
from deskgauge.operators import joins
from deskgauge.operators.cleaning import any_of
from deskgauge.operators.columns import require_columns

TICKET_ID = "AP_SD_REQUEST_ID"
ACTION_TICKET_ID = "AP_AM_REQUEST_ID"


def _action_type() -> Column:
    return F.col("AP_AM_ACTION_TYPE_ID")


def _start() -> Column:
    return F.col("AP_AM_START_DATE")


@dataclass(frozen=True)
class ActionFeature:
    """Rows a feature reads, and what it takes from them.

    ``prepared`` columns are worked out once per row.  ``aggregates`` are per request
    and, if there are any, ``keys``, of which rows that the feature does not read have
    null.  With keys, ``final`` makes the columns of a request from the aggregates and
    keys of its few rows.
    """

    rows: Callable[[], Column]
    aggregates: Callable[[Column], dict[str, Column]]
    final: Callable[[], dict[str, Column]]
    keys: Callable[[Column], dict[str, Column]] = lambda rows: {}
    prepared: Callable[[Column], dict[str, Column]] = lambda rows: {}


# A rank is a decimal of 38 digits: 18 for the microseconds, 20 for the number.
_NUMBER_DIGITS = Decimal(10) ** 20
_LATEST = Decimal(10) ** 18 - 1
_ERA = Decimal(10) ** 17  # beyond the microseconds from year 1 to 1970


def packed_rank(when: Column, number: Column, null_is_last: bool) -> Column:
    """Order by ``when``, then ``number``, as one decimal.

    A null time comes last or first, a null number first.  Times are told apart
    from year 1 to 9999.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = (XT.seconds_between(epoch, when) * 1_000_000).cast("decimal(20,0)") + F.lit(_ERA)
    inside = F.greatest(F.least(micros, F.lit(_LATEST - 1)), F.lit(Decimal(1)))
    at = F.coalesce(inside, F.lit(_LATEST if null_is_last else Decimal(0)))
    from_one = F.coalesce(number.cast("decimal(20,0)") + F.lit(Decimal(2**63 + 1)),
                          F.lit(Decimal(0)))
    return at.cast("decimal(18,0)") * F.lit(_NUMBER_DIGITS) + from_one


def _is_assignment() -> Column:
    return X.member(_action_type(), K.ACTION_ASSIGNMENT)


def _technician_rank(rows: Column) -> dict[str, Column]:
    """Open actions first, then the newest; the greatest is first."""
    rank = packed_rank(_start(), F.col("AP_AM_ACTION_ID"), null_is_last=True)
    return {"_assigned_rank": F.when(rows, rank)}


def _technician(rows: Column) -> dict[str, Column]:
    def known(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.col("_assigned_rank"))

    found = {"AP_AM_START_DATE": F.max(F.when(rows, _start())),
             "_name_rank": F.max(known("AP_AM_DONE_BY_OPERATOR_NAME"))}
    for name, rank in _RANKS.items():
        found[name] = F.max_by(name, known(name))
        found[rank] = F.max(known(name))
    return found


# Numbers that a ticket takes from the first action that has them, and their ranks.
_RANKS = {"AP_AM_ACTION_ID": "_action_rank", "AP_AM_ACTION_TYPE_ID": "_type_rank"}


def _technician_of_request() -> dict[str, Column]:
    return {
        **{name: F.max_by(name, rank) for name, rank in _RANKS.items()},
        "AP_AM_START_DATE": F.max("AP_AM_START_DATE"),
        "AP_AM_DONE_BY_OPERATOR_NAME": F.max_by("_name", "_name_rank"),
    }


def _is_work() -> Column:
    return ~X.member(_action_type(), K.ACTION_NOT_WORK)


def is_pilot_note(tag: str) -> Column:
    return X.member(_action_type(), K.ACTION_PILOT_NOTE) & X.contains(
        F.col("AP_AM_DESCRIPTION"), tag
    )


def _rdv_ranks(rows: Column) -> dict[str, Column]:
    date = XT.parse_day(X.rdv_date_text(F.col("AP_AM_DESCRIPTION")))
    rank = packed_rank(date, F.col("AP_AM_ACTION_ID"), null_is_last=False)
    return {"_rdv_date": F.when(rows, date), "_rdv_rank": F.when(rows, rank)}


def _rdv(rows: Column) -> dict[str, Column]:
    return {
        "C_HAS_RDV": F.bool_or(rows),
        "C_RDV_DATE": F.max("_rdv_date"),
        "_note_rank": F.max("_rdv_rank"),
    }


def _rdv_of_request() -> dict[str, Column]:
    return {
        "C_HAS_RDV": F.bool_or("C_HAS_RDV"),
        "C_RDV_DATE": F.max("C_RDV_DATE"),
        "AP_AM_DESCRIPTION": F.max_by("_note", "_note_rank"),
    }


def _simple(rows: Callable[[], Column], name: str, aggregate: Callable[[Column], Column],
            value: Callable[[], Column] | None = None) -> ActionFeature:
    """One aggregate that merges by itself; without ``value``, of the condition."""
    def of(rows: Column) -> Column:
        return F.when(rows, value()) if value else rows

    return ActionFeature(rows, lambda rows: {name: aggregate(of(rows))},
                         lambda: {name: aggregate(F.col(name))})


def first_actions(actions: DataFrame) -> DataFrame:
    """Per request: the action that is open or newest, the earliest, and the latest.

    The ordered firsts are aggregates: no task ever holds a whole group.
    """
    number = F.col("AP_AM_ACTION_ID")
    open_last = F.struct(_start().isNull(), _start(), number)
    return actions.groupBy(ACTION_TICKET_ID).agg(
        F.max_by(number, open_last).alias("open_or_newest"),
        F.min_by(number, open_last).alias("earliest"),
        F.max_by(number, F.struct(_start(), number)).alias("latest"),
    )


TECHNICIAN = ActionFeature(
    _is_assignment, _technician, _technician_of_request,
    lambda rows: {"_name": F.when(rows, F.col("AP_AM_DONE_BY_OPERATOR_NAME"))},
    _technician_rank,
)
FIRST_ACTION = _simple(_is_work, "C_ACTION_START", F.min, _start)
LATEST_ACTION = _simple(_is_work, "C_ACTION_START", F.max, _start)
RDV = ActionFeature(
    lambda: is_pilot_note(K.TAG_RDV), _rdv, _rdv_of_request,
    lambda rows: {"_note": F.when(rows, F.col("AP_AM_DESCRIPTION"))},
    _rdv_ranks,
)
OBSERVATION = _simple(
    lambda: is_pilot_note(K.TAG_OBSERVATION), "C_UNDER_OBSERVATION", F.bool_or)
SUSPENSION = _simple(
    lambda: _action_type() == K.ACTION_SUSPENSION, "C_SUSPENDED_AT", F.max, _start)
OBSERVED_SINCE = _simple(
    lambda: _action_type() == K.ACTION_OBSERVATION, "C_OBSERVED_AT", F.max, _start)


def action_features(actions: DataFrame, *features: ActionFeature) -> DataFrame:
    """One row per request id with the columns of ``features``.

    Rows that no feature reads are filtered first, so that they are not shuffled.
    """
    conditions = [f.rows() for f in features]
    prepared, keys, aggregates, final = {}, {}, {}, {}
    for feature, rows in zip(features, conditions):
        prepared.update(feature.prepared(rows))
        keys.update(feature.keys(rows))
        aggregates.update(feature.aggregates(rows))
        final.update(feature.final())
    read = actions.filter(F.col(ACTION_TICKET_ID).isNotNull() & any_of(conditions))
    if prepared or keys:
        read = read.withColumns(prepared | keys)
    found = read.groupBy(ACTION_TICKET_ID, *keys).agg(
        *[value.alias(name) for name, value in aggregates.items()])
    if not keys:
        return found
    return found.groupBy(ACTION_TICKET_ID).agg(
        *[value.alias(name) for name, value in final.items()])


def with_action_features(tickets: DataFrame, actions: DataFrame,
                         *features: ActionFeature) -> DataFrame:
    """Tickets with ``features``; tickets without such actions keep nulls."""
    found = action_features(actions, *features)
    return joins.merge(tickets, found, TICKET_ID, ACTION_TICKET_ID).drop(ACTION_TICKET_ID)


def assigned_to(tickets: DataFrame, actions: DataFrame, tech_filter: str | None) -> DataFrame:
    """Tickets with any assignment whose operator matches, where there is a pattern.

    The operator that :func:`filter_technician` looks at is one of them.  Most tickets
    have none, so their actions are never grouped.
    """
    if not tech_filter:
        return tickets
    matching = actions.filter(
        _is_assignment() & X.matches(F.col("AP_AM_DONE_BY_OPERATOR_NAME"), tech_filter)
    ).select(ACTION_TICKET_ID).distinct()
    return tickets.join(
        matching, tickets[TICKET_ID] == matching[ACTION_TICKET_ID], "left_semi")


def with_technician(tickets: DataFrame, actions: DataFrame,
                    tech_filter: str | None = None) -> DataFrame:
    """Assigned operator, optionally only operators that match a pattern."""
    tickets = assigned_to(tickets, actions, tech_filter)
    tickets = with_action_features(tickets, actions, TECHNICIAN)
    return filter_technician(tickets, tech_filter)


def filter_technician(tickets: DataFrame, tech_filter: str | None) -> DataFrame:
    if not tech_filter:
        return tickets
    return tickets.filter(
        X.matches(F.col("AP_AM_DONE_BY_OPERATOR_NAME"), tech_filter)
    )


def with_ticket_type(tickets: DataFrame) -> DataFrame:
    is_request = X.startswith(F.col("AP_SD_RFC_NUMBER"), K.REQUEST_RFC_PREFIX)
    return tickets.withColumns({
        "C_TICKET_TYPE": F.when(is_request, K.REQUEST).otherwise(K.INCIDENT).cast("bigint"),
        "C_TICKET_TYPE_STRING_FR": F.when(
            is_request, K.TICKET_TYPE_NAMES[K.REQUEST]
        ).otherwise(K.TICKET_TYPE_NAMES[K.INCIDENT]),
    })


def with_start_date(tickets: DataFrame) -> DataFrame:
    return tickets.withColumn("C_START_DATE", F.col("AP_SD_SUBMIT_DATE_UT"))


def with_age(tickets: DataFrame, as_of: Column) -> DataFrame:
    """Age in minutes."""
    require_columns(tickets, ["C_START_DATE"])
    return tickets.withColumn(
        "C_TICKET_AGE", XT.minutes_between(F.col("C_START_DATE"), as_of)
    )


def add_last_action_age(tickets: DataFrame, as_of: Column) -> DataFrame:
    """Minutes since the action start that FIRST_ACTION or LATEST_ACTION found."""
    return tickets.withColumn(
        "C_LAST_ACTION_DATE", XT.minutes_between(F.col("C_ACTION_START"), as_of)
    ).drop("C_ACTION_START")


def with_last_action(tickets: DataFrame, actions: DataFrame, as_of: Column,
                     which: str = "first") -> DataFrame:
    """Minutes since the first (default) or ``"latest"`` work action."""
    feature = {"first": FIRST_ACTION, "latest": LATEST_ACTION}[which]
    return add_last_action_age(with_action_features(tickets, actions, feature), as_of)


def add_rdv_state(tickets: DataFrame, as_of: Column) -> DataFrame:
    """Appointment state from the columns the RDV feature found."""
    date = F.col("C_RDV_DATE")
    state = (
        F.when(date <= as_of, K.RDV_LATE)
        .when(date >= as_of, K.RDV_PENDING)
        .when(F.col("C_HAS_RDV"), K.RDV_INVALID)
        .otherwise(K.RDV_NONE)
    )
    return tickets.withColumn("C_RDV_STATE", state).drop("C_HAS_RDV")


def with_rdv(tickets: DataFrame, actions: DataFrame, as_of: Column) -> DataFrame:
    return add_rdv_state(with_action_features(tickets, actions, RDV), as_of)


def observation_age(tickets: DataFrame, actions: DataFrame, as_of: Column) -> DataFrame:
    """Minutes since the newest observation note of a ticket."""
    tickets = with_action_features(tickets, actions, OBSERVED_SINCE)
    return tickets.withColumn(
        "C_LAST_ACTION_DATE", XT.minutes_between(F.col("C_OBSERVED_AT"), as_of)
    ).drop("C_OBSERVED_AT")


def answer_or_result(answers: DataFrame) -> DataFrame:
    """The raw answer stands in for a missing text answer."""
    return answers.withColumn("RESULT_STRING_FR", F.coalesce("RESULT_STRING_FR", "RESULT"))


def pivot_answers(answers: DataFrame) -> DataFrame:
    """One row per ticket, one column per question.

    Conditional aggregates need one shuffle where ``pivot`` needs two.  A
    question answered twice keeps the greatest answer; ``quality`` lists it.
    """
    question = F.col("QUESTION_ID")
    return answer_or_result(answers).groupBy(
        "REQUEST_ID", "RFC_NUMBER", "SD_CATALOG_ID"
    ).agg(*[
        F.max(F.when(question == number, F.col("RESULT_STRING_FR"))).alias(name)
        for number, name in K.QUESTIONS.items()
    ])
