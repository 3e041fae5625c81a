"""Follow-up rules on suspended tickets.

Contacts are a feature like the others, grouped by ticket and local day: a ticket has
at most as many rows as there are days, however many actions it has.  Where a flow
needs other features too, all come from one pass over the actions.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from deskgauge import constants as K
from deskgauge.functions import text as X
from deskgauge.functions import time as XT
from deskgauge.operators import features, joins, selectors
from deskgauge.operators.columns import require_columns

MIN_CONTACT_SPAN = 7
HOTLINE = "hotline"
GRACE_DAYS_HOTLINE = 1
GRACE_DAYS_PROXY = 5


def _day(rows: Column) -> dict[str, Column]:
    contact = selectors.is_contact_action()
    return {"_day": F.when(contact, XT.local_date(F.col("AP_AM_START_DATE")))}


def _contacts_of_day(rows: Column) -> dict[str, Column]:
    contact = selectors.is_contact_action()
    return {
        "_latest": F.max(F.when(contact, F.col("AP_AM_START_DATE"))),
        "_contact": F.bool_or(contact),
    }


def _contacts_of_request() -> dict[str, Column]:
    """Contact days, latest contact of the first and last day.

    A ticket has one row per day, and more only for what other features group by.
    """
    micros = XT.seconds_between(XT.moment("1970-01-01 00:00:00"), F.col("_latest"))
    return {
        "contact_days": F.size(F.collect_set("_day")).cast("bigint"),
        "first_contact": F.min_by("_latest", F.when(
            F.col("_day").isNotNull(), F.struct("_day", -micros))),
        "last_contact": F.max("_latest"),
        "was_contacted": F.bool_or("_contact"),
    }


# All actions are read where a ticket whose actions hold no contact counts too.
CONTACTS = features.ActionFeature(
    selectors.is_contact_action, _contacts_of_day, _contacts_of_request, _day)
CONTACTS_OR_NONE = replace(CONTACTS, rows=lambda: F.lit(True))


def _per_day(actions: DataFrame) -> DataFrame:
    """One row per ticket and local day of a contact, one for all its other actions."""
    contact = selectors.is_contact_action()
    return (
        actions.filter(F.col(features.ACTION_TICKET_ID).isNotNull())
        .withColumns(_day(contact)).groupBy(features.ACTION_TICKET_ID, "_day")
        .agg(*[value.alias(name) for name, value in _contacts_of_day(contact).items()])
    )


def latest_contact_per_day(actions: DataFrame) -> DataFrame:
    """``day`` and ``latest`` contact of every ticket and local day with one."""
    return _per_day(actions.filter(selectors.is_contact_action())).filter(
        F.col("_day").isNotNull()
    ).select(features.ACTION_TICKET_ID, F.col("_day").alias("day"),
             F.col("_latest").alias("latest"))


def contact_days(actions: DataFrame) -> DataFrame:
    """Per ticket: contact days, latest contact of the first and last day.

    Tickets whose actions hold no contact are kept, with zero days.
    """
    return _per_day(actions).groupBy(features.ACTION_TICKET_ID).agg(
        F.count("_day").alias("contact_days"),
        F.min("_latest").alias("first_contact"),
        F.max("_latest").alias("last_contact"),
        F.bool_or("_contact").alias("was_contacted"),
    )


def _keep(tickets: DataFrame, contacts: DataFrame, condition: Column) -> DataFrame:
    kept = contacts.filter(condition).select(features.ACTION_TICKET_ID)
    return joins.merge(
        tickets, kept, features.TICKET_ID, features.ACTION_TICKET_ID, "inner"
    ).drop(features.ACTION_TICKET_ID)


def not_recontacted() -> Column:
    """Predicate on ``contact_days`` rows, given the column ``now``.

    n contact days (three at most) grant n working days after the last one.
    """
    last = XT.local(F.col("last_contact"))
    days = F.col("contact_days")

    def overdue(grace: int) -> Column:
        return F.col("now") > XT.add_business_days(last, grace)

    return F.coalesce(
        F.when(~F.col("was_contacted"), True)
        .when(days >= 3, overdue(3))
        .when(days == 2, overdue(2))
        .when(days == 1, overdue(1)),
        F.lit(False),
    )


def keep_not_recontacted(tickets: DataFrame, as_of: Column) -> DataFrame:
    """Tickets with the CONTACTS_OR_NONE feature that are due for another contact."""
    return tickets.withColumn("now", XT.local(as_of)).filter(not_recontacted()).drop("now")


def suspended_mail_not_recontacted(tickets: DataFrame, actions: DataFrame,
                                   as_of: Column) -> DataFrame:
    """Mail-suspended tickets whose user is due for another contact.

    Tickets without any action are dropped, those without a contact kept.
    """
    contacts = contact_days(actions).withColumn("now", XT.local(as_of))
    return _keep(
        tickets.filter(selectors.is_suspended_by_mail()), contacts, not_recontacted()
    )


def contacted_x_times(tickets: DataFrame, actions: DataFrame,
                      min_contacts: int = 3) -> DataFrame:
    """Mail-suspended normal tickets, contacted often enough over long enough."""
    contacts = contact_days(actions.filter(selectors.is_contact_action()))
    return _keep(tickets.filter(is_waiting()), contacts, contacted_enough(min_contacts))


def is_waiting() -> Column:
    return selectors.is_suspended_by_mail() & selectors.is_normal_urgency()


def contacted_enough(min_contacts: int = 3) -> Column:
    """Predicate on the columns of contacts."""
    span = XT.business_days_between(
        XT.local(F.col("first_contact")), XT.local(F.col("last_contact"))
    )
    return (F.col("contact_days") >= min_contacts) & (span >= MIN_CONTACT_SPAN)


def is_of_suspended_kind(inter_type: str | None) -> Column:
    """The class part of :func:`is_suspended_too_long`, known without actions."""
    return selectors.is_hotline() if inter_type == HOTLINE else selectors.is_proxy()


def is_suspended_too_long(as_of: Column, inter_type: str | None) -> Column:
    """Predicate on tickets with type and the SUSPENSION feature.

    Any type but "hotline", none included, means the proxy types.
    """
    grace = GRACE_DAYS_HOTLINE if inter_type == HOTLINE else GRACE_DAYS_PROXY
    suspended_at = F.col("C_SUSPENDED_AT")
    deadline = XT.add_business_days(XT.local(suspended_at), grace)
    return (
        selectors.is_suspended_by_technician()
        & is_of_suspended_kind(inter_type)
        & X.never_null(deadline < XT.local(as_of), suspended_at)
    )


def suspended_gt_x(tickets: DataFrame, actions: DataFrame, as_of: Column,
                   inter_type: str | None = None) -> DataFrame:
    """Classified tickets suspended for longer than their type allows."""
    require_columns(tickets, ["AP_INTERVENTION_TYPE"])
    tickets = features.with_action_features(tickets, actions, features.SUSPENSION)
    return tickets.filter(is_suspended_too_long(as_of, inter_type)).drop("C_SUSPENDED_AT")
