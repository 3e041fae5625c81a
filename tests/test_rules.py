from __future__ import annotations

import pytest
from helpers import action, actions, classification, ticket, tickets, types, values

from deskgauge.functions import time as XT
from deskgauge.operators import classification as C
from deskgauge.operators import rules

MAIL = "Envoi de mail au demandeur"


def contact(number, request, start, label=MAIL):
    return action(number, request, start, kind=18, ACTION_LABEL_FR=label)


def waiting(i, **more):
    return ticket(i, **({"STATUS_ID": 39} | more))


def due(spark, rows, clock, *more):
    return values(rules.suspended_mail_not_recontacted(
        tickets(spark, waiting(1), *more), actions(spark, *rows), XT.moment(clock)),
        "AP_SD_REQUEST_ID")


# One contact on Friday 09:00 Paris (07:00 UTC in summer) allows until Monday 09:00.
@pytest.mark.parametrize("clock, expected", [
    ("2024-04-08 07:00:00", []), ("2024-04-08 07:00:01", [(1,)])])
def test_one_contact(spark, clock, expected):
    assert due(spark, [contact(1, 1, "2024-04-05 07:00:00")], clock) == expected


@pytest.mark.parametrize("clock, expected", [
    ("2024-04-09 07:00:00", []), ("2024-04-09 07:00:01", [(1,)])])
def test_two_contact_days(spark, clock, expected):
    rows = [contact(1, 1, "2024-04-05 07:00:00"), contact(2, 1, "2024-04-04 07:00:00"),
            contact(3, 1, "2024-04-05 06:00:00", "RELANCE vers l'utilisateur")]
    assert due(spark, rows, clock) == expected


@pytest.mark.parametrize("clock, expected", [
    ("2024-04-10 07:00:00", []), ("2024-04-10 07:00:01", [(1,)])])
def test_three_and_more_contact_days(spark, clock, expected):
    rows = [contact(i, 1, f"2024-04-0{i} 07:00:00") for i in (2, 3, 4, 5)]
    assert due(spark, rows, clock) == expected


def test_days_are_local(spark):
    # 22:30 UTC is after midnight in Paris: two days, so two days of grace.
    rows = [contact(1, 1, "2024-04-02 21:30:00"), contact(2, 1, "2024-04-02 22:30:00")]
    assert due(spark, rows, "2024-04-04 12:00:00") == []
    assert due(spark, rows, "2024-04-05 12:00:00") == [(1,)]


def test_without_contact_or_without_action(spark):
    rows = [action(1, 1, "2024-04-05 07:00:00")]
    # Ticket 2 has no action at all, ticket 3 is not suspended by mail.
    assert due(spark, rows + [action(2, 3, "2024-04-05 07:00:00")], "2024-04-05 08:00:00",
               waiting(2), ticket(3, STATUS_ID=5)) == [(1,)]


def test_contact_without_date_is_no_contact_day(spark):
    rows = [contact(1, 1, None), contact(2, 1, "2024-04-05 07:00:00")]
    assert due(spark, rows, "2024-04-08 07:00:01") == [(1,)]
    assert due(spark, [contact(1, 1, None)], "2024-04-08 07:00:01") == []


def often(spark, rows, n=3, **more):
    return values(rules.contacted_x_times(
        tickets(spark, waiting(1, STATUS_ID=42, **more)), actions(spark, *rows), n), "AP_SD_REQUEST_ID")


def test_contacted_often_enough(spark):
    rows = [contact(i, 1, f"2024-04-0{i} 07:00:00") for i in (1, 3)]
    assert often(spark, rows + [contact(9, 1, "2024-04-09 07:00:00")]) == [(1,)]
    # Seven working days need the time of day of the first contact.
    assert often(spark, rows + [contact(9, 1, "2024-04-09 06:59:00")]) == []
    assert often(spark, rows) == []
    assert often(spark, rows + [contact(9, 1, "2024-04-09 07:00:00")], URGENCY_ID=3) == []
    assert often(spark, rows[:1] + [contact(9, 1, "2024-04-09 07:00:00")], 2) == [(1,)]


def test_first_day_counts_from_its_latest_contact(spark):
    rows = [contact(1, 1, "2024-04-01 05:00:00"), contact(2, 1, "2024-04-01 09:00:00"),
            contact(3, 1, "2024-04-03 07:00:00"), contact(4, 1, "2024-04-09 07:00:00")]
    assert often(spark, rows) == []


@pytest.mark.parametrize("kind, inter_type, clock, expected", [
    (2, "hotline", "2024-04-08 07:00:00", []), (2, "hotline", "2024-04-08 07:00:01", [(1,)]),
    (3, "proxy", "2024-04-12 07:00:00", []), (3, None, "2024-04-12 07:00:01", [(1,)]),
    (16, "anything", "2024-04-12 07:00:01", [(1,)]), (2, "proxy", "2024-05-12 07:00:01", []),
    (1, None, "2024-05-12 07:00:01", []),
])
def test_suspended_too_long(spark, kind, inter_type, clock, expected):
    known = C.with_classification(
        tickets(spark, ticket(1, STATUS_ID=20), ticket(2, STATUS_ID=20), ticket(3, STATUS_ID=39)),
        classification(spark, [(1, kind), (2, kind), (3, kind)]), types(spark))
    rows = [action(1, 1, "2024-04-05 07:00:00", kind=5), action(2, 1, "2024-04-04 07:00:00", kind=5),
            action(3, 1, "2024-04-11 07:00:00"), action(4, 3, "2024-01-05 07:00:00", kind=5)]
    found = rules.suspended_gt_x(known, actions(spark, *rows), XT.moment(clock), inter_type)
    assert values(found, "AP_SD_REQUEST_ID") == expected
