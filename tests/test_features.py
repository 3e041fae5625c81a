from __future__ import annotations

import datetime as dt

import pytest
from helpers import AS_OF, action, actions, ticket, tickets, values

from deskgauge import schemas
from deskgauge.functions import time as XT
from deskgauge.operators import features, joins


def now():
    return XT.moment(AS_OF)


def test_first_known_value_per_column(spark):
    df = features.with_technician(tickets(spark, ticket(1)), actions(
        spark,
        action(1, 1, None, done_by="x"),
        action(2, 1, "2024-01-03 00:00:00", done_by=None, GROUP_FR=None),
        action(3, 1, "2024-01-01 00:00:00", done_by="z"),
        action(4, 1, "2024-01-05 00:00:00", kind=18, done_by="not an assignment"),
    ))
    assert values(df, "AP_AM_START_DATE", "AP_AM_DONE_BY_OPERATOR_NAME", "AP_AM_ACTION_ID") == [
        (dt.datetime(2024, 1, 3), "x", 1)]


def test_open_action_without_name_leaves_it_to_the_next(spark):
    df = features.with_technician(tickets(spark, ticket(1), ticket(2)), actions(
        spark,
        action(1, 1, None, done_by=None, GROUP_FR=None),
        action(2, 1, "2024-01-03 00:00:00", done_by="newest"),
        action(3, 1, "2024-01-01 00:00:00", done_by="oldest"),
    ))
    assert values(df, "AP_SD_REQUEST_ID", "AP_AM_DONE_BY_OPERATOR_NAME", "AP_AM_ACTION_ID") == [
        (1, "newest", 1), (2, None, None)]


def test_technician_filter_ignores_case_and_drops_unassigned(spark):
    df = features.with_technician(
        tickets(spark, ticket(1), ticket(2), ticket(3)),
        actions(spark, action(1, 1, done_by="Éloi"), action(2, 2, done_by="Zoé")), "éLOI|abc")
    assert values(df, "AP_SD_REQUEST_ID") == [(1,)]


def test_last_action_is_the_first_unless_asked(spark):
    rows = (action(1, 1, "2024-04-09 10:00:00"), action(2, 1, "2024-04-10 09:59:30", kind=61),
            action(3, 1, "2024-04-01 10:00:00", kind=107), action(4, 1, None))
    args = tickets(spark, ticket(1), ticket(2)), actions(spark, *rows), now()
    assert values(features.with_last_action(*args), "AP_SD_REQUEST_ID", "C_LAST_ACTION_DATE") == [
        (1, 1440), (2, None)]
    assert values(features.with_last_action(*args, "latest"),
                  "AP_SD_REQUEST_ID", "C_LAST_ACTION_DATE") == [(1, 0), (2, None)]


def test_actions_without_type_count_as_work(spark):
    df = features.with_last_action(
        tickets(spark, ticket(1)), actions(spark, action(1, 1, "2024-04-09 10:00:00", kind=None)), now())
    assert values(df, "C_LAST_ACTION_DATE") == [(1440,)]


def test_ticket_type(spark):
    df = features.with_ticket_type(tickets(
        spark, ticket(1, RFC_NUMBER="D1"), ticket(2, RFC_NUMBER="I1"), ticket(3, RFC_NUMBER=None)))
    assert values(df, "AP_SD_REQUEST_ID", "C_TICKET_TYPE", "C_TICKET_TYPE_STRING_FR") == [
        (1, 1, "Demande"), (2, 0, "Incident"), (3, 0, "Incident")]


def test_rdv_state(spark):
    def note(number, request, text, kind=108):
        return action(number, request, kind=kind, DESCRIPTION=text)

    df = features.with_rdv(tickets(spark, *[ticket(i) for i in range(1, 7)]), actions(
        spark,
        note(1, 1, "#tagp# rdv:01/04/2024"), note(2, 1, "#tagp# rdv:12/04/2024", 65),
        note(3, 2, "#tagp# rdv:31/02/2024"), note(4, 2, "#tagp# rdv:09/04/2024"),
        note(5, 3, "#tagp# rdv:bientôt"), note(6, 4, "#tagp# rdv:12/04/2024", 20),
        note(7, 5, "rdv:12/04/2024"),
    ), now())
    assert values(df, "AP_SD_REQUEST_ID", "C_RDV_STATE", "C_RDV_DATE") == [
        (1, "RDV - en cours", dt.datetime(2024, 4, 12)),
        (2, "RDV - en retard", dt.datetime(2024, 4, 9)),
        (3, "RDV - date invalide", None), (4, "Pas de RDV", None),
        (5, "Pas de RDV", None), (6, "Pas de RDV", None)]


@pytest.mark.parametrize("clock, state", [
    ("2024-04-09 23:59:59", "RDV - en cours"), ("2024-04-10 00:00:00", "RDV - en retard"),
    ("2024-04-10 00:00:01", "RDV - en retard"),
])
def test_rdv_turns_late_at_midnight_utc(spark, clock, state):
    df = features.with_rdv(
        tickets(spark, ticket(1)),
        actions(spark, action(1, 1, kind=65, DESCRIPTION="#tagp# rdv:10/04/2024")), XT.moment(clock))
    assert values(df, "C_RDV_STATE") == [(state,)]


def test_observation_age(spark):
    df = features.observation_age(tickets(spark, ticket(1), ticket(2)), actions(
        spark, action(1, 1, "2024-04-10 08:00:00", kind=108),
        action(2, 1, "2024-04-09 08:00:00", kind=108), action(3, 1, "2024-04-10 09:00:00", kind=65),
    ), now())
    assert values(df, "AP_SD_REQUEST_ID", "C_LAST_ACTION_DATE") == [(1, 120), (2, None)]


def test_pivot_falls_back_to_the_raw_answer(spark):
    answers = spark.createDataFrame([
        (1, "D1", 5535, 45, "raw", "nom"), (1, "D1", 5535, 58, "Oui", None),
        (2, "D2", 5535, 49, None, None)], schemas.ANSWERS)
    assert values(features.pivot_answers(answers), "REQUEST_ID", "NOM", "TELEPHONE", "CONTRACT") == [
        (1, "nom", "Oui", None), (2, None, None, None)]


def test_one_ticket_with_most_actions(spark):
    rows = [action(i, 1, f"2024-03-{1 + i % 28:02d} 08:00:00", done_by=f"t{i}") for i in range(500)]
    df = features.with_technician(
        tickets(spark, ticket(1), ticket(2)), actions(spark, *rows, action(900, 2, None, done_by="u")))
    newest = max(i for i in range(500) if i % 28 == 27)
    assert values(df, "AP_SD_REQUEST_ID", "AP_AM_DONE_BY_OPERATOR_NAME") == [
        (1, f"t{newest}"), (2, "u")]


def test_merge_refuses_shared_columns(spark):
    left = spark.createDataFrame([(1, 2)], "a int, x int")
    right = spark.createDataFrame([(1, 3)], "b int, x int")
    with pytest.raises(joins.ColumnCollision, match="x"):
        joins.merge(left, right, "a", "b")
    assert joins.merge(left, right.drop("x"), "a", "b").columns == ["a", "x", "b"]
