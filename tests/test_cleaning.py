from __future__ import annotations

import datetime as dt

from helpers import action, actions, raw_actions, raw_tickets, ticket, tickets, values

from deskgauge import schemas
from deskgauge.operators import cleaning


def test_ticket_columns_are_renamed_and_typed(spark):
    df = tickets(spark, ticket(1, SUBMIT_DATE_UT="2021-07-01 00:00:00", OWNER_LAST_NAME="o"))
    assert "REQUESTOR_LAST_NAME" in df.columns and "OWNER_LAST_NAME" in df.columns
    assert "LAST_UPDATE" in df.columns and "AP_SD_MATERIAL_NAME" in df.columns
    assert len(df.columns) == len(schemas.TICKETS.names)
    assert df.first()["AP_SD_SUBMIT_DATE_UT"] == dt.datetime(2021, 7, 1)


def test_fills_and_sentinels(spark):
    df = tickets(
        spark,
        ticket(1, RECIPIENT_LAST_NAME=None, RECIPIENT_LOCATION_RH=None, COMMENT="N/A"),
        ticket(2, RECIPIENT_LAST_NAME="Bérénice", URGENCY_FR="2-Important",
               ASSET_TAG="<NA>", COMMENT="<p>Bonjour, panne</p>"),
    )
    assert values(df, "AP_SD_REQUEST_ID", "AP_SD_RECIPIENT_LAST_NAME",
                  "AP_SD_RECIPIENT_LOCATION_RH", "AP_SD_URGENCY", "AP_SD_MATERIAL_NAME",
                  "AP_SD_COMMENT") == [
        (1, "N/A", "Pas de location", "4-Normal", None, None),
        (2, "Berenice", "CNR JEAN BART", "2-Important", None, " panne"),
    ]


def test_action_columns(spark):
    df = actions(spark, action(1, 2, "2021-01-01 08:00:00"))
    assert len(df.columns) == len(schemas.ACTIONS.names)
    assert {"AP_AM_START_DATE", "AP_AM_END_DATE_UT", "AP_AM_OPERATION_TYPE_NAME",
            "AP_AM_DONE_BY_OPERATOR_NAME", "AP_AM_LAST_UPDATE"} <= set(df.columns)


def test_empty_actions_are_dropped_and_names_filled(spark):
    df = actions(
        spark,
        action(1, 1, None, done_by=" ", ACTION_LABEL_FR=""),
        action(2, 1, None, done_by="", ACTION_LABEL_FR="x"),
        action(3, 1, "2021-01-01 08:00:00", done_by=None, ACTION_LABEL_FR=None, GROUP_FR=None),
    )
    assert values(df, "AP_AM_ACTION_ID", "AP_AM_DONE_BY_OPERATOR_NAME") == [
        (2, "Hotline"), (3, None)]


def test_an_unreadable_start_still_counts_as_present(spark):
    row = action(1, 1, done_by=None, ACTION_LABEL_FR=None) | {"START_DATE_UT": "bientôt"}
    assert values(actions(spark, row), "AP_AM_ACTION_ID", "AP_AM_START_DATE") == [(1, None)]


def test_own_date_format(spark):
    row = action(1, 1) | {"START_DATE_UT": "01/02/2021 10:30"}
    df = cleaning.clean_actions(raw_actions(spark, row), "dd/MM/yyyy HH:mm")
    assert df.first()["AP_AM_START_DATE"] == dt.datetime(2021, 2, 1, 10, 30)


def test_known_bad_requests(spark):
    df = cleaning.drop_known_bad_tickets(tickets(spark, ticket(188214), ticket(185394), ticket(1)))
    assert values(df, "AP_SD_REQUEST_ID") == [(1,)]
    df = cleaning.drop_known_bad_actions(actions(spark, action(1, 188214), action(2, None)))
    assert values(df, "AP_AM_ACTION_ID") == [(2,)]


def test_narrow_input_is_enough(spark):
    df = raw_tickets(spark, ticket(1)).select("REQUEST_ID", "RFC_NUMBER")
    assert cleaning.clean_tickets(df.withColumnRenamed("RFC_NUMBER", "COMMENT")).columns == [
        "AP_SD_REQUEST_ID", "AP_SD_COMMENT"]


def test_columns_of_others_keep_their_name(spark):
    df = raw_actions(spark, action(1, 1)).withColumnRenamed("EXIT_VALUE", "OTHER")
    assert "OTHER" in cleaning.clean_actions(df).columns
