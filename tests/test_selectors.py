from __future__ import annotations

import pytest
from helpers import AS_OF, action, actions, classification, ticket, tickets, types, values
from pyspark.sql import functions as F

from deskgauge import constants as K
from deskgauge.functions import time as XT
from deskgauge.operators import classification as C
from deskgauge.operators import features
from deskgauge.operators import selectors as S

NOTHING = {"COMMENT": None, "CI_ID": None, "CI_NAME": None, "SD_CATALOG_ID": None,
           "STATUS_ID": None, "URGENCY_ID": None, "REQUESTOR_LAST_NAME": None,
           "RECIPIENT_LAST_NAME": None}


@pytest.mark.parametrize("predicate, fitting", [
    (S.is_security, {"CI_ID": 8696}), (S.is_security, {"COMMENT": "vol!"}),
    (S.is_industrial, {"CI_NAME": "Mustang_Mobilité_ENV"}), (S.is_industrial, {"COMMENT": "SCADA"}),
    (S.is_digipass, {"CI_NAME": "Azure.Microsoft"}), (S.is_digipass, {"COMMENT": "f5 big-ip"}),
    (S.is_skype, {"CI_NAME": "SKYPE_ENV"}), (S.is_outlook, {"CI_NAME": "OFFICE_APP"}),
    (S.is_telephone, {"CI_NAME": "TELEPHONIE_MOBILE_ENV"}),
    (S.is_software_install, {"SD_CATALOG_ID": 5617}), (S.is_new_arrival, {"SD_CATALOG_ID": 5535}),
    (S.is_urgent, {"URGENCY_ID": 2}), (S.is_suspended_by_mail, {"STATUS_ID": 42}),
    (S.is_suspended_by_technician, {"STATUS_ID": 20}),
    (lambda: S.is_about(["Léa", "Paul"]), {"REQUESTOR_LAST_NAME": "Léa"}),
    (lambda: S.is_about(["Lea", "Paul"]), {"RECIPIENT_LAST_NAME": "Léa"}),
])
def test_predicates_are_never_null(spark, predicate, fitting):
    df = tickets(spark, ticket(1, **NOTHING), ticket(2, **(NOTHING | fitting)))
    assert values(df, "AP_SD_REQUEST_ID", predicate()) == [(1, False), (2, True)]
    assert values(df.filter(~predicate()), "AP_SD_REQUEST_ID") == [(1,)]


def test_a_missing_status_is_not_suspended(spark):
    df = tickets(spark, *[ticket(i, STATUS_ID=s) for i, s in enumerate([None, 5, 20, 39, 42, 12])])
    assert values(df.filter(S.is_not_suspended()), "AP_SD_REQUEST_ID") == [(0,), (5,)]


def test_catalog_list():
    assert len(set(K.CATALOG_SOFTWARE_INSTALL)) == 47


def test_nobody_is_listed(spark):
    assert values(tickets(spark, ticket(1)).filter(S.is_about(())), "AP_SD_REQUEST_ID") == []


def test_unexpired(spark):
    df = tickets(
        spark, ticket(1, MAX_RESOLUTION_DATE_UT="2024-04-10 10:00:01"),
        ticket(2, MAX_RESOLUTION_DATE_UT="2024-04-10 10:00:00"), ticket(3),
        ticket(4, MAX_RESOLUTION_DATE_UT="2024-04-11 10:00:00", STATUS_ID=5))
    assert values(df.filter(S.is_unexpired(XT.moment(AS_OF))), "AP_SD_REQUEST_ID") == [(1,)]


def test_segments(spark):
    df = features.with_ticket_type(tickets(
        spark, ticket(1), ticket(2, RFC_NUMBER="D2"), ticket(3), ticket(4, RFC_NUMBER="D4"),
        ticket(5, STATUS_ID=5)))
    df = C.with_classification(df, classification(spark, [(1, 2), (2, 2), (3, 3), (4, 16)]), types(spark))

    def ids(segment, **more):
        return [i for i, in values(S.ticket_flow(df, segment, **more), "AP_SD_REQUEST_ID")]

    assert {name: ids(name) for name in S.SEGMENTS} == {
        "hotline": [1, 2], "proxy": [3, 4], "unclassified": [5], "incident": [1, 3, 5],
        "request": [2, 4], "incident+hotline": [1], "incident+proxy": [3],
        "request+hotline": [2], "request+proxy": [4]}
    assert ids(None) == ids("other") == [1, 2, 3, 4, 5]
    assert ids(None, suspended=False) == [1, 2, 3, 4]
    assert ids(None, suspended=True) == [1, 2, 3, 4, 5]


def test_under_observation(spark):
    notes = actions(
        spark, action(1, 1, kind=65, DESCRIPTION="x #tagp# sousobservation"),
        action(2, 1, kind=108, DESCRIPTION="#tagp# sousobservation"),
        action(3, 2, kind=20, DESCRIPTION="#tagp# sousobservation"),
        action(4, 3, kind=65, DESCRIPTION="#tagp# autre"), action(5, 4, kind=65))
    df = S.under_observation(tickets(spark, *[ticket(i) for i in range(1, 5)]), notes)
    assert values(df, "AP_SD_REQUEST_ID") == [(1,)]


def test_contact_action_without_label(spark):
    df = actions(spark, action(1, 1, "2024-01-01 00:00:00", ACTION_LABEL_FR=None),
                 action(2, 1, ACTION_LABEL_FR="notification au DEMANDEUR"))
    assert values(df, "AP_AM_ACTION_ID", S.is_contact_action()) == [(1, False), (2, True)]


def test_dated_rdv(spark):
    df = spark.createDataFrame([(K.RDV_LATE,), (K.RDV_PENDING,), (K.RDV_NONE,), (None,)], "C_RDV_STATE string")
    assert df.filter(S.has_dated_rdv()).count() == 2
    assert df.filter(~S.has_dated_rdv()).count() == 2
    assert df.select(F.count(S.has_dated_rdv())).first()[0] == 4
