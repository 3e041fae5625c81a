from __future__ import annotations

import pytest
from helpers import AS_OF, actions, ticket, tickets, values
from pyspark.sql import functions as F

from deskgauge.functions import time as XT
from deskgauge.operators import features, quality, reports, rules, scoring

DAY = 1440
VIP = ("Vip",)
SECURITY, VIP_NAME, INDUSTRIAL = (
    {"CI_ID": 9926}, {"REQUESTOR_LAST_NAME": "Vip"}, {"CI_NAME": "POSTES INDUSTRIELS_ENV"})


def scored(spark, age, last, **values):
    df = features.with_ticket_type(tickets(spark, ticket(1, **values)))
    df = df.withColumns({"C_TICKET_AGE": F.lit(age).cast("bigint"),
                         "C_LAST_ACTION_DATE": F.lit(last).cast("bigint")})
    return scoring.with_score(df, VIP)


def points(spark, age, last, **more):
    return scored(spark, age, last, **more).first()["C_POINTS"]


def kind(is_request):
    return {"RFC_NUMBER": "D1" if is_request else "I1"}


@pytest.mark.parametrize("urgency, request_, status, age, last, more, total", [
    (5, False, 12, 10, 4, {}, 143), (5, True, 5, 10, 4, {}, 14),
    (3, False, 42, 2, 1, SECURITY, 1090), (2, True, 39, 3, 2, VIP_NAME, 880),
    (1, False, 1, 0, 0, INDUSTRIAL, 1500), (4, False, 12, 9, 9, {}, 0),
])
def test_total(spark, urgency, request_, status, age, last, more, total):
    row = {"URGENCY_ID": urgency, "STATUS_ID": status, **kind(request_), **more}
    assert points(spark, age * DAY + 5, last * DAY + 5, **row) == total


def test_a_missing_duration_removes_the_base_too(spark):
    df = scored(spark, None, None, URGENCY_ID=1, **VIP_NAME).first()
    assert df["C_POINTS"] == 0
    assert df["C_POINTS_JUSTIFICATION"] == (
        " // 1000 base + 1000 pt/jour pour Incident-Majeur depuis creation"
        " // +1000 pt/jour pour Incident-Majeur depuis dernière action"
        " // +1000 pt/jour pour Incident-Majeur non suspendu"
        " //  // 1000 base + 100 pts/day ticket VIP depuis dernière action  // ")


def test_texts_of_a_plain_request(spark):
    text = scored(spark, 0, 0, STATUS_ID=20, RFC_NUMBER="D1").first()["C_POINTS_JUSTIFICATION"]
    assert text == (" // +1 pt/jour pour Demande-Normal depuis creation"
                    " // +1 pt/jour pour Demande-Normal depuis dernière action //  //  //  // ")


def test_negative_durations_round_down(spark):
    assert points(spark, -60, 0, STATUS_ID=5) == 1 - 3


def test_status_42_still_scores_as_running(spark):
    assert points(spark, 0, DAY, STATUS_ID=42) == 1 + 3 + 25
    assert points(spark, 0, DAY, STATUS_ID=39) == 1 + 3
    assert points(spark, 0, DAY, STATUS_ID=None) == 1 + 3 + 25


def test_missing_urgency_or_type_scores_nothing(spark):
    assert points(spark, DAY, DAY, URGENCY_ID=None) == 0


def test_total_is_the_sum_of_the_parts(spark):
    rows = [ticket(i, URGENCY_ID=1 + i % 5, STATUS_ID=(5, 12, 39, 42)[i % 4],
                   RFC_NUMBER=("D" if i % 3 else "I") + str(i), COMMENT="vol" if i % 2 else "scada",
                   REQUESTOR_LAST_NAME="Vip" if i % 7 == 0 else "x") for i in range(60)]
    df = features.with_ticket_type(tickets(spark, *rows)).withColumns({
        "C_TICKET_AGE": F.col("AP_SD_REQUEST_ID") * 700,
        "C_LAST_ACTION_DATE": F.when(F.col("AP_SD_REQUEST_ID") % 5 != 0, F.col("AP_SD_REQUEST_ID") * 300)})
    parts = sum((p.points() for p in scoring.components(VIP)), F.lit(0))
    texts = F.concat(*[F.concat(F.lit(" // "), p.text()) for p in scoring.components(VIP)])
    found = scoring.with_score(df, VIP)
    assert values(found, "AP_SD_REQUEST_ID", "C_POINTS", "C_POINTS_JUSTIFICATION") == values(
        df, "AP_SD_REQUEST_ID", parts, texts)


def test_columns_are_required(spark):
    plain = tickets(spark, ticket(1))
    for column, operator in (
            ("C_LAST_ACTION_DATE", lambda: scoring.with_score(features.with_ticket_type(plain))),
            ("C_START_DATE", lambda: features.with_age(plain, XT.moment(AS_OF))),
            ("C_POINTS", lambda: reports.total_score(plain)),
            ("AP_INTERVENTION_TYPE", lambda: rules.suspended_gt_x(
                plain, actions(spark), XT.moment(AS_OF)))):
        with pytest.raises(quality.MissingColumns, match=column):
            operator()


# Fixed values, apart from the package's constants: urgency, whether a request, name,
# base and points a day since creation, points a day since the last action and running.
RATES = [
    (5, True, "Demande-Normal", 0, 1, 1, 10),
    (5, False, "Incident-Normal", 1, 3, 3, 25),
    (3, True, "Demande-Sensible", 3, 3, 3, 25),
    (3, False, "Incident-Sensible", 10, 10, 10, 50),
    (2, True, "Demande-Important", 30, 30, 30, 50),
    (2, False, "Incident-Important", 100, 100, 100, 100),
    (1, True, "Demande-Majeur", 300, 300, 300, 300),
    (1, False, "Incident-Majeur", 1000, 1000, 1000, 1000),
]


@pytest.mark.parametrize("urgency, request_, name, base, created, last, running", RATES)
def test_rates_and_texts(spark, urgency, request_, name, base, created, last, running):
    row = scored(spark, 2 * DAY, 3 * DAY, URGENCY_ID=urgency, **kind(request_), **SECURITY).first()
    assert row["C_POINTS"] == base + 2 * created + 3 * last + 3 * running + 1000
    lead = "+" if urgency == 5 else f"{base} base + "
    assert row["C_POINTS_JUSTIFICATION"] == (
        f" // {lead}{created} pt/jour pour {name} depuis creation"
        f" // +{last} pt/jour pour {name} depuis dernière action"
        f" // +{running} pt/jour pour {name} non suspendu"
        " // +1000 pts ticket sécurité  //  // ")


def test_age_reads_one_clock(spark):
    df = features.with_start_date(tickets(spark, ticket(1, SUBMIT_DATE_UT="2024-04-08 10:00:29")))
    assert features.with_age(df, XT.moment(AS_OF)).first()["C_TICKET_AGE"] == 2 * DAY
