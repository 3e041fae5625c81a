from __future__ import annotations

import dataclasses
import json

import pytest
from helpers import AS_OF, action, desk, ticket, values
from pyspark.sql import functions as F

from deskgauge.operators import events, reports
from deskgauge.plans import flows
from deskgauge.sources import sinks


def test_row_list(spark):
    found = flows.ticket_flow_rows(desk(
        spark, [ticket(1, STATUS_FR="Ouvert", COMMENT="<b>Bonjour</b> tablette"), ticket(2, URGENCY_ID=3)],
        [action(1, 1, "2024-04-08 09:00:00", done_by="Zoé"),
         action(2, 1, kind=65, DESCRIPTION="#tagp# rdv:12/04/2024")],
        [(1, 2)]))
    assert found.columns == list(reports.ROW_COLUMNS.values())
    first, second = found.orderBy("AP_SD_REQUEST_ID").collect()
    assert first["SPOT"] == "I000001" and first["Location"] == "DRS Jean Bart"
    assert first["C_RDV_DATE"] == "1712883600000" and first["C_RDV_STATE"] == "RDV - en cours"
    assert first["Inter_Type"] == "Type 2" and first["Score"] == 31 + 6 + 50 + 500
    assert first["AP_AM_DONE_BY_OPERATOR_NAME"] == "Zoé" and first["Priorite"] == "4-Normal"
    assert second["C_RDV_DATE"] == "" and second["AP_INTERVENTION_TYPE"] == 1
    assert second["Score"] == 110 and second["AP_SD_REQUEST_ID"] == "2"


def test_tables_keep_their_header(spark, tmp_path):
    inputs = desk(spark, [ticket(i, STATUS_ID=39, MAX_RESOLUTION_DATE_UT=f"2024-05-{1 + i % 28:02d} 08:00:00")
                          for i in range(40)],
                  [action(i, i, "2024-01-08 09:00:00", done_by=f"t{i}") for i in range(40)])
    table = flows.suspended_mail_table(inputs)
    assert reports.header(table) == [
        {"col_order": 0, "name": "Ticket", "id": "AP_SD_RFC_NUMBER"},
        {"col_order": 1, "name": "Type", "id": "AP_TYPE_FR"},
        {"col_order": 2, "name": "Location", "id": "AP_SD_RECIPIENT_LOCATION_RH"},
        {"col_order": 3, "name": "Technician", "id": "AP_AM_DONE_BY_OPERATOR_NAME"}]
    shown = json.loads(sinks.table_json(table))
    assert len(shown["data"]) == 25 and shown["columns"][0]["name"] == "Ticket"
    assert [r["AP_SD_RFC_NUMBER"] for r in shown["data"][:3]] == ["I000000", "I000028", "I000001"]
    assert shown["data"][1]["AP_AM_DONE_BY_OPERATOR_NAME"] == "t28"
    with pytest.raises(sinks.TooManyRows):
        sinks.table_json(table, rows=24)
    sinks.write_table(table, str(tmp_path / "table"))
    (line,) = spark.read.text(str(tmp_path / "table/header")).collect()
    assert json.loads(line["value"]) == reports.header(table)
    assert spark.read.json(str(tmp_path / "table/rows")).count() == 25
    filtered = flows.suspended_mail_table(inputs, "^t2.$")
    assert {r[0] for r in filtered.select("AP_AM_DONE_BY_OPERATOR_NAME").collect()} == {
        f"t{i}" for i in range(20, 30)}


def test_expiration_table(spark):
    inputs = desk(spark, [
        ticket(1, MAX_RESOLUTION_DATE_UT="2024-07-01 22:30:00"),
        ticket(2, MAX_RESOLUTION_DATE_UT="2024-05-01 08:00:00"),
        ticket(3, MAX_RESOLUTION_DATE_UT="2024-04-01 08:00:00"), ticket(4),
        ticket(5, MAX_RESOLUTION_DATE_UT="2024-05-01 08:00:00", STATUS_ID=42)], [], [(1, 2)])
    table = flows.tickets_by_expiration(inputs)
    assert [tuple(r) for r in table.collect()] == [
        ("I000002", "Type 1", "DRS Jean Bart", None, "01/05/24 10:00"),
        ("I000001", "Type 2", "DRS Jean Bart", None, "02/07/24 00:30")]
    assert reports.header(table)[-1] == {
        "col_order": 4, "name": "SLA", "id": "AP_SD_MAX_RESOLUTION_DATE"}
    assert flows.tickets_by_expiration(inputs, segment="hotline").count() == 1


def test_technician_table(spark):
    table = flows.technician_table(desk(
        spark, [ticket(i, STATUS_ID=5) for i in (1, 2, 3)],
        [action(1, 1, "2024-04-09 10:00:00", done_by="b"), action(2, 2, "2024-04-09 10:00:00", done_by="a"),
         action(3, 3, "2024-04-08 10:00:00", done_by="b")]))
    # Age 10 days: 31 points each, plus 3 a day since the first action.
    assert [tuple(r) for r in table.collect()] == [("a", 1, 34), ("b", 2, 31 + 3 + 31 + 6)]
    assert [h["name"] for h in reports.header(table)] == ["Technicien", "Total", "Score"]


def test_indicators_of_nothing(spark):
    empty = desk(spark, [], [])
    assert values(flows.ticket_flow_score(empty)) == [(0,)]
    assert values(flows.ticket_flow_count(empty)) == [(0,)]


def test_counts_order(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("c",)], "v string")
    assert [tuple(r) for r in reports.counts_by(df, "v").collect()] == [
        ("c", 2), ("a", 1), ("b", 1), (None, 1)]


@pytest.mark.parametrize("numbers, step", [
    (range(0, 101), 2.0), (range(0, 41), 1.0), (range(0, 201), 5.0), ([3, 3, None], 1.0),
    ([0, 0.5], 0.01), ([0, 500], 10.0), ([-30, 70], 2.0),
])
def test_histogram(spark, numbers, step):
    df = spark.createDataFrame([(None if n is None else float(n),) for n in numbers], "v double")
    rows = reports.histogram(df, F.col("v")).collect()
    known = [n for n in numbers if n is not None]
    assert sum(r["total"] for r in rows) == len(known)
    assert all(r["bin_end"] - r["bin_start"] == pytest.approx(step) for r in rows)
    assert rows[0]["bin_start"] <= min(known) < rows[0]["bin_end"]
    assert len(rows) <= reports.MAX_BINS + 1


def test_first_rows(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("n"), F.col("id")).repartition(5)
    assert [tuple(r) for r in reports.first_rows(df, "n", "id", 3).collect()] == [
        (0, 0, 1), (0, 7, 2), (0, 14, 3)]
    assert reports.first_rows(df, "n", "id").count() == 24


def test_employee_events(spark):
    people = spark.createDataFrame([
        ("D1", 5535, "dupont", "jean-pierre", "CNR SIEGE SOCIAL", "CDI", "31/12/2021", "Non", None),
        ("D2", 5535, "ñandú", "o'neil", None, None, "31/02/2021", "Oui", "Oui"),
        ("D3", 5535, None, "x", "ici", None, None, "Oui", "Non"),
        ("D4", 1, "a", "b", "ici", None, None, None, None),
    ], "RFC_NUMBER string, SD_CATALOG_ID bigint, NOM string, PRENOM string, LOCATION string, "
       "CONTRACT string, ARRIVAL_DATE string, PC_PRESENT string, TELEPHONE string")
    found = {r["extendedProps"]["SPOT"]: r for r in events.employee_events(people).collect()}
    assert found["D1"]["title"] == "D1 - DUPONT, Jean-Pierre - DM Siege - PC:1 Tel:0"
    assert found["D1"]["start"] == found["D1"]["extendedProps"]["Arrivée"] == "2021-12-31"
    assert found["D2"]["title"] == "D2 - ÑANDÚ, O'Neil - Pas de location - PC:0 Tel:1"
    assert found["D2"]["start"] is None
    assert found["D3"]["title"] is None
    assert [found[k]["color"] for k in ("D1", "D2", "D3", "D4")] == ["blue", "blue", "green", "blue"]


def test_rdv_events(spark, tmp_path):
    note = "#tagp# rdv:12/04/2024"
    inputs = desk(spark, [
        ticket(1, RECIPIENT_LOCATION_RH="CNR SIEGE SOCIAL"), ticket(2, RECIPIENT_LOCATION_RH=None),
        ticket(3), ticket(4, RECIPIENT_LOCATION_RH="Paris 12")],
        [action(i, i, kind=65, DESCRIPTION=note) for i in (1, 2, 4)])
    found = {r["extendedProps"]["SPOT"]: r for r in flows.rdv_calendar(inputs).collect()}
    assert sorted(found) == ["I000001", "I000002", "I000004"]
    assert found["I000001"]["title"] == "I000001 - Martin, CNR SIEGE SOCIAL - Type 1"
    assert found["I000001"]["extendedProps"]["Location"] == "DM Siege"
    assert [found[k]["color"] for k in sorted(found)] == ["#F1C40F", "#FC0B03", "#34495E"]
    assert found["I000001"]["start"] == "2024-04-12"
    sinks.write_events(flows.rdv_calendar(inputs), str(tmp_path / "events"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "events")).collect()]
    assert {e["extendedProps"]["Ticket type"] for e in lines} == {"Type 1"}


def test_every_suspended_set_is_its_own(spark):
    inputs = desk(spark, [ticket(i, STATUS_ID=s) for i, s in enumerate((5, 20, 39, 42, 12))], [])
    assert AS_OF and values(flows.not_suspended_count(inputs)) == [(1,)]


def test_a_desk_has_one_clock(spark):
    inputs = desk(spark, [], [])
    assert str(inputs.now) == str(inputs.as_of)
    timeless = dataclasses.replace(inputs, as_of=None)
    assert timeless.now is timeless.as_of is not None
