from __future__ import annotations

import datetime as dt
from unittest import mock

import pytest
from pyspark.sql import functions as F
from helpers import action, classification, desk, raw_tickets, ticket, tickets, types, values

from checks import adapter
from conftest import SMALL
from deskgauge import schemas
from deskgauge.operators import classification as C
from deskgauge.operators import cleaning, quality
from deskgauge.plans import flows
from deskgauge.sources import extracts, readers, sinks, snapshots


def test_unseen_tickets_are_unclassified(spark):
    known = classification(spark, [(1, 4), (2, 99)])
    found = C.with_classification(tickets(spark, ticket(1), ticket(2), ticket(3)), known, types(spark))
    assert values(found, "AP_SD_REQUEST_ID", "AP_INTERVENTION_TYPE", "AP_TYPE_FR") == [
        (1, 4, "Type 4"), (2, 99, None), (3, 1, "Type 1")]
    missing = C.missing_rows(tickets(spark, ticket(1), ticket(3)), known)
    assert missing.columns == schemas.CLASSIFICATION.names
    assert values(missing) == [(None, 3, "I000003", 1)]
    assert C.complete(tickets(spark, ticket(1), ticket(3)), known).count() == 3


def test_type_changes(spark):
    day = dt.datetime(2024, 1, 1)
    updates = spark.createDataFrame([
        (1, "Type 5", day), (1, "Type 6", day + dt.timedelta(hours=1)),
        (2, "Type 7", day), (2, "unknown", day + dt.timedelta(hours=1)), (9, "Type 2", day),
        (4, "Type 8", day),
    ], schemas.TYPE_UPDATES)
    stored = classification(spark, [(1, 2), (2, 2), (3, 2)])
    # Ticket 4 is shown as type 1 without a stored row, twice in the extract.
    open_tickets = tickets(spark, ticket(1), ticket(4), ticket(4), ticket(5))
    change = C.change_types(stored, types(spark), updates, open_tickets)
    assert values(change.classification, "AP_REQUEST_ID", "AP_INTERVENTION_TYPE") == [
        (1, 6), (2, 7), (3, 2), (4, 8), (5, 1)]
    assert values(change.rejects, "AP_REQUEST_ID", "AP_TYPE_FR", "reason") == [
        (2, "unknown", "unknown type"), (9, "Type 2", "unknown request")]


def test_one_row_per_request(spark):
    rows = [(None, 1, "I1", 9), (4, 1, "I1", 2), (3, 1, "I1", 5), (None, 2, None, 3), (None, 2, None, 4)]
    stored = spark.createDataFrame(rows, schemas.CLASSIFICATION)
    assert values(C.one_per_request(stored), "AP_REQUEST_ID", "id", "AP_INTERVENTION_TYPE") == [
        (1, 4, 2), (2, None, 4)]


def test_stored_classification(spark, tmp_path):
    store = snapshots.VersionStore(spark, str(tmp_path))
    kind = snapshots.CLASSIFICATION
    assert store.latest(kind) is None
    base = store.write(
        {"classification": classification(spark, [(1, 2)])}, kind, dt.datetime(2024, 1, 1))
    now = tickets(spark, ticket(1), ticket(2), ticket(2))
    first = snapshots.complete_classification(store, base, now)
    stored = store.read(first, "classification")
    assert values(stored, "AP_REQUEST_ID", "AP_INTERVENTION_TYPE") == [(1, 2), (2, 1)]
    assert values(store.read(base, "classification"), "AP_REQUEST_ID") == [(1,)]
    updates = spark.createDataFrame([(2, "Type 3", None), (3, "Type 4", None)], schemas.TYPE_UPDATES)
    more = tickets(spark, ticket(3))
    second, rejects = snapshots.change_stored_types(store, first, types(spark), updates, more)
    assert store.latest(kind) == second and rejects.count() == 0
    assert values(store.read(second, "classification"), "AP_REQUEST_ID", "AP_INTERVENTION_TYPE") == [
        (1, 2), (2, 3), (3, 4)]
    assert values(store.read(first, "classification"), "AP_INTERVENTION_TYPE") == [(1,), (2,)]
    with pytest.raises(snapshots.StaleVersion):
        snapshots.change_stored_types(store, first, types(spark), updates, more)
    assert store.latest(kind) == second


def test_one_of_two_overlapping_changes_is_refused(spark, tmp_path):
    store, kind = snapshots.VersionStore(spark, str(tmp_path)), snapshots.CLASSIFICATION
    day = dt.datetime(2024, 1, 2)
    rows = {"classification": classification(spark, [(1, 2)])}
    base = store.write(rows, kind, day)
    # Its clock runs behind; it is the latest all the same.
    first = store.succeed(base, rows, kind, day - dt.timedelta(days=1))
    with pytest.raises(snapshots.StaleVersion):
        store.succeed(base, rows, kind, day + dt.timedelta(days=1))
    assert store.latest(kind) == first
    second = store.succeed(first, rows, kind, day)
    assert store.latest(kind) == second
    assert not list((tmp_path / "drafts").glob("[!.]*"))


def test_a_driver_lost_before_the_listing_changes_nothing(spark, tmp_path, monkeypatch):
    store, kind = snapshots.VersionStore(spark, str(tmp_path)), snapshots.CLASSIFICATION
    rows = {"classification": classification(spark, [(1, 2)])}
    base = store.write(rows, kind)

    def lost(*_):
        raise SystemError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(snapshots.VersionStore, "_list", lost)
        with pytest.raises(SystemError):
            store.succeed(base, rows, kind)
    assert store.latest(kind) == base
    assert store.latest(kind) != store.succeed(base, rows, kind) != base


def test_bucketed_frames_are_known_to_other_sessions(spark, tmp_path):
    store = snapshots.VersionStore(spark, str(tmp_path))
    frame = classification(spark, [(i, 2) for i in range(50)])
    written = store.put_bucketed("v-1", "classification", frame, "AP_REQUEST_ID", 4)
    spark.sql("DROP TABLE desk_v1_classification")
    again = store.read("v-1", "classification")
    assert values(written.sparkSession.table("desk_v1_classification")) == values(frame) == values(again)
    plan = again.groupBy("AP_REQUEST_ID").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    spark.sql("DROP TABLE desk_v1_classification")


def test_a_request_with_most_actions_is_not_bucketed(spark):
    even = spark.range(1000).select(F.col("id").alias("k"))
    assert snapshots.evenly_bucketed(even, "k", 8)
    hot = even.union(spark.range(500).select(F.lit(7).cast("bigint")))
    assert not snapshots.evenly_bucketed(hot, "k", 8)
    assert snapshots.evenly_bucketed(even.limit(0), "k", 8)


def test_kinds_share_a_store(spark, tmp_path):
    """A type change after a snapshot does not hide the extracts."""
    store = snapshots.VersionStore(spark, str(tmp_path))
    source = adapter.service_desk(spark, SMALL)
    start, minute = dt.datetime(2024, 1, 1, 10), dt.timedelta(minutes=1)
    taken = snapshots.take_snapshot(store, source, 60 * minute, start)
    changed = store.write({"classification": classification(spark, [(1, 2)])},
                          snapshots.CLASSIFICATION, start + minute)
    again = snapshots.take_snapshot(store, source, 60 * minute, start + 5 * minute)
    assert again == taken and store.read(again, "tickets").count() > 0
    assert store.latest(snapshots.CLASSIFICATION) == changed
    for name in extracts.LOOKUPS:
        assert store.read(taken, name).count() == getattr(source, name).count()


def test_snapshot_is_reused_until_it_expires(spark, tmp_path):
    store = snapshots.VersionStore(spark, str(tmp_path))
    source = adapter.service_desk(spark, SMALL)
    start, hour = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    first = snapshots.take_snapshot(store, source, hour, start)
    assert snapshots.take_snapshot(store, source, hour, start + hour / 2) == first
    second = snapshots.take_snapshot(store, source, hour, start + 2 * hour)
    assert second != first and store.latest(snapshots.EXTRACT) == second
    taken = store.read(second, "tickets")
    assert [(f.name, f.dataType) for f in taken.schema] == [
        (f.name, f.dataType) for f in schemas.TICKETS]
    wanted = {r[0] for r in taken.select("REQUEST_ID").collect()}
    with_actions = {r[0] for r in store.read(second, "actions").select("REQUEST_ID").distinct().collect()}
    assert wanted & with_actions


def test_delimited_source(spark, tmp_path):
    path = tmp_path / "SD_REQUEST.csv"
    header = ";".join(schemas.TICKETS.names)
    row = {name: "" for name in schemas.TICKETS.names}
    row |= {"REQUEST_ID": "7", "RFC_NUMBER": "I7", "SUBMIT_DATE_UT": "2021-07-01 00:00:00.000000",
            "COMMENT": '"<p>ligne 1\nligne ""2""; fin</p>"'}
    path.write_text(header + "\n" + ";".join(row.values()) + "\n", encoding="utf-8")
    df = cleaning.clean_tickets(readers.read_delimited(spark, str(path), schemas.TICKETS, multi_line=True))
    assert values(df, "AP_SD_REQUEST_ID", "AP_SD_COMMENT", "AP_SD_SUBMIT_DATE_UT") == [
        (7, 'ligne 1\nligne "2"; fin', dt.datetime(2021, 7, 1))]


def test_records_run_a_flow(spark):
    inputs = desk(spark, [ticket(1), ticket(2, RFC_NUMBER="D2")],
                  [action(1, 1, "2024-04-01 10:00:00")], [(2, 2)])
    assert values(flows.ticket_flow_count(inputs)) == [(2,)]
    assert values(flows.ticket_flow_count(inputs, "request+hotline")) == [(1,)]
    assert values(flows.ticket_flow_count(inputs, "incident", "x")) == [(1,)]


def test_parquet_source(spark, tmp_path):
    raw_tickets(spark, ticket(1)).write.parquet(str(tmp_path / "t"))
    assert readers.read_parquet(spark, str(tmp_path / "t")).count() == 1


def test_jdbc_source_reads_key_ranges():
    spark = mock.Mock()
    readers.read_jdbc(spark, "jdbc:x", "AM_ACTION", "ACTION_ID", 1, 1000, 8, {"user": "u"})
    spark.read.jdbc.assert_called_once_with(
        "jdbc:x", "AM_ACTION", column="ACTION_ID", lowerBound=1, upperBound=1000,
        numPartitions=8, properties={"user": "u"})


def test_rows_as_json(spark, tmp_path):
    rows = flows.ticket_flow_rows(desk(spark, [ticket(1, CI_NAME=None)], []))
    sinks.write_rows(rows, str(tmp_path / "rows"))
    text = spark.read.text(str(tmp_path / "rows")).collect()[0]["value"]
    assert '"CI":null' in text and '"Score":31' in text
    assert spark.read.schema(rows.schema).json(str(tmp_path / "rows")).collect() == rows.collect()


def test_extract_limits_are_ordered(spark):
    source = adapter.service_desk(spark, SMALL)
    whole = [i for i, in values(extracts.extract_tickets(source), "REQUEST_ID")]
    assert [i for i, in values(extracts.extract_tickets(source, 10), "REQUEST_ID")] == whole[:10]
    assert extracts.extract_actions(source, 15).count() == 15
    assert extracts.extract_answers(source, 5).count() == 5


def test_extract_schemas(spark):
    source = adapter.service_desk(spark, SMALL)
    for df, schema in ((extracts.extract_tickets(source), schemas.TICKETS),
                       (extracts.extract_actions(source), schemas.ACTIONS),
                       (extracts.extract_answers(source), schemas.ANSWERS)):
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema]


def test_expectations(spark):
    df = tickets(spark, ticket(1), ticket(1), ticket(2))
    assert values(quality.duplicates(df, "AP_SD_REQUEST_ID")) == [(1, 2)]
    with pytest.raises(quality.MissingColumns, match="nope"):
        quality.require_columns(df, ["AP_SD_REQUEST_ID", "nope"])
    answers = spark.createDataFrame([(1, "D1", 5535, 45, None, "a"), (1, "D1", 5535, 45, None, "b")],
                                    schemas.ANSWERS)
    assert values(quality.repeated_answers(answers)) == [(1, 45, 2)]
