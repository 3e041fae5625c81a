"""Incremental extracts: the mirror of the source tables and what rides on a snapshot."""

from __future__ import annotations

import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks import adapter
from checks.queries import changed_desk
from conftest import SMALL
from deskgauge.functions.time import moment
from deskgauge.operators import quality
from deskgauge.plans import flows
from deskgauge.sources import extracts, idsets, mirror, snapshots
from helpers import values

CUT = dt.datetime(2001, 1, 1)
ROWS = "sd_request", "am_action"


def same(left, right):
    assert left.columns == right.columns
    assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.mark.parametrize("share", [9.0, 0.0])
def test_a_refreshed_mirror_gives_the_full_extract(spark, tmp_path, share):
    now, before = changed_desk(spark, SMALL)
    store = snapshots.VersionStore(spark, str(tmp_path))
    first = mirror.take_mirror(store, before)
    assert values(extracts.extract_tickets(before), "REQUEST_ID") != values(
        extracts.extract_tickets(now), "REQUEST_ID")
    second = mirror.refresh_mirror(store, now, most_changed=share)
    assert store.latest(mirror.MIRROR) == second != first
    desk = mirror.mirrored(store, second, now)
    same(extracts.extract_tickets(desk), extracts.extract_tickets(now))
    same(extracts.extract_actions(desk), extracts.extract_actions(now))
    whole = (tmp_path / "versions" / second / "sd_request").exists()
    assert whole == (share == 0.0)
    # The first version is still what it was.
    same(extracts.extract_tickets(mirror.mirrored(store, first, now)),
         extracts.extract_tickets(before))


def test_a_refresh_reads_what_changed(spark, tmp_path):
    now, before = changed_desk(spark, SMALL)
    store = snapshots.VersionStore(spark, str(tmp_path))
    mirror.take_mirror(store, before)
    version = mirror.refresh_mirror(store, now, most_changed=9.0)
    changes = store.read(version, "sd_request_changes")
    late = now.sd_request.filter(F.col("LAST_UPDATE") >= F.lit(CUT))
    assert 0 < late.count() <= changes.count() < now.sd_request.count() / 2
    # Nothing new: the same rows are read again and replace themselves.
    again = mirror.refresh_mirror(store, now, most_changed=9.0)
    same(store.read(again, "sd_request_changes"), changes)

    now.am_action.write.parquet(str(tmp_path / "stored"))
    late = mirror.changed_since(spark.read.parquet(str(tmp_path / "stored")), CUT)
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(LAST_UPDATE" in plan.split("PushedFilters")[1]


def frame(spark, rows):
    return spark.createDataFrame(
        [(key, None if day is None else dt.datetime(2024, 1, day), text) for key, day, text in rows],
        "k bigint, LAST_UPDATE timestamp_ntz, text string")


def test_the_newest_row_of_a_key_counts(spark):
    first = frame(spark, [(1, 5, "a"), (2, 5, "a"), (3, None, "a"), (None, 5, "a")])
    later = frame(spark, [(1, 5, "b"), (2, 4, "b"), (2, 6, "c"), (2, 6, "c"), (4, None, "b")])
    assert values(mirror.newest([first, later], "k"), "k", "text") == [
        (1, "b"), (2, "c"), (3, "a"), (4, "b")]
    assert mirror.newest([first.limit(0), later.limit(0)], "k").isEmpty()
    # A row that lost its time is still the one read last.
    assert values(mirror.newest([first, frame(spark, [(1, None, "z")])], "k"), "text") == [
        ("a",), ("a",), ("z",)]
    days = lambda mark: values(mirror.changed_since(first, mark), "k")
    assert days(dt.datetime(2024, 1, 6)) == [(3,)] and len(days(None)) == 4


def test_empty_tables_and_rows_without_key(spark, tmp_path):
    now, _ = changed_desk(spark, SMALL)
    store = snapshots.VersionStore(spark, str(tmp_path))
    empty = dataclasses.replace(now, **{name: getattr(now, name).limit(0) for name in ROWS})
    mirror.refresh_mirror(store, empty)
    version = mirror.refresh_mirror(store, empty)
    assert mirror.mirrored(store, version, now).sd_request.isEmpty()
    odd = dataclasses.replace(now, am_action=now.am_action.withColumn(
        "ACTION_ID", F.when(F.col("ACTION_ID") % 5 != 0, F.col("ACTION_ID"))))
    version = mirror.refresh_mirror(store, odd)
    same(mirror.mirrored(store, version, now).am_action, odd.am_action.filter("ACTION_ID IS NOT NULL"))


def test_one_of_two_refreshes_is_refused(spark, tmp_path, monkeypatch):
    now, before = changed_desk(spark, SMALL)
    store = snapshots.VersionStore(spark, str(tmp_path))
    first = mirror.take_mirror(store, before)
    second = mirror.refresh_mirror(store, now)
    with monkeypatch.context() as patch:
        patch.setattr(snapshots.VersionStore, "latest", lambda *_: first)
        with pytest.raises(snapshots.StaleVersion):
            mirror.refresh_mirror(store, now)
    assert store.latest(mirror.MIRROR) == second


@pytest.mark.parametrize("buckets", [0, 4])
def test_measures_are_taken_while_actions_are_written(spark, tmp_path, buckets):
    store = snapshots.VersionStore(spark, str(tmp_path))
    version = snapshots.take_snapshot(store, adapter.service_desk(spark, SMALL), buckets=buckets)
    noted = snapshots.action_measures(store, version)
    desk = dataclasses.replace(adapter.desk(spark, SMALL), **{
        name: store.read(version, name) for name in ("tickets", "actions")})
    same(flows.quality_report(desk, noted), flows.quality_report(desk))
    assert noted["unparsed"] > 0 and noted["oldest"]
    assert store.measured(version, "tickets", quality.MEASURES) is None


def test_report_scans(spark, tmp_path):
    """Single actions cost one pass, none with the measures of a snapshot."""
    desk = adapter.desk(spark, SMALL)
    desk.actions.write.parquet(str(tmp_path / "actions"))
    desk = dataclasses.replace(desk, actions=spark.read.parquet(str(tmp_path / "actions")))

    def notes_read(report):
        lines = report._jdf.queryExecution().executedPlan().toString().splitlines()
        return sum("FileScan" in line and "DESCRIPTION" in line for line in lines)

    known = {"unparsed": 2, "oldest": "1990-01-01 00:00:00"}
    without, using = flows.quality_report(desk), flows.quality_report(desk, known)
    assert (notes_read(without), notes_read(using)) == (1, 0)
    found = dict(values(using))
    assert (found["unparsed appointment"], found["no old action"]) == (2, 0)
    for oldest, violations in ((None, 1), ("2024-04-10 09:59:45", 1), ("2024-04-10 09:59", 0)):
        report = quality.report(desk.clean_tickets(), desk.clean_actions(),
                                moment("2024-04-10 10:00:00"), None, {"unparsed": 0, "oldest": oldest})
        assert dict(values(report))["no old action"] == violations


IDS = [-70_000, -32_768, -1, 0, 1, 7, 8, 32_767, 32_768, 32_769, 65_536, 5 * 10**12]


def test_bitmaps_hold_the_ids(spark):
    near = sorted({i + step for i in IDS for step in (-1, 0, 1)})
    rows = spark.createDataFrame([(i, n) for i in near for n in "ab"] + [(None, "a")], "k bigint, n string")
    ids = spark.createDataFrame([(i,) for i in IDS + IDS[:3] + [None]], "k bigint")
    for kind in ("bigint", "int"):
        few = rows.filter("k IS NULL OR abs(k) < 100000").withColumn("k", F.col("k").cast(kind))
        table, chosen = (rows, ids) if kind == "bigint" else (few, ids.filter("k < 100000"))
        bits = idsets.bitmaps(chosen, "k")
        same(idsets.without(table, "k", bits), table.join(chosen, "k", "left_anti").select("k", "n"))
        same(idsets.possible(table, "k", bits),
             table.join(chosen, "k", "left_semi").unionByName(table.filter("k IS NULL")))
    none = idsets.bitmaps(ids.limit(0), "k")
    assert none.isEmpty() and idsets.without(rows, "k", none).count() == rows.count()
    assert values(idsets.possible(rows, "k", none), "k") == [(None,)]
    assert idsets.whole_numbers(rows, "k") and not idsets.whole_numbers(rows, "n")


@pytest.mark.parametrize("few", [True, False])
def test_the_copy_is_not_shuffled_by_a_merge(spark, tmp_path, conf, monkeypatch, few):
    """However many changes: their keys are sent as bitmaps, and joined only beyond a bound."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    now, before = changed_desk(spark, SMALL)
    store = snapshots.VersionStore(spark, str(tmp_path))
    mirror.take_mirror(store, before)
    version = mirror.refresh_mirror(store, now, most_changed=9.0)
    if not few:
        monkeypatch.setattr(idsets, "MOST_BITMAPS", 0)
    desk = mirror.mirrored(store, version, now)
    for name in ROWS:
        plan = getattr(desk, name)._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange hashpartitioning" not in plan) == few
        same(getattr(desk, name), getattr(now, name))


@pytest.mark.parametrize("most", [0, idsets.MOST_BITMAPS])
def test_rows_of_closed_requests_are_not_shuffled(spark, tmp_path, monkeypatch, most):
    """A snapshot is the same with and without bitmaps, whatever rows lack or repeat a request."""
    source = adapter.service_desk(spark, SMALL)
    odd = F.when(F.col("REQUEST_ID") % 7 != 0, F.col("REQUEST_ID"))
    desk = dataclasses.replace(source, **{
        name: getattr(source, name).unionByName(getattr(source, name).filter("REQUEST_ID % 5 = 0"))
        .withColumn("REQUEST_ID", odd) for name in ROWS})
    seen = []
    monkeypatch.setattr(idsets, "MOST_BITMAPS", most)
    kept = extracts.extract_actions
    monkeypatch.setattr(extracts, "extract_actions",
                        lambda desk, **options: seen.append(desk) or kept(desk, **options))
    store = snapshots.VersionStore(spark, str(tmp_path))
    version = snapshots.take_snapshot(store, desk)
    for name in ROWS:
        assert (getattr(seen[0], name).count() < getattr(desk, name).count() / 2) == (most > 0)
    assert not extracts.extract_tickets(desk).filter("REQUEST_ID IS NULL").isEmpty()
    same(store.read(version, "tickets"), extracts.extract_tickets(desk))
    same(store.read(version, "actions"), kept(desk))


def test_a_snapshot_shuffles_whole_rows_once_by_request(spark, tmp_path, conf, monkeypatch):
    """Neither to meet open requests nor, being where their buckets are, a second time to be stored."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    desk = adapter.service_desk(spark, SMALL)
    asked, shuffles = [], {}
    wanted, put = extracts.wanted_requests, snapshots.VersionStore.put_bucketed

    def stored(store, version, name, frame, key, buckets, *rest):
        plan = frame.repartition(buckets, key)._jdf.queryExecution().executedPlan().toString()
        shuffles[name] = [line.partition("Exchange ")[2] for line in plan.splitlines()
                          if "Exchange hashpartitioning(REQUEST_ID" in line]
        return put(store, version, name, frame, key, buckets, *rest)

    monkeypatch.setattr(extracts, "wanted_requests", lambda desk, *ids: asked.append(desk) or wanted(desk, *ids))
    monkeypatch.setattr(snapshots.VersionStore, "put_bucketed", stored)
    store = snapshots.VersionStore(spark, str(tmp_path))
    version = snapshots.take_snapshot(store, desk, buckets=4)
    # The tickets to their buckets; the actions to theirs, and the open requests.
    assert [len(shuffles[name]) for name in ("tickets", "actions")] == [1, 2]
    assert all(", 4)" in line for lines in shuffles.values() for line in lines)
    # RFC numbers are looked up in rows of open requests only.
    assert asked[0].sd_request.count() < desk.sd_request.count() / 2
    same(store.read(version, "tickets"), extracts.extract_tickets(desk))
    same(store.read(version, "actions"), extracts.extract_actions(desk))


def test_keys_that_are_no_whole_numbers(spark, tmp_path):
    now, before = (dataclasses.replace(desk, **{
        name: getattr(desk, name).withColumn("REQUEST_ID", F.concat(F.lit("R"), "REQUEST_ID"))
        for name in ROWS}) for desk in changed_desk(spark, SMALL))
    store = snapshots.VersionStore(spark, str(tmp_path))
    mirror.take_mirror(store, before)
    version = mirror.refresh_mirror(store, now, most_changed=9.0)
    assert [store.holds(version, f"{name}_changed") for name in ROWS] == [False, True]
    desk = mirror.mirrored(store, version, now)
    same(desk.sd_request, now.sd_request)
