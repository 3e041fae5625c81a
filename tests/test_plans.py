"""What the plans must look like at scale, checked on parquet inputs."""

from __future__ import annotations

import dataclasses
import inspect
import re

import pytest
from pyspark.sql import functions as F

from checks import adapter
from checks.queries import QUERIES
from conftest import SMALL
from deskgauge import schemas
from deskgauge.operators import features, rules
from deskgauge.plans import flows
from deskgauge.sources import extracts, snapshots
from helpers import values

FLOWS = [
    f for name, f in inspect.getmembers(flows, inspect.isfunction)
    if f.__module__ == flows.__name__ and not name.startswith("_")
    and name not in ("change_classification", "chart_data")
]
ROW_FLOWS = [f for f in FLOWS if f.__name__.endswith("_rows")]
JIT_LIMIT = 8000


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """The extracts as a snapshot leaves them: plain parquet."""
    root = str(tmp_path_factory.mktemp("desk"))
    desk = adapter.desk(spark, SMALL, with_answers=True)
    stored = {}
    for name in ("tickets", "actions", "classification", "intervention_types", "answers"):
        getattr(desk, name).write.parquet(f"{root}/{name}")
        stored[name] = spark.read.parquet(f"{root}/{name}")
    return dataclasses.replace(desk, **stored)


@pytest.fixture
def big(conf):
    """Plan as for tables that no executor could take as a broadcast."""
    for prefix in ("spark.sql", "spark.sql.adaptive"):
        conf(f"{prefix}.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def scans(plan, table):
    return [line for line in plan.split("\n") if "FileScan" in line and f"/{table}]" in line]


@pytest.mark.parametrize("flow", FLOWS, ids=lambda f: f.__name__)
def test_no_python_and_no_cross_join(inputs, big, flow):
    plan = physical(flow(inputs))
    for node in ("EvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct",
                 "BroadcastNestedLoopJoin"):
        assert node not in plan


def largest_method(spark, df):
    package = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
    text = getattr(package, "MODULE$").codegenString(df._jdf.queryExecution().executedPlan())
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text))


@pytest.mark.parametrize("flow", ROW_FLOWS, ids=lambda f: f.__name__)
def test_generated_code_is_small_enough_to_compile(spark, inputs, conf, flow):
    conf("spark.sql.adaptive.enabled", "false")
    assert largest_method(spark, flow(inputs)) < JIT_LIMIT


@pytest.mark.parametrize("flow", [
    lambda desk: flows.ticket_flow_rows(desk, "incident+hotline"),
    lambda desk: flows.ticket_flow_rows(desk, "request+proxy", "martin"),
    lambda desk: flows.suspended_too_long_rows(desk, "hotline", "martin"),
    lambda desk: flows.vip_rows(desk, "martin"),
], ids=["segment", "segment and technician", "suspended", "vip"])
def test_arguments_keep_the_code_small(spark, inputs, conf, flow):
    conf("spark.sql.adaptive.enabled", "false")
    assert largest_method(spark, flow(inputs)) < JIT_LIMIT


@pytest.mark.parametrize("key", [k for k in QUERIES if re.match(r"q(12|24)_.*_rows", k)])
def test_registered_queries_keep_the_code_small(spark, conf, key):
    """Here the adapter's projections are fused with the flows."""
    conf("spark.sql.adaptive.enabled", "false")
    assert largest_method(spark, QUERIES[key](spark, SMALL)) < JIT_LIMIT


def below_the_first_shuffle(plan):
    """What the tasks that read the actions do."""
    deepest = plan[:plan.index("/actions]")].rindex("Exchange hashpartitioning(AP_AM_REQUEST_ID")
    return plan[deepest:plan.index("/actions]")]


def test_all_row_features_come_from_one_pass_over_the_actions(inputs, big):
    df = flows.ticket_flow_rows(inputs)
    plan = physical(df)
    assert len(scans(plan, "actions")) == 1
    assert optimized(df).count("Aggregate [AP_AM_REQUEST_ID") == 2
    # Reduced in the map task's hash table first, by ticket and text, then shuffled.
    reading = below_the_first_shuffle(plan)
    assert re.search(r"\bHashAggregate\(", reading) and "functions=[partial_" in reading


@pytest.mark.parametrize("flow", FLOWS, ids=lambda f: f.__name__)
def test_actions_are_never_sorted(inputs, big, flow):
    plan = physical(flow(inputs))
    if scans(plan, "actions") and "Exchange hashpartitioning(AP_AM_REQUEST_ID" in plan:
        reading = below_the_first_shuffle(plan)
        assert "SortAggregate" not in reading and "Sort [" not in reading


@pytest.mark.parametrize("flow", [flows.suspended_mail_rows, flows.contacted_rows],
                         ids=lambda f: f.__name__)
def test_contacts_ride_on_the_other_features(inputs, big, flow):
    df = flow(inputs)
    assert len(scans(physical(df), "actions")) == 1
    assert optimized(df).count("Aggregate [AP_AM_REQUEST_ID") == 2


@pytest.mark.parametrize("flow", [
    lambda desk: flows.vip_rows(desk, "martin"),
    lambda desk: flows.suspended_mail_count(desk, "martin"),
    lambda desk: flows.ticket_flow_score(desk, "incident", "martin"),
    lambda desk: flows.under_observation_count(desk, "martin"),
    lambda desk: flows.tickets_by_expiration(desk, "martin"),
], ids=["rows", "count", "score", "observation", "top"])
def test_a_technician_is_looked_for_before_anything_is_grouped(inputs, big, flow):
    """A pattern filters the action scan of a semi join with the tickets."""
    lines = optimized(flow(inputs)).split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    semi = [i for i, line in enumerate(lines) if "Join LeftSemi" in line]
    assert any(
        "martin" in lines[k] and "Filter" in lines[k]
        for i in semi for k in range(i + 1, len(lines))
        if all(d > depth[i] for d in depth[i + 1:k + 1])
        and "LeftOuter" not in "".join(lines[i + 1:k])
    )


def test_score_reads_three_action_columns_more_than_the_cleaning_needs(inputs, big):
    (scan,) = scans(physical(flows.ticket_flow_score(inputs)), "actions")
    read = re.search(r"FileScan parquet \[(.*?)\]", scan).group(1)
    names = {re.sub(r"#.*", "", c) for c in read.split(",")}
    assert names == {"REQUEST_ID", "ACTION_TYPE_ID", "START_DATE_UT", "DONE_BY_NAME",
                     "ACTION_LABEL_FR"}


@pytest.mark.parametrize("flow", [
    flows.software_install_count, flows.new_arrivals_count, flows.not_suspended_count,
    flows.industrial_count, flows.security_count, flows.vip_count, flows.ticket_flow_count,
], ids=lambda f: f.__name__)
def test_plain_counts_leave_the_actions_alone(inputs, flow):
    plan = physical(flow(inputs))
    assert not scans(plan, "actions") and not scans(plan, "classification")
    assert "Join" not in plan


def test_charts_read_what_they_show(inputs):
    data = flows.chart_data(inputs, "configuration_item", "age")
    for piece in data.values():
        plan = physical(piece)
        assert not scans(plan, "actions") and not scans(plan, "classification")
    points = physical(flows.chart_data(inputs, "inter_type", "points")["bins"])
    assert scans(points, "actions") and not scans(points, "classification")


def test_selectors_reach_the_scan(inputs, conf):
    conf("spark.sql.maxMetadataStringLength", "2000")
    plan = inputs.clean_tickets().filter("AP_SD_STATUS_ID IS NOT NULL")
    assert "IsNotNull(STATUS_ID)" in physical(plan)
    (scan,) = scans(physical(flows.new_arrivals_count(inputs)), "tickets")
    assert "EqualTo(SD_CATALOG_ID,5535)" in scan
    (scan,) = scans(physical(flows.not_suspended_count(inputs)), "tickets")
    assert "STATUS_ID" in scan.split("PushedFilters")[1]
    technicians = features.action_features(inputs.clean_actions(), features.TECHNICIAN)
    (scan,) = scans(physical(technicians), "actions")
    assert "In(ACTION_TYPE_ID" in scan.split("PushedFilters")[1]


@pytest.mark.parametrize("flow", [
    flows.new_arrivals_rows, flows.software_install_rows, flows.suspended_mail_count,
    flows.contacted_count, flows.suspended_too_long_rows, flows.vip_rows,
    flows.suspended_mail_rows, flows.contacted_rows,
], ids=lambda f: f.__name__)
def test_selected_tickets_filter_the_action_scan(inputs, big, flow):
    """A bloom filter of the selected ids runs below the action aggregate."""
    plan = optimized(flow(inputs))
    assert "bloom_filter_agg(xxhash64(AP_SD_REQUEST_ID" in plan
    below = plan[plan.rindex("Aggregate [AP_AM_REQUEST_ID"):]
    assert re.search(r"might_contain\(.*xxhash64\((AP_AM_)?REQUEST_ID", below)


@pytest.mark.parametrize("flow", [
    lambda desk: flows.ticket_flow_rows(desk, "incident+hotline"),
    lambda desk: flows.suspended_too_long_rows(desk, "hotline"),
], ids=["ticket_flow_rows", "suspended_too_long_rows"])
def test_the_class_is_known_before_the_actions(inputs, big, flow):
    """The ids that prune the action scan are those of the class."""
    plan = optimized(flow(inputs))
    pruning = plan[plan.index("bloom_filter_agg(xxhash64(AP_SD_REQUEST_ID"):]
    assert "AP_INTERVENTION_TYPE" in pruning.split("FileScan parquet")[0] or re.search(
        r"AP_INTERVENTION_TYPE#\d+L? = 2|IN \(2\)", pruning)
    assert len(scans(physical(flow(inputs)), "classification")) >= 1


@pytest.mark.parametrize("broadcasts", [True, False])
@pytest.mark.parametrize("flow", [flows.suspended_mail_table, flows.tickets_by_expiration],
                         ids=lambda f: f.__name__)
def test_the_top_25_are_found_once(inputs, conf, flow, broadcasts):
    if not broadcasts:
        for prefix in ("spark.sql", "spark.sql.adaptive"):
            conf(f"{prefix}.autoBroadcastJoinThreshold", "-1")
    df = flow(inputs)
    assert len(df.collect()) <= 25
    final = physical(df).split("== Initial Plan ==")[0]
    # One for the ids, read again by the other two tables, and one for the result.
    assert final.count("TakeOrderedAndProject(limit=25") == 2
    assert final.count("ReusedExchange") >= 2


@pytest.mark.parametrize("flow", [flows.suspended_mail_table, flows.tickets_by_expiration],
                         ids=lambda f: f.__name__)
def test_top_tables_never_sort_everything(inputs, big, flow):
    plan = physical(flow(inputs))
    assert "TakeOrderedAndProject(limit=25" in plan
    assert "rangepartitioning" not in plan
    # The few tickets are broadcast to the actions before these are grouped.
    assert "LeftSemi, BuildRight" in plan


def test_contacts_are_combined_before_both_shuffles(inputs):
    plan = physical(rules.contact_days(inputs.clean_actions()))
    assert plan.count("Exchange hashpartitioning") == 2
    assert "partial_max(" in plan and "partial_count(_day" in plan and "SortAggregate" not in plan


def test_stored_ids_spare_the_extracts_their_shuffles(spark, conf, tmp_path):
    conf("spark.sql.autoBroadcastJoinThreshold", "10MB")
    source = adapter.service_desk(spark, SMALL)
    stored = {"sd_request": source.sd_request, "am_action": source.am_action,
              "ids": extracts.open_hotline_ids(source.am_action),
              "wanted": extracts.wanted_requests(source)}
    for name, frame in stored.items():
        frame.write.parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name))
    source = dataclasses.replace(
        source, sd_request=stored["sd_request"], am_action=stored["am_action"])
    requests = physical(extracts.open_requests(source, stored["ids"]))
    assert "LeftSemi, BuildRight" in requests and "Exchange hashpartitioning" not in requests
    actions = physical(extracts.extract_actions(source, wanted=stored["wanted"]))
    assert "Exchange hashpartitioning(REQUEST_ID" not in actions
    assert "Inner, BuildRight" in actions
    for df in (extracts.open_requests(source), extracts.extract_actions(source)):
        plan = optimized(df)
        assert "ExistenceJoin" not in plan
    whole = values(extracts.extract_tickets(source), "REQUEST_ID")
    assert values(extracts.extract_tickets(source, hotline_ids=stored["ids"]), "REQUEST_ID") == whole
    whole = values(extracts.extract_actions(source), "ACTION_ID", "RFC_NUMBER")
    assert values(extracts.extract_actions(source, wanted=stored["wanted"]),
                  "ACTION_ID", "RFC_NUMBER") == whole


@pytest.mark.parametrize("flow", [
    flows.ticket_flow_rows, flows.ticket_flow_score, flows.technician_table,
    flows.suspended_mail_rows, flows.contacted_count,
], ids=lambda f: f.__name__)
def test_flows_on_a_snapshot_do_not_shuffle_the_actions(spark, inputs, big, conf, snapshot, flow):
    store, version = snapshot
    desk = dataclasses.replace(inputs, tickets=store.read(version, "tickets"),
                               actions=store.read(version, "actions"))
    plan = physical(flow(desk))
    exchanges = [line for line in plan.split("\n") if "Exchange" in line]
    assert not [line for line in exchanges if "hashpartitioning(AP_AM_REQUEST_ID" in line]
    assert not [line for line in exchanges if re.search(r"hashpartitioning\(AP_SD_REQUEST_ID#\d+L, 8", line)]
    assert "Bucketed: true" in plan
    plain = dataclasses.replace(
        inputs, **{n: spark.read.parquet(store._path(version, n)) for n in ("tickets", "actions")})
    assert values(flow(desk)) == values(flow(plain))


@pytest.fixture(scope="module")
def snapshot(spark, tmp_path_factory):
    store = snapshots.VersionStore(spark, str(tmp_path_factory.mktemp("store")))
    return store, snapshots.take_snapshot(store, adapter.service_desk(spark, SMALL), buckets=8)


def _hot_actions(spark, hot_rows=60000, tickets=300):
    """One request owns most actions."""
    ids = F.when(F.col("id") < hot_rows, 0).otherwise(F.col("id") % tickets)
    names = ["ACTION_ID", "REQUEST_ID", "ACTION_TYPE_ID", "GROUP_ID", "DESCRIPTION"]
    df = spark.range(0, hot_rows * 2, 1, 8).select(
        F.col("id").alias("ACTION_ID"), ids.cast("bigint").alias("REQUEST_ID"),
        F.lit(20).cast("bigint").alias("ACTION_TYPE_ID"), F.lit(5).cast("bigint").alias("GROUP_ID"),
        F.sha2(F.col("id").cast("string"), 512).alias("DESCRIPTION"))
    stored = [f for f in schemas.ACTIONS.fields
              if f.name not in ("RFC_NUMBER", "ACTION_TYPE", "DONE_BY_NAME", "GROUP_FR")]
    return df.select(*[
        (F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in stored])


def test_a_hot_request_is_split_in_the_extract(spark, big, conf):
    conf("spark.sql.shuffle.partitions", "8")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "200KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200KB")
    conf("spark.sql.optimizer.runtime.bloomFilter.enabled", "false")
    source = dataclasses.replace(adapter.service_desk(spark, SMALL), am_action=_hot_actions(spark))
    df = extracts.extract_actions(source)
    rows = df.groupBy("REQUEST_ID").count()
    assert dict(values(rows))[0] > 60000
    assert df.count() == 120000
    df.write.format("noop").mode("overwrite").save()
    joined = extracts.lookup(source.am_action, source.sd_request, "REQUEST_ID", "REQUEST_ID",
                             {"RFC_NUMBER": "RFC_NUMBER"}, "inner")
    assert len(joined.collect()) == 120000
    assert "skew=true" in physical(joined)


def test_a_hot_request_is_reduced_before_the_shuffle(spark, inputs, conf):
    conf("spark.sql.adaptive.enabled", "false")
    actions = _hot_actions(spark).withColumns({
        "RFC_NUMBER": F.lit("x"), "ACTION_TYPE": F.lit("x"), "GROUP_FR": F.lit("x"),
        "DONE_BY_NAME": F.concat(F.lit("t"), (F.col("ACTION_ID") % 5).cast("string"))})
    desk = dataclasses.replace(inputs, actions=actions)
    found = features.action_features(desk.clean_actions(), features.TECHNICIAN)
    rows = {r["AP_AM_REQUEST_ID"]: r for r in found.collect()}
    assert len(rows) == 300 and rows[0]["AP_AM_ACTION_ID"] == 119700
    assert rows[0]["AP_AM_DONE_BY_OPERATOR_NAME"] == "t0"
    metrics = found._jdf.queryExecution().executedPlan()
    shuffled = []

    def visit(node):
        if node.nodeName() == "Exchange":
            shuffled.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(metrics)
    # At most one row per request, operator and map task, of 120000 actions.
    assert shuffled and max(shuffled) <= 300 * 5 * 8
