"""One query per operator and workflow, each with its oracle SQL.

A query takes (spark, sf_dir) and returns a DataFrame over the whole tables.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks import adapter, oracle as O
from deskgauge import constants as K
from deskgauge import schemas
from deskgauge.functions import text as X
from deskgauge.functions import time as XT
from deskgauge.operators import classification as C
from deskgauge.operators import (
    cleaning, events, features, joins, quality, reports, rules, scoring,
)
from deskgauge.operators import selectors as S
from deskgauge.plans import flows
from deskgauge.sources import extracts, mirror, readers, sinks, snapshots

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

AS_OF = adapter.AS_OF


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = O.with_views(sql)
        return function
    return register


def ticket_id() -> Column:
    return F.col("AP_SD_REQUEST_ID").alias("id")


def action_id() -> Column:
    return F.col("AP_AM_ACTION_ID").alias("action_id")


def nullable(name: str, alias: str) -> Column:
    """An integer that may be null, as a double: both engines hand it to pandas alike."""
    return F.col(name).cast("double").alias(alias)


def now() -> Column:
    return XT.moment(AS_OF)


def clean(spark, sf) -> DataFrame:
    return adapter.desk(spark, sf).clean_tickets()


def acts(spark, sf) -> DataFrame:
    return adapter.desk(spark, sf).clean_actions()


def typed(spark, sf) -> DataFrame:
    return features.with_start_date(features.with_ticket_type(clean(spark, sf)))


def classed(spark, sf, tickets=None) -> DataFrame:
    desk = adapter.desk(spark, sf)
    return desk.classify(typed(spark, sf) if tickets is None else tickets)


def aged(spark, sf) -> DataFrame:
    tickets = features.with_last_action(typed(spark, sf), acts(spark, sf), now())
    return features.with_age(tickets, now())


def scored(spark, sf) -> DataFrame:
    return scoring.with_score(aged(spark, sf), adapter.VIP_NAMES)


def text_of_date(column):
    return XT.day_text(column.cast("timestamp_ntz"))


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared folder the session names, else the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir")
        if shared.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/')}/deskgauge-{uuid.uuid4()}"


# ------------------------------------------------------------ sources, sinks

_STAR_COLUMNS = (
    "REQUEST_ID", "PARENT_REQUEST_ID", "RFC_NUMBER", "SUBMIT_DATE_UT",
    "SUBMITTED_BY_LAST_NAME", "REQUESTOR_LAST_NAME", "REQUESTOR_LOCATION_RH",
    "RECIPIENT_LAST_NAME", "RECIPIENT_LOCATION_RH", "CATALOG_NAME", "STATUS_ID",
    "STATUS_FR", "URGENCY_FR", "CI_NAME", "OWNER_LAST_NAME", "OWNING_GROUP_NAME", "ASSET_TAG",
)
_ACTION_COLUMNS = (
    "ACTION_ID", "REQUEST_ID", "RFC_NUMBER", "ACTION_TYPE_ID", "ACTION_LABEL_FR",
    "ACTION_TYPE", "START_DATE_UT", "DESCRIPTION", "DONE_BY_NAME", "GROUP_FR",
)
_EXTRACTED = ("x.ACTION_TYPE_ID NOT IN (23, 107, 82) AND x.REQUEST_ID IN "
              "(SELECT REQUEST_ID FROM hotline_ids UNION SELECT REQUEST_ID FROM arrival_ids)")
_ANSWERS_SQL = f"""
    SELECT q.REQUEST_ID, r.RFC_NUMBER, r.SD_CATALOG_ID, q.QUESTION_ID, q.RESULT, q.RESULT_STRING_FR
    FROM sd_question q JOIN sd_request r ON q.REQUEST_ID = r.REQUEST_ID
    WHERE q.QUESTION_ID IN ({O.values(K.QUESTIONS)})"""


@query("s1_ticket_extract", O.star_tickets("open_request"))
def _(spark, sf):
    return extracts.extract_tickets(adapter.service_desk(spark, sf)).select(*_STAR_COLUMNS)


@query("s2_action_extract", O.star_actions(_EXTRACTED))
def _(spark, sf):
    return extracts.extract_actions(adapter.service_desk(spark, sf)).select(*_ACTION_COLUMNS)


@query("s3_answer_extract",
       _ANSWERS_SQL + " AND q.REQUEST_ID IN (SELECT REQUEST_ID FROM arrival_ids)")
def _(spark, sf):
    return extracts.extract_answers(adapter.service_desk(spark, sf))


@query("s4_delimited_source",
       "SELECT id, rfc, submitted, status, comment, location FROM t")
def _(spark, sf):
    raw = adapter.tickets(spark, sf)
    stamp = lambda c: F.concat(c.cast("string"), F.lit(".000000"))
    dates = [f.name for f in raw.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    path = scratch(spark)
    raw.withColumns({c: stamp(F.col(c)) for c in dates}).write.csv(
        path, sep=readers.DELIMITER, header=True, quote='"', escape='"'
    )
    read = readers.read_delimited(spark, path, schemas.TICKETS, multi_line=True)
    return cleaning.clean_tickets(read).select(
        ticket_id(), F.col("AP_SD_RFC_NUMBER").alias("rfc"),
        F.col("AP_SD_SUBMIT_DATE_UT").alias("submitted"),
        F.col("AP_SD_STATUS_ID").alias("status"), F.col("AP_SD_COMMENT").alias("comment"),
        F.col("AP_SD_RECIPIENT_LOCATION_RH").alias("location"),
    )


@query("s7_snapshot",
       f"""SELECT CAST(type_id AS BIGINT) AS type_id, count(*) AS actions
           FROM (SELECT ACTION_TYPE_ID AS type_id FROM ({O.star_actions(_EXTRACTED)}) z)
           GROUP BY type_id""")
def _(spark, sf):
    store = snapshots.VersionStore(spark, scratch(spark))
    version = snapshots.take_snapshot(store, adapter.service_desk(spark, sf))
    # A newer version of another kind does not hide the extracts.
    store.write({"classification": adapter.classification(spark, sf)}, snapshots.CLASSIFICATION)
    version = store.latest(snapshots.EXTRACT)
    return store.read(version, "actions").groupBy(
        F.col("ACTION_TYPE_ID").alias("type_id")
    ).agg(F.count("*").alias("actions"))


def changed_desk(spark, sf):
    """The source tables, and their state before the changes of 2001."""
    now = adapter.service_desk(spark, sf)
    now = dataclasses.replace(
        now, am_action=now.am_action.withColumn("LAST_UPDATE", F.col("START_DATE_UT")))
    late = F.coalesce(F.col("LAST_UPDATE") >= F.lit("2001-01-01").cast("timestamp_ntz"), F.lit(False))
    stale = now.sd_request.withColumns({
        "SD_CATALOG_ID": F.when(late, 1000).otherwise(F.col("SD_CATALOG_ID")).cast("bigint"),
        "STATUS_ID": F.when(late, 12).otherwise(F.col("STATUS_ID")).cast("bigint"),
        "LAST_UPDATE": F.when(~late, F.col("LAST_UPDATE")),
    })
    return now, dataclasses.replace(now, sd_request=stale, am_action=now.am_action.filter(~late))


def incremental(spark, sf, name) -> DataFrame:
    """An extract from a mirror that was copied before the changes and then refreshed."""
    now, before = changed_desk(spark, sf)
    store = snapshots.VersionStore(spark, scratch(spark))
    mirror.take_mirror(store, before)
    return store.read(mirror.take_incremental_snapshot(store, now), name)


@query("s1_incremental_extract", O.star_tickets("open_request"))
def _(spark, sf):
    return incremental(spark, sf, "tickets").select(*_STAR_COLUMNS)


@query("s2_incremental_extract", O.star_actions(_EXTRACTED))
def _(spark, sf):
    return incremental(spark, sf, "actions").select(*_ACTION_COLUMNS)


@query("e_report_of_snapshot",
       f"""SELECT 'unparsed appointment' AS expectation, count(*) AS violations
           FROM ({O.star_actions(_EXTRACTED)}) z
           WHERE DESCRIPTION LIKE '%rdv:%'
               AND try_strptime(regexp_extract(DESCRIPTION, 'rdv:(.*)', 1), '%d/%m/%Y') IS NULL
               AND NOT (START_DATE_UT IS NULL AND DONE_BY_NAME IS NULL AND ACTION_LABEL_FR IS NULL)
           UNION ALL SELECT 'repeated action', count(*) FROM (
               SELECT ACTION_ID FROM ({O.star_actions(_EXTRACTED)}) z
               GROUP BY ACTION_ID HAVING count(*) > 1)""")
def _(spark, sf):
    """What a snapshot measured while it was written, beside what is counted after."""
    store = snapshots.VersionStore(spark, scratch(spark))
    version = snapshots.take_snapshot(store, adapter.service_desk(spark, sf))
    desk = dataclasses.replace(adapter.desk(spark, sf), **{
        name: store.read(version, name) for name in ("tickets", "actions")})
    report = flows.quality_report(desk, snapshots.action_measures(store, version))
    return report.filter(F.col("expectation").isin("unparsed appointment", "repeated action"))


@query("s8_append_missing",
       "SELECT t.id, CAST(coalesce(cl.itype, 1) AS BIGINT) AS itype FROM t LEFT JOIN cl USING (id)")
def _(spark, sf):
    store = snapshots.VersionStore(spark, scratch(spark))
    stored = adapter.classification(spark, sf)
    doubled = stored.unionByName(stored.filter("AP_REQUEST_ID % 3 = 0"))
    first = store.write({"classification": doubled}, snapshots.CLASSIFICATION)
    tickets = clean(spark, sf)
    version = snapshots.complete_classification(
        store, first, tickets.unionByName(tickets.filter("AP_SD_REQUEST_ID % 5 = 0")))
    return store.read(version, "classification").select(
        F.col("AP_REQUEST_ID").alias("id"), F.col("AP_INTERVENTION_TYPE").alias("itype")
    )


def type_updates(spark, sf) -> DataFrame:
    """Three rounds of changes; some labels are unknown, some requests too.

    Every 35th order is a ticket without a stored row; negative ids exist nowhere.
    """
    k = F.col("o_orderkey")
    orders = adapter.table(spark, sf, "orders").filter(k % 5 == 0)

    def changes(shift, minute):
        label = F.concat(F.lit("Type "), ((k + shift) % 18).cast("string"))
        return orders.select(
            k.alias("AP_REQUEST_ID"), label.alias("AP_TYPE_FR"),
            F.timestamp_add("MINUTE", F.lit(minute), "o_orderdate").alias("requested_at"),
        )

    nowhere = changes(2, 9).filter(F.col("AP_REQUEST_ID") % 25 == 0).withColumn(
        "AP_REQUEST_ID", -F.col("AP_REQUEST_ID"))
    return changes(1, 0).unionByName(
        changes(4, 5).filter(F.col("AP_REQUEST_ID") % 2 == 0)).unionByName(nowhere)


_UPDATES_SQL = """
    (SELECT o_orderkey AS id, (o_orderkey + 1) % 18 AS wanted, 0 AS turn
     FROM orders WHERE o_orderkey % 5 = 0
     UNION ALL
     SELECT o_orderkey, (o_orderkey + 4) % 18, 1 FROM orders WHERE o_orderkey % 10 = 0
     UNION ALL
     SELECT -o_orderkey, (o_orderkey + 2) % 18, 2 FROM orders WHERE o_orderkey % 25 = 0)"""
_CHANGED_SQL = f"""
    SELECT c.id, CAST(coalesce(u.wanted, c.itype) AS BIGINT) AS itype
    FROM (SELECT id, coalesce(cl.itype, 1) AS itype FROM t FULL JOIN cl USING (id)) c LEFT JOIN (
        SELECT id, arg_max(wanted, turn) AS wanted FROM {_UPDATES_SQL} u
        WHERE wanted BETWEEN 1 AND 16 GROUP BY id) u USING (id)"""


@query("s9_classification_update", _CHANGED_SQL)
def _(spark, sf):
    store = snapshots.VersionStore(spark, scratch(spark))
    version = store.write(
        {"classification": adapter.classification(spark, sf)}, snapshots.CLASSIFICATION)
    changed, _rejects = snapshots.change_stored_types(
        store, version, adapter.intervention_types(spark), type_updates(spark, sf),
        clean(spark, sf))
    return store.read(changed, "classification").select(
        F.col("AP_REQUEST_ID").alias("id"), F.col("AP_INTERVENTION_TYPE").alias("itype")
    )


@query("s9_rejected_updates",
       f"""SELECT id, 'Type ' || CAST(wanted AS VARCHAR) AS label,
                  CASE WHEN wanted BETWEEN 1 AND 16 THEN 'unknown request' ELSE 'unknown type' END
                      AS reason
           FROM {_UPDATES_SQL} u
           WHERE wanted NOT BETWEEN 1 AND 16
              OR id NOT IN (SELECT id FROM t UNION SELECT id FROM cl)""")
def _(spark, sf):
    change = flows.change_classification(adapter.desk(spark, sf), type_updates(spark, sf))
    return change.rejects.select(
        F.col("AP_REQUEST_ID").alias("id"), F.col("AP_TYPE_FR").alias("label"), "reason"
    )


@query("s10_row_list", O.row_list(f"catalog_id = {K.CATALOG_NEW_ARRIVAL}"))
def _(spark, sf):
    rows = flows.new_arrivals_rows(adapter.desk(spark, sf))
    path = scratch(spark)
    sinks.write_rows(rows, path)
    return spark.read.schema(rows.schema).json(path)


_MAIL_TABLE_SQL = f"""
    SELECT rfc AS AP_SD_RFC_NUMBER, type_name AS AP_TYPE_FR,
           {O.location('location')} AS AP_SD_RECIPIENT_LOCATION_RH,
           done_by AS AP_AM_DONE_BY_OPERATOR_NAME
    FROM complete WHERE status IN (39, 42) AND id IN (SELECT id FROM due_contact)
    ORDER BY due NULLS LAST, id LIMIT 25"""


_MAIL_HEADER = (
    '[{"col_order": 0, "name": "Ticket", "id": "AP_SD_RFC_NUMBER"}, '
    '{"col_order": 1, "name": "Type", "id": "AP_TYPE_FR"}, '
    '{"col_order": 2, "name": "Location", "id": "AP_SD_RECIPIENT_LOCATION_RH"}, '
    '{"col_order": 3, "name": "Technician", "id": "AP_AM_DONE_BY_OPERATOR_NAME"}]')


@query("s11_table_with_header", f"SELECT *, '{_MAIL_HEADER}' AS header FROM ({_MAIL_TABLE_SQL})")
def _(spark, sf):
    table = flows.suspended_mail_table(adapter.desk(spark, sf))
    path = scratch(spark)
    sinks.write_table(table, path)
    header = spark.read.text(f"{path}/header").first()["value"]
    rows = spark.read.schema(table.schema).json(f"{path}/rows")
    return rows.withColumn("header", F.lit(header))


_RDV_EVENT_SQL = f"""
    SELECT rfc || ' - ' || recipient || ', ' || location || ' - ' || type_name AS title,
           strftime({O.local('rdv_date')}, '%Y-%m-%d') AS start,
           CASE WHEN shown LIKE 'Pas de location%' THEN '#FC0B03' WHEN shown LIKE 'Paris%' THEN '#34495E'
                WHEN shown LIKE 'DRM%' THEN '#27AE60' WHEN shown LIKE 'DRI%' THEN '#E67E22'
                WHEN shown LIKE 'DRS%' THEN '#8E44AD' WHEN shown LIKE 'DHR%' THEN '#3498DB'
                WHEN shown LIKE 'DM%' THEN '#F1C40F' ELSE '' END AS color,
           rfc AS rfc, recipient AS name, shown AS location, type_name AS ticket_type,
           comment AS description
    FROM (SELECT *, {O.location('location')} AS shown FROM complete)
    WHERE rdv_state IN ('{K.RDV_PENDING}', '{K.RDV_LATE}')"""


def flat_rdv(df: DataFrame) -> DataFrame:
    props = F.col("extendedProps")
    return df.select(
        "title", "start", "color", props["SPOT"].alias("rfc"), props["Nom"].alias("name"),
        props["Location"].alias("location"), props["Ticket type"].alias("ticket_type"),
        props["Description"].alias("description"),
    )


@query("s12_event_sink", _RDV_EVENT_SQL)
def _(spark, sf):
    found = flows.rdv_calendar(adapter.desk(spark, sf))
    path = scratch(spark)
    sinks.write_events(found, path)
    parsed = spark.read.text(path).select(F.from_json("value", found.schema).alias("e"))
    return flat_rdv(parsed.select("e.*"))


# ------------------------------------------------------ cleaning, projections

@query("p1_clean_tickets",
       """SELECT id, rfc, submitted, due, status, status_name, urgency, urgency_name, catalog_id,
                 ci_id, ci, comment, requestor, recipient, location FROM t""")
def _(spark, sf):
    return cleaning.drop_known_bad_tickets(cleaning.clean_tickets(adapter.tickets(spark, sf))).select(
        ticket_id(), F.col("AP_SD_RFC_NUMBER").alias("rfc"), F.col("AP_SD_SUBMIT_DATE_UT").alias("submitted"),
        F.col("AP_SD_MAX_RESOLUTION_DATE").alias("due"), F.col("AP_SD_STATUS_ID").alias("status"),
        F.col("AP_SD_STATUS_FR").alias("status_name"), F.col("AP_SD_URGENCY_ID").alias("urgency"),
        F.col("AP_SD_URGENCY").alias("urgency_name"), F.col("AP_SD_CATALOG_ID").alias("catalog_id"),
        F.col("AP_SD_CI_ID").alias("ci_id"), F.col("AP_SD_CI_NAME").alias("ci"),
        F.col("AP_SD_COMMENT").alias("comment"), F.col("REQUESTOR_LAST_NAME").alias("requestor"),
        F.col("AP_SD_RECIPIENT_LAST_NAME").alias("recipient"),
        F.col("AP_SD_RECIPIENT_LOCATION_RH").alias("location"),
    )


@query("p2_clean_actions",
       "SELECT action_id, id, rfc, type_id, label, start, done_by, note FROM a")
def _(spark, sf):
    return acts(spark, sf).select(
        action_id(), F.col("AP_AM_REQUEST_ID").alias("id"), F.col("AP_AM_RFC_NUMBER").alias("rfc"),
        F.col("AP_AM_ACTION_TYPE_ID").alias("type_id"),
        F.col("AP_AM_OPERATION_TYPE_NAME").alias("label"), F.col("AP_AM_START_DATE").alias("start"),
        F.col("AP_AM_DONE_BY_OPERATOR_NAME").alias("done_by"),
        F.col("AP_AM_DESCRIPTION").alias("note"),
    )


@query("p3_row_projection", O.row_list())
def _(spark, sf):
    tickets = features.with_technician(scored(spark, sf), acts(spark, sf))
    tickets = features.with_rdv(tickets, acts(spark, sf), now())
    return reports.format_rows(classed(spark, sf, tickets))


@query("p4_narrow_projection",
       """SELECT t.rfc, c.type_name, t.location, k.done_by
          FROM t JOIN classed c USING (id) LEFT JOIN tech k USING (id)""")
def _(spark, sf):
    return features.with_technician(classed(spark, sf), acts(spark, sf)).select(
        F.col("AP_SD_RFC_NUMBER").alias("rfc"), F.col("AP_TYPE_FR").alias("type_name"),
        F.col("AP_SD_RECIPIENT_LOCATION_RH").alias("location"),
        F.col("AP_AM_DONE_BY_OPERATOR_NAME").alias("done_by"),
    )


@query("p5_sentinel_to_null",
       """SELECT id, CASE WHEN c = 'N/A' OR contains(c, '<NA>') THEN NULL ELSE c END AS comment
          FROM (SELECT id, CASE WHEN id % 11 = 3 THEN '<NA> ' || raw_comment ELSE raw_comment END AS c
                FROM rt)""")
def _(spark, sf):
    marked = F.when(F.col("REQUEST_ID") % 11 == 3, F.concat(F.lit("<NA> "), F.col("COMMENT")))
    tickets = adapter.tickets(spark, sf).withColumn(
        "COMMENT", marked.when(F.col("REQUEST_ID") % 11 != 3, F.col("COMMENT")))
    return cleaning.sentinels_to_null(tickets).select(
        F.col("REQUEST_ID").alias("id"), F.col("COMMENT").alias("comment"))


@query("p6_blank_to_null",
       r"""SELECT action_id, CASE WHEN regexp_matches(c, '^\s*$') THEN NULL ELSE c END AS note
           FROM (SELECT action_id, CASE WHEN type_id = 5 THEN '' WHEN type_id = 61 THEN ' 	 '
                        ELSE note END AS c FROM ra)""")
def _(spark, sf):
    kind = F.col("ACTION_TYPE_ID")
    raw = adapter.actions(spark, sf).withColumn(
        "DESCRIPTION", F.when(kind == 5, "").when(kind == 61, " \t ").otherwise(F.col("DESCRIPTION")))
    return cleaning.blanks_to_null(raw).select(
        F.col("ACTION_ID").alias("action_id"), F.col("DESCRIPTION").alias("note"))


@query("p7_drop_empty_actions",
       "SELECT action_id FROM ra WHERE NOT (start IS NULL AND raw_done_by IS NULL AND type_id = 54)")
def _(spark, sf):
    unlabelled = F.when(F.col("ACTION_TYPE_ID") != 54, F.col("ACTION_LABEL_FR"))
    raw = adapter.actions(spark, sf).withColumn("ACTION_LABEL_FR", unlabelled)
    return cleaning.drop_empty_actions(raw).select(F.col("ACTION_ID").alias("action_id"))


@query("p8_operator_or_group",
       "SELECT action_id, coalesce(raw_done_by, raw_group) AS done_by FROM ra")
def _(spark, sf):
    return cleaning.operator_or_group(adapter.actions(spark, sf)).select(
        F.col("ACTION_ID").alias("action_id"), F.col("DONE_BY_NAME").alias("done_by"))


@query("p9_constant_fill",
       f"""SELECT id, coalesce(urgency_name, '4-Normal') AS urgency_name,
                  coalesce(raw_location, 'Pas de location') AS location,
                  CASE WHEN id % 6 = 0 THEN 'N/A' ELSE raw_recipient END AS recipient FROM rt""")
def _(spark, sf):
    unnamed = F.when(F.col("REQUEST_ID") % 6 != 0, F.col("RECIPIENT_LAST_NAME"))
    raw = adapter.tickets(spark, sf).withColumn("RECIPIENT_LAST_NAME", unnamed)
    return cleaning.fill_ticket_defaults(raw).select(
        F.col("REQUEST_ID").alias("id"), F.col("URGENCY_FR").alias("urgency_name"),
        F.col("RECIPIENT_LOCATION_RH").alias("location"),
        F.col("RECIPIENT_LAST_NAME").alias("recipient"))


_BAD_IDS = (7, 188, 1204)


@query("p10_known_bad_tickets", f"SELECT id FROM rt WHERE id NOT IN ({O.values(_BAD_IDS)})")
def _(spark, sf):
    return cleaning.drop_known_bad_tickets(clean(spark, sf), _BAD_IDS).select(ticket_id())


@query("p10_known_bad_actions", f"SELECT action_id FROM ra WHERE id NOT IN ({O.values(_BAD_IDS)})")
def _(spark, sf):
    return cleaning.drop_known_bad_actions(acts(spark, sf), _BAD_IDS).select(action_id())


@query("p11_ticket_type", "SELECT id, CAST(kind AS BIGINT) AS kind, kind_name FROM t")
def _(spark, sf):
    return features.with_ticket_type(clean(spark, sf)).select(
        ticket_id(), F.col("C_TICKET_TYPE").alias("kind"), F.col("C_TICKET_TYPE_STRING_FR").alias("kind_name"))


@query("p12_start_date", "SELECT id, submitted AS start_date FROM t")
def _(spark, sf):
    return features.with_start_date(clean(spark, sf)).select(
        ticket_id(), F.col("C_START_DATE").alias("start_date"))


@query("p13_answer_fallback",
       "SELECT id, question, coalesce(answer, raw) AS answer FROM an")
def _(spark, sf):
    return features.answer_or_result(adapter.answers(spark, sf)).select(
        F.col("REQUEST_ID").alias("id"), F.col("QUESTION_ID").alias("question"),
        F.col("RESULT_STRING_FR").alias("answer"))


# ------------------------------------------------------------------ selectors

def selector(name: str, where: str, predicate, tickets=clean):
    @query(name, f"SELECT id FROM t WHERE {where}")
    def _(spark, sf):
        return tickets(spark, sf).filter(predicate()).select(ticket_id())


_DIGIPASS = (f"(coalesce(ci IN ({O.values(K.CI_DIGIPASS)}), false) "
             f"OR {O.found('comment', K.PATTERN_DIGIPASS)})")
_OTHERS = tuple(f"Customer#{i:09d}" for i in range(40, 55))

selector("f1_security", O.SECURITY, S.is_security)
selector("f2_vip", O.VIP, lambda: S.is_about(adapter.VIP_NAMES))
selector("f3_sensitive_personnel",
         f"requestor IN ({O.values(_OTHERS)}) OR recipient IN ({O.values(_OTHERS)})",
         lambda: S.is_about(_OTHERS))
selector("f4_industrial", O.INDUSTRIAL, S.is_industrial)
selector("f5_not_suspended", O.UNSUSPENDED, S.is_not_suspended)
selector("f7_software_install", f"catalog_id IN ({O.values(K.CATALOG_SOFTWARE_INSTALL)})",
         S.is_software_install)
selector("f8_new_arrival", "catalog_id = 5535", S.is_new_arrival)
selector("f9_urgent", "urgency IN (1, 2)", S.is_urgent)
selector("f10_digipass", _DIGIPASS, S.is_digipass)
selector("f11_skype", "ci = 'SKYPE_ENV'", S.is_skype)
selector("f12_outlook", f"ci IN ({O.values(K.CI_OUTLOOK)})", S.is_outlook)
selector("f13_telephone", f"ci IN ({O.values(K.CI_TELEPHONE)})", S.is_telephone)
selector("f16_unexpired", f"{O.UNSUSPENDED} AND due > {O.NOW}", lambda: S.is_unexpired(now()))


def segment(name: str, where: str):
    @query("f6_flow_" + name.replace("+", "_"),
           f"SELECT t.id FROM t JOIN classed c USING (id) WHERE {where}")
    def _(spark, sf):
        return S.ticket_flow(classed(spark, sf), name).select(ticket_id())


for _name, _where in O.SEGMENTS.items():
    segment(_name, _where)


@query("f6_flow_all", "SELECT id FROM t")
def _(spark, sf):
    return S.ticket_flow(classed(spark, sf), "anything").select(ticket_id())


@query("f6_flow_hotline_running",
       f"SELECT t.id FROM t JOIN classed c USING (id) WHERE itype = 2 AND {O.UNSUSPENDED}")
def _(spark, sf):
    return S.ticket_flow(classed(spark, sf), "hotline", suspended=False).select(ticket_id())


@query("f14_under_observation", "SELECT id FROM t WHERE id IN (SELECT id FROM observed)")
def _(spark, sf):
    return S.under_observation(clean(spark, sf), acts(spark, sf)).select(ticket_id())


@query("f15_technician_filter",
       "SELECT t.id, k.done_by FROM t JOIN tech k USING (id) "
       "WHERE regexp_matches(k.done_by, 'hotline|supplier#0000000(1|2)', 'i')")
def _(spark, sf):
    found = features.with_technician(
        clean(spark, sf), acts(spark, sf), "hotline|supplier#0000000(1|2)")
    return found.select(ticket_id(), F.col("AP_AM_DONE_BY_OPERATOR_NAME").alias("done_by"))


_DUE_SQL = "SELECT id FROM t WHERE status IN (39, 42) AND id IN (SELECT id FROM due_contact)"
_OFTEN_SQL = ("SELECT id FROM t WHERE status IN (39, 42) AND urgency = 5 "
              "AND id IN (SELECT id FROM often_contacted)")


def _overdue(days: int, kind: str, view: str = "complete") -> str:
    deadline = O.plus_business_days(O.local("suspended_at"), days)
    return f"status IN (5, 20) AND {kind} AND {deadline} < {O.local(O.NOW)}"


@query("f17_mail_not_recontacted", _DUE_SQL)
def _(spark, sf):
    return rules.suspended_mail_not_recontacted(clean(spark, sf), acts(spark, sf), now()).select(ticket_id())


@query("f18_contacted_often", _OFTEN_SQL)
def _(spark, sf):
    return rules.contacted_x_times(clean(spark, sf), acts(spark, sf), 3).select(ticket_id())


@query("f19_suspended_too_long_hotline", f"SELECT id FROM complete WHERE {_overdue(1, 'itype = 2')}")
def _(spark, sf):
    return rules.suspended_gt_x(classed(spark, sf), acts(spark, sf), now(), "hotline").select(ticket_id())


@query("f19_suspended_too_long_proxy", f"SELECT id FROM complete WHERE {_overdue(5, O.PROXY)}")
def _(spark, sf):
    return rules.suspended_gt_x(classed(spark, sf), acts(spark, sf), now()).select(ticket_id())


@query("f20_dated_rdv",
       f"SELECT id FROM rdvstate WHERE rdv_state IN ('{K.RDV_PENDING}', '{K.RDV_LATE}')")
def _(spark, sf):
    return features.with_rdv(clean(spark, sf), acts(spark, sf), now()).filter(
        S.has_dated_rdv()).select(ticket_id())


@query("f21_contact_actions", f"SELECT action_id FROM a WHERE {O.found('label', K.PATTERN_CONTACT)}")
def _(spark, sf):
    return acts(spark, sf).filter(S.is_contact_action()).select(action_id())


# ---------------------------------------------------------------------- joins

@query("j1_ticket_star_join", O.star_tickets("sd_request"))
def _(spark, sf):
    desk = adapter.service_desk(spark, sf)
    return extracts.star_join_tickets(desk, desk.sd_request).select(*_STAR_COLUMNS)


@query("j2_action_star_join", O.star_actions("true"))
def _(spark, sf):
    desk = adapter.service_desk(spark, sf)
    actions = extracts.lookup(desk.am_action, desk.sd_request, "REQUEST_ID", "REQUEST_ID",
                              {"RFC_NUMBER": "RFC_NUMBER"})
    return extracts.star_join_actions(desk, actions).select(*_ACTION_COLUMNS)


@query("j3_answers_with_ticket", _ANSWERS_SQL)
def _(spark, sf):
    desk = adapter.service_desk(spark, sf)
    answers = desk.sd_question_result.filter(F.col("QUESTION_ID").isin(*K.QUESTIONS))
    return extracts.lookup(answers, desk.sd_request, "REQUEST_ID", "REQUEST_ID", {
        "RFC_NUMBER": "RFC_NUMBER", "SD_CATALOG_ID": "SD_CATALOG_ID"}, "inner")


@query("j4_open_tickets", "SELECT REQUEST_ID FROM open_request")
def _(spark, sf):
    return extracts.open_requests(adapter.service_desk(spark, sf)).select("REQUEST_ID")


@query("j5_actions_of_tickets",
       "SELECT action_id FROM a WHERE id IN (SELECT id FROM t WHERE catalog_id = 5535)")
def _(spark, sf):
    arrivals = clean(spark, sf).filter(S.is_new_arrival())
    return joins.actions_of(acts(spark, sf), arrivals).select(action_id())


@query("j6_unclassified_tickets", "SELECT id FROM t WHERE id NOT IN (SELECT id FROM cl)")
def _(spark, sf):
    return joins.unclassified(clean(spark, sf), adapter.classification(spark, sf)).select(ticket_id())


@query("j7_feature_merge",
       "SELECT t.id, u.suspended_at FROM t LEFT JOIN suspension u USING (id)")
def _(spark, sf):
    return features.with_action_features(
        clean(spark, sf), acts(spark, sf), features.SUSPENSION
    ).select(ticket_id(), F.col("C_SUSPENDED_AT").alias("suspended_at"))


@query("j8_points_by_ticket", "SELECT id, rfc, points FROM scored")
def _(spark, sf):
    return scored(spark, sf).select(
        ticket_id(), F.col("AP_SD_RFC_NUMBER").alias("rfc"), F.col("C_POINTS").alias("points"))


@query("j9_type_labels",
       "SELECT id, CAST(itype AS BIGINT) AS itype, type_name FROM cl JOIN ty ON type_id = itype")
def _(spark, sf):
    return C.label_types(
        adapter.classification(spark, sf), adapter.intervention_types(spark)
    ).select(F.col("AP_REQUEST_ID").alias("id"), F.col("AP_INTERVENTION_TYPE").alias("itype"),
             F.col("AP_TYPE_FR").alias("type_name"))


@query("j10_collision_checked_merge",
       "SELECT t.id, cl.itype FROM t JOIN cl USING (id)")
def _(spark, sf):
    known = adapter.classification(spark, sf).select("AP_REQUEST_ID", "AP_INTERVENTION_TYPE")
    return joins.merge(clean(spark, sf), known, "AP_SD_REQUEST_ID", "AP_REQUEST_ID", "inner").select(
        ticket_id(), F.col("AP_INTERVENTION_TYPE").alias("itype"))


# --------------------------------------------------------------- aggregations

@query("a1_technician",
       """SELECT t.id, CAST(k.action_id AS DOUBLE) AS action_id, CAST(k.type_id AS DOUBLE) AS type_id,
                 k.start, k.done_by FROM t LEFT JOIN tech k USING (id)""")
def _(spark, sf):
    return features.with_technician(clean(spark, sf), acts(spark, sf)).select(
        ticket_id(), nullable("AP_AM_ACTION_ID", "action_id"),
        nullable("AP_AM_ACTION_TYPE_ID", "type_id"), F.col("AP_AM_START_DATE").alias("start"),
        F.col("AP_AM_DONE_BY_OPERATOR_NAME").alias("done_by"))


def last_action(name: str, column: str, which: str):
    @query(name, f"SELECT t.id, CAST({O.minutes('f.' + column)} AS DOUBLE) AS minutes "
                 "FROM t LEFT JOIN firstact f USING (id)")
    def _(spark, sf):
        return features.with_last_action(clean(spark, sf), acts(spark, sf), now(), which).select(
            ticket_id(), nullable("C_LAST_ACTION_DATE", "minutes"))


last_action("a2_last_action_age", "first_start", "first")
last_action("a2_last_action_age_latest", "latest_start", "latest")


@query("a3_contact_days",
       "SELECT id, n, first_contact, last_contact, was_contacted FROM contacts")
def _(spark, sf):
    return rules.contact_days(acts(spark, sf)).select(
        F.col("AP_AM_REQUEST_ID").alias("id"), F.col("contact_days").alias("n"),
        "first_contact", "last_contact", "was_contacted")


@query("a4_contact_span",
       f"""SELECT id, n, CAST({O.business_days(O.local('first_contact'), O.local('last_contact'))}
                  AS BIGINT) AS span FROM contacts WHERE n > 0""")
def _(spark, sf):
    days = rules.contact_days(acts(spark, sf).filter(S.is_contact_action()))
    span = XT.business_days_between(
        XT.local(F.col("first_contact")), XT.local(F.col("last_contact")))
    return days.filter("contact_days > 0").select(
        F.col("AP_AM_REQUEST_ID").alias("id"), F.col("contact_days").alias("n"), span.alias("span"))


@query("a5_suspension_deadline",
       f"""SELECT id, suspended_at, {O.plus_business_days(O.local('suspended_at'), 5)} AS deadline
           FROM suspension WHERE suspended_at IS NOT NULL""")
def _(spark, sf):
    at = F.col("C_SUSPENDED_AT")
    return features.action_features(acts(spark, sf), features.SUSPENSION).filter(
        at.isNotNull()
    ).select(F.col("AP_AM_REQUEST_ID").alias("id"), at.alias("suspended_at"),
             XT.add_business_days(XT.local(at), 5).alias("deadline"))


@query("a6_observation_age",
       f"""SELECT t.id, CAST({O.minutes('o.at')} AS DOUBLE) AS minutes FROM t LEFT JOIN
           (SELECT id, max(start) AS at FROM a WHERE type_id = 108 GROUP BY id) o USING (id)""")
def _(spark, sf):
    return features.observation_age(clean(spark, sf), acts(spark, sf), now()).select(
        ticket_id(), nullable("C_LAST_ACTION_DATE", "minutes"))


@query("a7_rdv_state",
       "SELECT s.id, s.rdv_date, s.rdv_state, r.note FROM rdvstate s LEFT JOIN rdv r USING (id)")
def _(spark, sf):
    return features.with_rdv(clean(spark, sf), acts(spark, sf), now()).select(
        ticket_id(), F.col("C_RDV_DATE").alias("rdv_date"), F.col("C_RDV_STATE").alias("rdv_state"),
        F.col("AP_AM_DESCRIPTION").alias("note"))


_TECHNICIAN_SQL = """
    SELECT done_by AS tech_name, count(*) AS total_tickets, CAST(sum(points) AS BIGINT) AS score
    FROM complete WHERE done_by IS NOT NULL GROUP BY done_by"""


@query("a8_technician_totals", _TECHNICIAN_SQL)
def _(spark, sf):
    return reports.technician_totals(features.with_technician(scored(spark, sf), acts(spark, sf)))


@query("a9_total_score", "SELECT CAST(sum(points) AS BIGINT) AS value FROM scored")
def _(spark, sf):
    return reports.total_score(scored(spark, sf))


@query("a10_row_count", "SELECT count(*) AS value FROM t")
def _(spark, sf):
    return reports.row_count(clean(spark, sf))


_PIVOT_SQL = "SELECT id, rfc, catalog_id, " + ", ".join(
    f"max(CASE WHEN question = {number} THEN coalesce(answer, raw) END) AS {name}"
    for number, name in K.QUESTIONS.items()) + " FROM an GROUP BY id, rfc, catalog_id"


@query("a11_pivot_answers", _PIVOT_SQL)
def _(spark, sf):
    return features.pivot_answers(adapter.answers(spark, sf)).select(
        F.col("REQUEST_ID").alias("id"), F.col("RFC_NUMBER").alias("rfc"),
        F.col("SD_CATALOG_ID").alias("catalog_id"), *K.QUESTIONS.values())


@query("a12_latest_contact_per_day",
       "SELECT id, strftime(day, '%Y-%m-%d') AS day, latest FROM contactdays")
def _(spark, sf):
    return rules.latest_contact_per_day(acts(spark, sf)).select(
        F.col("AP_AM_REQUEST_ID").alias("id"), text_of_date(F.col("day")).alias("day"), "latest")


_AGE_DAYS = f"{O.minutes('submitted')} / 1440.0"


def _bins_sql(value: str, view: str) -> str:
    return f"""
        SELECT floor(v / step) * step AS bin_start, floor(v / step) * step + step AS bin_end,
               count(*) AS total
        FROM (SELECT CAST({value} AS DOUBLE) AS v FROM {view}) x,
             (SELECT CASE WHEN span / base <= 50 THEN base WHEN span / (base * 2) <= 50 THEN base * 2
                          WHEN span / (base * 5) <= 50 THEN base * 5 ELSE base * 10 END AS step
              FROM (SELECT span, pow(10.0, floor(log10(span / 50))) AS base
                    FROM (SELECT max(CAST({value} AS DOUBLE)) - min(CAST({value} AS DOUBLE)) AS span
                          FROM {view}))) s
        WHERE v IS NOT NULL GROUP BY ALL"""


_CI_COUNTS = "SELECT ci AS configuration_item, count(*) AS total FROM t GROUP BY ci"
_TYPE_COUNTS = "SELECT type_name AS inter_type, count(*) AS total FROM classed GROUP BY type_name"


@query("a13_counts_by_ci", _CI_COUNTS)
def _(spark, sf):
    return reports.counts_by(
        clean(spark, sf).withColumnRenamed("AP_SD_CI_NAME", "configuration_item"),
        "configuration_item")


@query("a14_age_histogram", _bins_sql(_AGE_DAYS, "t"))
def _(spark, sf):
    tickets = features.with_age(features.with_start_date(clean(spark, sf)), now())
    return reports.histogram(tickets, XT.fractional_days(F.col("C_TICKET_AGE")))


# -------------------------------------------------------------------- scoring

def component(name: str, part, points: str, words: str):
    @query(name, f"SELECT id, CAST({points} AS BIGINT) AS points, {words} AS words FROM parts")
    def _(spark, sf):
        found = part()
        return aged(spark, sf).select(
            ticket_id(), found.points().alias("points"), found.text().alias("words"))


component("c1_since_creation", scoring.since_creation, "c1", "w1")
component("c2_since_last_action", scoring.since_last_action, "c2", "w2")
component("c3_not_suspended", scoring.not_suspended, "c3", "w3")
component("c4_security", scoring.security, "c4", "w4")
component("c5_vip", lambda: scoring.vip(adapter.VIP_NAMES), "c5", "w5")
component("c6_industrial", scoring.industrial, "c6", "w6")


@query("c7_total_score", "SELECT id, points, why FROM scored")
def _(spark, sf):
    return scored(spark, sf).select(
        ticket_id(), F.col("C_POINTS").alias("points"), F.col("C_POINTS_JUSTIFICATION").alias("why"))


@query("c8_ticket_age", f"SELECT id, {O.minutes('submitted')} AS minutes FROM t")
def _(spark, sf):
    return features.with_age(features.with_start_date(clean(spark, sf)), now()).select(
        ticket_id(), F.col("C_TICKET_AGE").alias("minutes"))


@query("c9_classification", "SELECT id, CAST(itype AS BIGINT) AS itype, type_name FROM classed")
def _(spark, sf):
    return classed(spark, sf).select(
        ticket_id(), F.col("AP_INTERVENTION_TYPE").alias("itype"), F.col("AP_TYPE_FR").alias("type_name"))


# ------------------------------------------- windows, sorts, limits, set operations

@query("w1_numbered_rows",
       """SELECT ci, id, row_number() OVER (ORDER BY ci NULLS FIRST, id) AS row_number FROM t
          ORDER BY ci NULLS FIRST, id LIMIT 24""")
def _(spark, sf):
    return reports.first_rows(
        clean(spark, sf).select(F.col("AP_SD_CI_NAME").alias("ci"), ticket_id()), "ci", "id")


@query("w2_first_ranked",
       """SELECT ci, id FROM (
              SELECT ci, id, row_number() OVER (ORDER BY ci NULLS FIRST, id) AS r FROM t)
          WHERE r < 25""")
def _(spark, sf):
    tickets = clean(spark, sf).select(F.col("AP_SD_CI_NAME").alias("ci"), ticket_id())
    return reports.first_rows(tickets, "ci", "id").select("ci", "id")


@query("w3_first_per_group",
       "SELECT id, done_by, action_id FROM tech")
def _(spark, sf):
    return features.action_features(acts(spark, sf), features.TECHNICIAN).select(
        F.col("AP_AM_REQUEST_ID").alias("id"),
        F.col("AP_AM_DONE_BY_OPERATOR_NAME").alias("done_by"), action_id())


_EXPIRATION_SQL = f"""
    SELECT rfc AS AP_SD_RFC_NUMBER, type_name AS AP_TYPE_FR,
           {O.location('location')} AS AP_SD_RECIPIENT_LOCATION_RH,
           done_by AS AP_AM_DONE_BY_OPERATOR_NAME,
           strftime({O.local('due')}, '%d/%m/%y %H:%M') AS AP_SD_MAX_RESOLUTION_DATE
    FROM complete WHERE {O.UNSUSPENDED} AND due > {O.NOW}
    ORDER BY due, id LIMIT 25"""


@query("t1_mail_table",
       f"""SELECT rfc AS AP_SD_RFC_NUMBER, type_name AS AP_TYPE_FR,
                  {O.location('location')} AS AP_SD_RECIPIENT_LOCATION_RH,
                  done_by AS AP_AM_DONE_BY_OPERATOR_NAME
           FROM complete ORDER BY due NULLS LAST, id LIMIT 25""")
def _(spark, sf):
    return reports.mail_table(features.with_technician(classed(spark, sf), acts(spark, sf)))


@query("t2_expiration_table", _EXPIRATION_SQL)
def _(spark, sf):
    tickets = classed(spark, sf).filter(S.is_unexpired(now()))
    return reports.expiration_table(features.with_technician(tickets, acts(spark, sf)))


@query("t3_capped_extract",
       f"SELECT * FROM ({O.star_tickets('open_request')}) ORDER BY REQUEST_ID LIMIT 1000")
def _(spark, sf):
    return extracts.extract_tickets(adapter.service_desk(spark, sf), limit=1000).select(*_STAR_COLUMNS)


@query("t4_action_order",
       """SELECT id, max(CASE WHEN r1 = 1 THEN action_id END) AS open_or_newest,
                 max(CASE WHEN r2 = 1 THEN action_id END) AS earliest,
                 max(CASE WHEN r3 = 1 THEN action_id END) AS latest
          FROM (SELECT id, action_id,
                       row_number() OVER (PARTITION BY id ORDER BY start DESC NULLS FIRST, action_id DESC) AS r1,
                       row_number() OVER (PARTITION BY id ORDER BY start NULLS LAST, action_id) AS r2,
                       row_number() OVER (PARTITION BY id ORDER BY start DESC NULLS LAST, action_id DESC) AS r3
                FROM a) GROUP BY id""")
def _(spark, sf):
    return features.first_actions(acts(spark, sf)).withColumnRenamed("AP_AM_REQUEST_ID", "id")


@query("t5_types_by_count", _TYPE_COUNTS)
def _(spark, sf):
    return reports.counts_by(
        classed(spark, sf).withColumnRenamed("AP_TYPE_FR", "inter_type"), "inter_type")


@query("u1_open_request_ids",
       "SELECT REQUEST_ID FROM hotline_ids UNION SELECT REQUEST_ID FROM arrival_ids")
def _(spark, sf):
    return extracts.open_request_ids(adapter.service_desk(spark, sf))


@query("u2_complete_classification",
       """SELECT id, rfc, CAST(itype AS BIGINT) AS itype FROM cl
          UNION ALL SELECT id, rfc, 1 FROM t WHERE id NOT IN (SELECT id FROM cl)""")
def _(spark, sf):
    return C.complete(clean(spark, sf), adapter.classification(spark, sf)).select(
        F.col("AP_REQUEST_ID").alias("id"), F.col("AP_RFC_NUMBER").alias("rfc"),
        F.col("AP_INTERVENTION_TYPE").alias("itype"))


# ----------------------------------------------------------- scalar functions

def documents(spark, sf) -> DataFrame:
    return adapter.table(spark, sf, "documents")


def over_documents(name: str, expression, sql: str):
    @query(name, f"SELECT doc_id, {sql} AS value FROM documents")
    def _(spark, sf):
        return documents(spark, sf).select("doc_id", expression(F.col("text")).alias("value"))


over_documents("x1_strip_accents", X.strip_accents, "strip_accents(text)")
over_documents("x3_strip_greeting", X.strip_greeting, "regexp_replace(text, 'bonjour.?', '', 'gi')")
over_documents("x4_matches", lambda c: X.matches(c, K.PATTERN_SECURITY),
               O.found("text", K.PATTERN_SECURITY))
over_documents("x5_contains", lambda c: X.contains(c, "tablette"), "contains(text, 'tablette')")
over_documents("x6_startswith", lambda c: X.startswith(c, "D"), "starts_with(text, 'D')")
# Full case mapping of the sharp s, which DuckDB maps to its capital form.
over_documents("x7_upper", X.upper, "upper(replace(text, 'ß', 'ss'))")


@query("x2_strip_tags",
       "SELECT page_id, regexp_replace(html, '<[^<]+?>', '', 'g') AS value FROM pages")
def _(spark, sf):
    return adapter.table(spark, sf, "pages").select(
        "page_id", X.strip_tags(F.col("html")).alias("value"))


@query("x7_title_case",
       f"""SELECT p_partkey, {O.title("p_name || '-d''' || p_type")} AS value FROM part""")
def _(spark, sf):
    name = F.concat(F.col("p_name"), F.lit("-d'"), F.col("p_type"))
    return adapter.table(spark, sf, "part").select("p_partkey", X.title_case(name).alias("value"))


@query("x8_concat", "SELECT id, rfc || ' - ' || ci AS value FROM t")
def _(spark, sf):
    return clean(spark, sf).select(
        ticket_id(),
        X.joined(F.col("AP_SD_RFC_NUMBER"), " - ", F.col("AP_SD_CI_NAME")).alias("value"))


@query("x9_joined_texts", "SELECT id, why AS value FROM scored")
def _(spark, sf):
    return scored(spark, sf).select(ticket_id(), F.col("C_POINTS_JUSTIFICATION").alias("value"))


@query("x10_rdv_text",
       """SELECT action_id, nullif(regexp_extract(note, ':([0-9]{2}.[0-9]{2}.[0-9]{4})', 1), '') AS value
          FROM a""")
def _(spark, sf):
    return acts(spark, sf).select(
        action_id(), X.rdv_date_text(F.col("AP_AM_DESCRIPTION")).alias("value"))


@query("x11_location", f"SELECT id, {O.location('raw_location')} AS value FROM rt")
def _(spark, sf):
    return adapter.tickets(spark, sf).select(
        F.col("REQUEST_ID").alias("id"),
        X.display_location(F.col("RECIPIENT_LOCATION_RH")).alias("value"))


@query("x12_casts",
       """SELECT c_custkey, try_cast(substr(c_name, 10) AS BIGINT) AS number,
                 CAST(try_cast(c_name AS BIGINT) AS DOUBLE) AS none, CAST(c_custkey AS VARCHAR) AS shown FROM customer""")
def _(spark, sf):
    return adapter.table(spark, sf, "customer").select(
        "c_custkey", X.whole_number(F.col("c_name").substr(10, 20)).alias("number"),
        X.whole_number(F.col("c_name")).cast("double").alias("none"),
        X.shown(F.col("c_custkey")).alias("shown"))


@query("x13_parse_timestamp",
       """SELECT id, CASE WHEN id % 3 = 0 THEN submitted + to_milliseconds(CAST(id % 1000 AS DOUBLE)) END AS value
          FROM rt""")
def _(spark, sf):
    shown = F.col("SUBMIT_DATE_UT").cast("string")
    fraction = F.lpad((F.col("REQUEST_ID") % 1000).cast("string"), 3, "0")
    dated = F.when(F.col("REQUEST_ID") % 3 == 0, F.concat(shown, F.lit("."), fraction)).when(
        F.col("REQUEST_ID") % 3 == 1, shown).otherwise("2021-02-30 00:00:00.0")
    return adapter.tickets(spark, sf).select(
        F.col("REQUEST_ID").alias("id"), XT.parse_utc(dated).alias("value"))


@query("x14_parse_day",
       """SELECT action_id, try_strptime(regexp_extract(note, 'rdv:(.*)', 1), '%d/%m/%Y') AS value
          FROM a""")
def _(spark, sf):
    return acts(spark, sf).select(
        action_id(), XT.parse_day(X.rdv_date_text(F.col("AP_AM_DESCRIPTION"))).alias("value"))


@query("x15_reformat_day",
       """SELECT id, strftime(strptime(answer, '%d/%m/%Y'), '%Y-%m-%d') AS value
          FROM an WHERE question = 50""")
def _(spark, sf):
    return adapter.answers(spark, sf).filter("QUESTION_ID = 50").select(
        F.col("REQUEST_ID").alias("id"),
        XT.day_text(XT.parse_day(F.col("RESULT_STRING_FR"))).alias("value"))


@query("x16_seconds_between",
       f"""SELECT event_id, CAST(date_diff('microsecond', ts, {O.NOW}) AS DOUBLE) / 1e6 AS value
           FROM events""")
def _(spark, sf):
    return adapter.table(spark, sf, "events").select(
        "event_id", XT.seconds_between(F.col("ts"), now()).cast("double").alias("value"))


@query("x17_minutes_and_days",
       f"""SELECT event_id, m AS minutes, {O.days('m')} AS days
           FROM (SELECT event_id, {O.minutes('ts')} AS m FROM events)""")
def _(spark, sf):
    minutes = XT.minutes_between(F.col("ts"), now())
    return adapter.table(spark, sf, "events").select(
        "event_id", minutes.alias("minutes"), XT.whole_days(minutes).alias("days"))


@query("x18_add_business_days",
       "SELECT event_id, " + ", ".join(
           f"{O.plus_business_days(O.local('ts'), n)} AS plus_{n}" for n in (1, 2, 3, 5)
       ) + " FROM events")
def _(spark, sf):
    wall = XT.local(F.col("ts"))
    return adapter.table(spark, sf, "events").select(
        "event_id", *[XT.add_business_days(wall, n).alias(f"plus_{n}") for n in (1, 2, 3, 5)])


@query("x19_business_days_between",
       f"""SELECT id, CAST({O.business_days(O.local('first_start'), O.local('latest_start'))}
                  AS BIGINT) AS value FROM firstact WHERE first_start IS NOT NULL""")
def _(spark, sf):
    both = features.action_features(acts(spark, sf), features.FIRST_ACTION).withColumnRenamed(
        "C_ACTION_START", "first_start")
    late = features.action_features(acts(spark, sf), features.LATEST_ACTION).select(
        F.col("AP_AM_REQUEST_ID").alias("id"), "C_ACTION_START")
    pairs = joins.merge(both, late, "AP_AM_REQUEST_ID", "id", "inner")
    span = XT.business_days_between(
        XT.local(F.col("first_start")), XT.local(F.col("C_ACTION_START")))
    return pairs.filter("first_start IS NOT NULL").select("id", span.alias("value"))


@query("x20_local_date",
       f"SELECT event_id, strftime({O.local('ts')}, '%Y-%m-%d') AS value FROM events")
def _(spark, sf):
    return adapter.table(spark, sf, "events").select(
        "event_id", text_of_date(XT.local_date(F.col("ts"))).alias("value"))


@query("x21_formats",
       f"""SELECT event_id, strftime({O.local('ts')}, '%d/%m/%y %H:%M') AS short,
                  strftime(ts, '%Y-%m-%d') AS day FROM events""")
def _(spark, sf):
    return adapter.table(spark, sf, "events").select(
        "event_id", XT.short_text(XT.local(F.col("ts"))).alias("short"),
        XT.day_text(F.col("ts")).alias("day"))


@query("x22_calendar_millis",
       """SELECT id, coalesce(CAST(CAST(epoch_ms(rdv_date) AS BIGINT) + 3600000 AS VARCHAR), '') AS value
          FROM rdvstate""")
def _(spark, sf):
    return features.with_rdv(clean(spark, sf), acts(spark, sf), now()).select(
        ticket_id(), XT.calendar_millis_text(F.col("C_RDV_DATE")).alias("value"))


@query("x23_fractional_days", f"SELECT id, CAST({_AGE_DAYS} AS DOUBLE) AS value FROM t")
def _(spark, sf):
    tickets = features.with_age(features.with_start_date(clean(spark, sf)), now())
    return tickets.select(ticket_id(), XT.fractional_days(F.col("C_TICKET_AGE")).alias("value"))


@query("x24_conditional_color",
       """SELECT id, CASE WHEN pc = 0 AND tel = 0 THEN 'green' ELSE 'blue' END AS value FROM (
              SELECT id, max(CASE WHEN question = 55 AND answer = 'Non' THEN 1 ELSE 0 END) AS pc,
                     max(CASE WHEN question = 58 AND answer = 'Oui' THEN 1 ELSE 0 END) AS tel
              FROM an GROUP BY id)""")
def _(spark, sf):
    found = flows.employee_movement_calendar(adapter.desk(spark, sf, with_answers=True))
    return found.select(
        F.col("extendedProps")["SPOT"].substr(2, 9).cast("bigint").alias("id"),
        F.col("color").alias("value"))


@query("x25_fill_null", "SELECT action_id, coalesce(note, '') AS value FROM a")
def _(spark, sf):
    return acts(spark, sf).select(
        action_id(), X.or_empty(F.col("AP_AM_DESCRIPTION")).alias("value"))


# ----------------------------------------------------------- calendar operators

_EMPLOYEE_SQL = f"""
    SELECT rfc || ' - ' || upper(NOM) || ', ' || {O.title('PRENOM')} || ' - ' || {O.location('LOCATION')}
             || ' - PC:' || CAST(pc AS VARCHAR) || ' Tel:' || CAST(tel AS VARCHAR) AS title,
           strftime(strptime(ARRIVAL_DATE, '%d/%m/%Y'), '%Y-%m-%d') AS start,
           CASE WHEN catalog_id = 5535 AND pc = 0 AND tel = 0 THEN 'green' ELSE 'blue' END AS color,
           rfc, upper(NOM) AS name, {O.title('PRENOM')} AS first_name, {O.location('LOCATION')} AS location,
           CONTRACT AS contract, pc, tel
    FROM (SELECT *, CAST(CASE WHEN PC_PRESENT = 'Non' THEN 1 ELSE 0 END AS BIGINT) AS pc,
                 CAST(CASE WHEN TELEPHONE = 'Oui' THEN 1 ELSE 0 END AS BIGINT) AS tel
          FROM ({_PIVOT_SQL}))"""


def flat_employee(df: DataFrame) -> DataFrame:
    props = F.col("extendedProps")
    return df.select(
        "title", "start", "color", props["SPOT"].alias("rfc"), props["Nom"].alias("name"),
        props["Prenom"].alias("first_name"), props["Location"].alias("location"),
        props["Contract"].alias("contract"), props["PC"].cast("bigint").alias("pc"),
        props["Telephone"].cast("bigint").alias("tel"))


@query("k1_employee_events", _EMPLOYEE_SQL)
def _(spark, sf):
    return flat_employee(events.employee_events(features.pivot_answers(adapter.answers(spark, sf))))


@query("k2_rdv_events", _RDV_EVENT_SQL)
def _(spark, sf):
    tickets = features.with_rdv(classed(spark, sf), acts(spark, sf), now())
    return flat_rdv(events.rdv_events(tickets))


# --------------------------------------------------------------- expectations

@query("e1_required_columns", "SELECT id FROM t")
def _(spark, sf):
    return quality.require_columns(aged(spark, sf), scoring.NEEDED_COLUMNS).select(ticket_id())


@query("e2_tickets_without_action",
       "SELECT id FROM t WHERE id NOT IN (SELECT id FROM tech)")
def _(spark, sf):
    return quality.tickets_without_action(
        clean(spark, sf), acts(spark, sf), features.TECHNICIAN.rows()).select(ticket_id())


@query("e3_duplicate_keys",
       """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS occurrences
          FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    lines = adapter.table(spark, sf, "lineitem").withColumn(
        "l_linenumber", F.col("l_linenumber").cast("bigint"))
    return quality.duplicates(lines, "l_orderkey", "l_linenumber")


@query("e4_repeated_answers",
       """SELECT id AS "REQUEST_ID", CAST(45 AS BIGINT) AS "QUESTION_ID", CAST(2 AS BIGINT) AS occurrences
          FROM an WHERE question = 45 AND id % 3 = 0""")
def _(spark, sf):
    answers = adapter.answers(spark, sf)
    again = answers.filter("QUESTION_ID = 45 AND REQUEST_ID % 3 = 0")
    return quality.repeated_answers(answers.unionByName(again))


@query("e5_unparsed_dates",
       """SELECT count(*) AS unparsed FROM a
          WHERE note LIKE '%rdv:%' AND try_strptime(regexp_extract(note, 'rdv:(.*)', 1), '%d/%m/%Y') IS NULL""")
def _(spark, sf):
    shown = X.rdv_date_text(F.col("AP_AM_DESCRIPTION"))
    return quality.unparsed(acts(spark, sf), shown, XT.parse_day(shown))


@query("e6_has_old_action", f"SELECT bool_or({O.minutes('start')} > 0) AS has_old_action FROM a")
def _(spark, sf):
    return quality.has_old_action(acts(spark, sf), now())


@query("e_report",
       f"""SELECT 'ticket without assignment' AS expectation, count(*) AS violations
           FROM t WHERE id NOT IN (SELECT id FROM tech)
           UNION ALL SELECT 'repeated ticket', count(*) FROM (
               SELECT id FROM t GROUP BY id HAVING count(*) > 1)
           UNION ALL SELECT 'repeated action', count(*) FROM (
               SELECT action_id FROM a GROUP BY action_id HAVING count(*) > 1)
           UNION ALL SELECT 'repeated answer', count(*) FROM (
               SELECT id, question FROM an GROUP BY id, question HAVING count(*) > 1)
           UNION ALL SELECT 'unparsed appointment', count(*) FROM a WHERE note LIKE '%rdv:%'
               AND try_strptime(regexp_extract(note, 'rdv:(.*)', 1), '%d/%m/%Y') IS NULL
           UNION ALL SELECT 'no old action', CAST(NOT bool_or({O.minutes('start')} > 0) AS BIGINT)
           FROM a""")
def _(spark, sf):
    return flows.quality_report(adapter.desk(spark, sf, with_answers=True))


# ------------------------------------------------------------------ workflows

def flow(name: str, sql: str, run, flat=None):
    @query(name, sql)
    def _(spark, sf):
        found = run(adapter.desk(spark, sf))
        return flat(found) if flat else found


@query("q1_employee_movement_calendar", _EMPLOYEE_SQL)
def _(spark, sf):
    desk = adapter.desk(spark, sf, with_answers=True)
    return flat_employee(flows.employee_movement_calendar(desk))


TECH = "hotline|supplier#00000000(1|3)"
_TECH_WHERE = f"regexp_matches(done_by, '{TECH}', 'i')"
_OBSERVED = "id IN (SELECT id FROM observed)"
_INSTALL = f"catalog_id IN ({O.values(K.CATALOG_SOFTWARE_INSTALL)})"
_DUE = "status IN (39, 42) AND id IN (SELECT id FROM due_contact)"
_OFTEN = "status IN (39, 42) AND urgency = 5 AND id IN (SELECT id FROM often_contacted)"

flow("q2_rdv_calendar", _RDV_EVENT_SQL, flows.rdv_calendar, flat_rdv)
flow("q3_under_observation_rows", O.row_list(_OBSERVED), flows.under_observation_rows)
flow("q4_under_observation_count", O.count(_OBSERVED), flows.under_observation_count)
flow("q4_under_observation_count_by_technician", O.count(f"{_OBSERVED} AND {_TECH_WHERE}"),
     lambda d: flows.under_observation_count(d, TECH))
flow("q5_software_install_rows", O.row_list(_INSTALL), flows.software_install_rows)
flow("q6_software_install_count", O.count(_INSTALL), flows.software_install_count)
flow("q7_new_arrivals_rows", O.row_list("catalog_id = 5535"), flows.new_arrivals_rows)
flow("q8_new_arrivals_count", O.count("catalog_id = 5535"), flows.new_arrivals_count)
flow("q9_suspended_mail_table", _MAIL_TABLE_SQL, flows.suspended_mail_table)
flow("q9_suspended_mail_table_by_technician", _MAIL_TABLE_SQL.replace(
     "ORDER BY", f"AND {_TECH_WHERE} ORDER BY"), lambda d: flows.suspended_mail_table(d, TECH))
flow("q10_suspended_mail_rows", O.row_list(_DUE), flows.suspended_mail_rows)
flow("q11_suspended_mail_count", O.count(_DUE), flows.suspended_mail_count)
flow("q12_suspended_too_long_rows", O.row_list(_overdue(1, "itype = 2")),
     lambda d: flows.suspended_too_long_rows(d, "hotline"))
flow("q12_suspended_too_long_rows_proxy", O.row_list(_overdue(5, O.PROXY)),
     lambda d: flows.suspended_too_long_rows(d, "proxy"))
flow("q13_suspended_too_long_count", O.count(_overdue(1, "itype = 2")),
     lambda d: flows.suspended_too_long_count(d, "hotline"))
flow("q14_contacted_rows", O.row_list(_OFTEN), flows.contacted_rows)
flow("q15_contacted_count", O.count(_OFTEN), flows.contacted_count)
flow("q16_not_suspended_rows", O.row_list(O.UNSUSPENDED), flows.not_suspended_rows)
flow("q17_not_suspended_count", O.count(O.UNSUSPENDED), flows.not_suspended_count)
flow("q18_industrial_rows", O.row_list(O.INDUSTRIAL), flows.industrial_rows)
flow("q19_industrial_count", O.count(O.INDUSTRIAL), flows.industrial_count)
flow("q20_security_rows", O.row_list(O.SECURITY), flows.security_rows)
flow("q21_security_count", O.count(O.SECURITY), flows.security_count)
flow("q21_security_count_by_technician", O.count(f"{O.SECURITY} AND {_TECH_WHERE}"),
     lambda d: flows.security_count(d, TECH))
flow("q22_vip_count", O.count(O.VIP), flows.vip_count)
flow("q23_vip_rows", O.row_list(O.VIP), flows.vip_rows)
flow("q24_ticket_flow_rows", O.row_list("kind = 0 AND itype = 2"),
     lambda d: flows.ticket_flow_rows(d, "incident+hotline"))
flow("q24_ticket_flow_rows_all", O.row_list(), flows.ticket_flow_rows)
flow("q24_ticket_flow_rows_by_technician", O.row_list(_TECH_WHERE),
     lambda d: flows.ticket_flow_rows(d, tech_filter=TECH))
flow("q25_ticket_flow_count", O.count("kind = 1 AND itype BETWEEN 3 AND 16"),
     lambda d: flows.ticket_flow_count(d, "request+proxy"))
flow("q26_ticket_flow_score",
     "SELECT CAST(sum(points) AS BIGINT) AS value FROM complete WHERE itype = 1",
     lambda d: flows.ticket_flow_score(d, "unclassified"))
flow("q26_ticket_flow_score_all", "SELECT CAST(sum(points) AS BIGINT) AS value FROM scored",
     flows.ticket_flow_score)
flow("q27_tickets_by_expiration", _EXPIRATION_SQL, flows.tickets_by_expiration)
flow("q27_tickets_by_expiration_by_technician", _EXPIRATION_SQL.replace(
     "ORDER BY", f"AND {_TECH_WHERE} ORDER BY"), lambda d: flows.tickets_by_expiration(d, TECH))
flow("q28_technician_table", _TECHNICIAN_SQL, flows.technician_table)


@query("q29_classification_change", _CHANGED_SQL)
def _(spark, sf):
    change = flows.change_classification(adapter.desk(spark, sf), type_updates(spark, sf))
    return change.classification.select(
        F.col("AP_REQUEST_ID").alias("id"), F.col("AP_INTERVENTION_TYPE").alias("itype"))


def chart(name: str, sql: str, category: str, value: str, piece: str):
    flow(name, sql, lambda d: flows.chart_data(d, category, value)[piece])


chart("q30_ci_bars", _CI_COUNTS, "configuration_item", "age", "bars")
chart("q30_type_bars", _TYPE_COUNTS, "inter_type", "points", "bars")
chart("q30_age_bins", _bins_sql(_AGE_DAYS, "t"), "configuration_item", "age", "bins")
chart("q30_points_bins", _bins_sql("points", "scored"), "inter_type", "points", "bins")
flow("q30_chart_tickets",
     """SELECT rfc AS ticket_number, ci AS configuration_item, type_name AS inter_type,
               age / 1440.0 AS age, points FROM complete""", flows.chart_tickets)
chart("q30_first_rows",
      """SELECT rfc AS ticket_number, type_name AS inter_type,
                row_number() OVER (ORDER BY rfc, id) AS row_number
         FROM t JOIN classed USING (id) ORDER BY rfc, id LIMIT 24""",
      "inter_type", "age", "rows")
