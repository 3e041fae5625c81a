"""The three extracts from the service-desk tables.

Open tickets are those with an unfinished hotline action and those of the
new-arrival catalog entry that are not closed.  The tickets and actions to
extract are reduced first; the lookups run on what is left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from deskgauge import constants as K
from deskgauge import schemas
from deskgauge.functions import text as X
from deskgauge.sources import idsets


@dataclass(frozen=True)
class ServiceDesk:
    """The source tables, by their source names."""

    sd_request: DataFrame
    am_action: DataFrame
    sd_question_result: DataFrame
    am_employee: DataFrame
    sd_catalog: DataFrame
    sd_status: DataFrame
    sd_urgency: DataFrame
    am_asset: DataFrame
    am_group: DataFrame
    am_action_type: DataFrame


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str,
           columns: dict[str, str], how: str = "left") -> DataFrame:
    """Add ``columns`` of a lookup table; ``inner`` drops dangling keys."""
    side = table.select(
        F.col(table_key).alias("_key"),
        *[F.col(source).alias(name) for source, name in columns.items()],
    )
    return df.join(side, df[key] == side["_key"], how).drop("_key")


def is_open_new_arrival() -> Column:
    """Never null, so that it can be negated."""
    status = F.col("STATUS_ID")
    return (
        X.member(F.col("SD_CATALOG_ID"), (K.CATALOG_NEW_ARRIVAL,))
        & F.col("RFC_NUMBER").isNotNull()
        & status.isNotNull()
        & ~status.isin(*K.STATUS_CLOSED)
    )


# Side tables that the extracts look names up in.
LOOKUPS = ("am_employee", "sd_catalog", "sd_status", "sd_urgency", "am_asset", "am_group",
           "am_action_type")


def open_hotline_ids(actions: DataFrame) -> DataFrame:
    """Distinct requests with an unfinished action of the hotline group."""
    return actions.filter(
        F.col("END_DATE_UT").isNull()
        & (F.col("GROUP_ID") == K.GROUP_HOTLINE)
        & F.col("REQUEST_ID").isNotNull()
    ).select("REQUEST_ID").distinct()


def open_ids(desk: ServiceDesk, hotline_ids: DataFrame | None = None) -> DataFrame:
    """Requests of either kind, those of both kinds twice."""
    hotline = open_hotline_ids(desk.am_action) if hotline_ids is None else hotline_ids
    arrivals = desk.sd_request.filter(is_open_new_arrival()).select("REQUEST_ID")
    return hotline.union(arrivals)


def open_request_ids(desk: ServiceDesk, hotline_ids: DataFrame | None = None) -> DataFrame:
    """Distinct requests of either kind."""
    return open_ids(desk, hotline_ids).distinct()


def wanted_requests(desk: ServiceDesk, hotline_ids: DataFrame | None = None) -> DataFrame:
    """Distinct open requests with their RFC number, null for dangling ids."""
    return lookup(open_request_ids(desk, hotline_ids), desk.sd_request,
                  "REQUEST_ID", "REQUEST_ID", {"RFC_NUMBER": "RFC_NUMBER"})


def open_requests(desk: ServiceDesk, hotline_ids: DataFrame | None = None,
                  hotline_bits: DataFrame | None = None) -> DataFrame:
    """Ticket rows to extract.

    New arrivals are a plain filter of the ticket scan.  Only the others meet
    the open ids, in a semi join; an OR of both would shuffle every ticket.  With
    the ids as bitmaps too, ``hotline_bits``, no ticket is shuffled to meet them.
    """
    requests = desk.sd_request
    others = requests.filter(
        ~is_open_new_arrival() & F.col("MAX_RESOLUTION_DATE_UT").isNotNull())
    if hotline_bits is not None:
        others = idsets.possible(
            others.filter(F.col("REQUEST_ID").isNotNull()), "REQUEST_ID", hotline_bits)
    else:
        hotline = open_hotline_ids(desk.am_action) if hotline_ids is None else hotline_ids
        others = others.join(hotline, "REQUEST_ID", "left_semi")
    return requests.filter(is_open_new_arrival()).unionByName(others)


def star_join_tickets(desk: ServiceDesk, requests: DataFrame) -> DataFrame:
    """Ticket rows with their lookups.

    Name and location of requestor and recipient come from one lookup each:
    the inner join on the name already guarantees the location's row.
    """
    people, assets = desk.am_employee, desk.am_asset
    df = lookup(requests, people, "SUBMITTED_BY", "EMPLOYEE_ID",
                {"LAST_NAME": "SUBMITTED_BY_LAST_NAME"}, "inner")
    for role in ("REQUESTOR", "RECIPIENT"):
        df = lookup(df, people, f"{role}_ID", "EMPLOYEE_ID", {
            "LAST_NAME": f"{role}_LAST_NAME",
            "AVAILABLE_FIELD_6": f"{role}_LOCATION_RH",
        }, "inner")
    df = lookup(df, people, "OWNER_ID", "EMPLOYEE_ID", {"LAST_NAME": "OWNER_LAST_NAME"})
    df = lookup(df, desk.sd_catalog, "SD_CATALOG_ID", "SD_CATALOG_ID",
                {"TITLE_FR": "CATALOG_NAME"}, "inner")
    df = lookup(df, desk.sd_status, "STATUS_ID", "STATUS_ID",
                {"STATUS_FR": "STATUS_FR"}, "inner")
    df = lookup(df, desk.sd_urgency, "URGENCY_ID", "URGENCY_ID",
                {"URGENCY_FR": "URGENCY_FR"}, "inner")
    df = lookup(df, assets, "CI_ID", "ASSET_ID", {"NETWORK_IDENTIFIER": "CI_NAME"})
    df = lookup(df, assets, "ASSET_ID", "ASSET_ID", {"ASSET_TAG": "ASSET_TAG"})
    df = lookup(df, desk.am_group, "OWNING_GROUP_ID", "GROUP_ID",
                {"GROUP_FR": "OWNING_GROUP_NAME"})
    return df.select(*schemas.TICKETS.names)


def named_actions(desk: ServiceDesk, actions: DataFrame) -> DataFrame:
    """Action rows with their lookups."""
    df = lookup(actions, desk.am_action_type, "ACTION_TYPE_ID", "ACTION_TYPE_ID",
                {"NAME_FR": "ACTION_TYPE"})
    df = lookup(df, desk.am_group, "GROUP_ID", "GROUP_ID", {"GROUP_FR": "GROUP_FR"})
    return lookup(df, desk.am_employee, "DONE_BY_ID", "EMPLOYEE_ID",
                  {"LAST_NAME": "DONE_BY_NAME"})


def star_join_actions(desk: ServiceDesk, actions: DataFrame) -> DataFrame:
    """Action rows that already carry RFC_NUMBER, with their lookups."""
    return named_actions(desk, actions).select(*schemas.ACTIONS.names)


def _first(df: DataFrame, limit: int | None, *order: str) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit)


def extract_tickets(desk: ServiceDesk, limit: int | None = None,
                    hotline_ids: DataFrame | None = None,
                    hotline_bits: DataFrame | None = None) -> DataFrame:
    """Open tickets; ``limit`` keeps the lowest request ids, default all.

    ``hotline_ids`` is a stored result of :func:`open_hotline_ids`: its size
    is known when the join is planned.  ``hotline_bits`` are their bitmaps.
    """
    tickets = star_join_tickets(desk, open_requests(desk, hotline_ids, hotline_bits))
    return _first(tickets, limit, "REQUEST_ID")


def extract_actions(desk: ServiceDesk, limit: int | None = None,
                    wanted: DataFrame | None = None, buckets: int = 0) -> DataFrame:
    """Actions of open tickets.

    The wanted ids take their RFC number along, so the actions, the big side,
    meet the ticket side in a single join.  ``wanted`` is a stored result of
    :func:`wanted_requests`.

    With ``buckets`` the desk holds only actions of open tickets already.  They meet
    the wanted ids last, in as many partitions by request: stored in as many buckets
    they are not shuffled again.
    """
    if wanted is None:
        wanted = wanted_requests(desk)
    kept = desk.am_action.filter(
        ~F.col("ACTION_TYPE_ID").isin(*K.ACTION_NOT_EXTRACTED)
    )
    rfc = {"RFC_NUMBER": "RFC_NUMBER"}
    if buckets:
        named = named_actions(desk, kept.filter(F.col("REQUEST_ID").isNotNull()))
        actions = lookup(named.repartition(buckets, "REQUEST_ID"),
                         wanted.repartition(buckets, "REQUEST_ID"),
                         "REQUEST_ID", "REQUEST_ID", rfc, "inner").select(*schemas.ACTIONS.names)
    else:
        actions = lookup(kept, wanted, "REQUEST_ID", "REQUEST_ID", rfc, "inner")
        actions = star_join_actions(desk, actions)
    return _first(actions, limit, "REQUEST_ID", "ACTION_ID")


def extract_answers(desk: ServiceDesk, limit: int | None = None) -> DataFrame:
    """Questionnaire answers of open new arrivals."""
    arrivals = desk.sd_request.filter(is_open_new_arrival())
    answers = desk.sd_question_result.filter(F.col("QUESTION_ID").isin(*K.QUESTIONS))
    answers = lookup(answers, arrivals, "REQUEST_ID", "REQUEST_ID", {
        "RFC_NUMBER": "RFC_NUMBER", "SD_CATALOG_ID": "SD_CATALOG_ID",
    }, "inner").select(*schemas.ANSWERS.names)
    return _first(answers, limit, "REQUEST_ID", "QUESTION_ID", "RESULT_STRING_FR", "RESULT")
