"""Small frames in the shape of the extracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskgauge import schemas
from deskgauge.functions import time as XT
from deskgauge.operators import cleaning
from deskgauge.plans.flows import Desk
from deskgauge.sources.readers import from_records

AS_OF = "2024-04-10 10:00:00"


def stamp(text):
    """Date text with the fraction the default format asks for."""
    return None if text is None else text + ".0"


def ticket(request_id, **values):
    row = {
        "REQUEST_ID": request_id, "RFC_NUMBER": f"I{request_id:06d}",
        "SUBMIT_DATE_UT": "2024-03-31 10:00:00", "STATUS_ID": 12, "URGENCY_ID": 5,
        "SD_CATALOG_ID": 1000, "CI_ID": 1, "REQUESTOR_LAST_NAME": "Durand",
        "RECIPIENT_LAST_NAME": "Martin", "RECIPIENT_LOCATION_RH": "CNR JEAN BART",
        "COMMENT": "écran noir",
    }
    row.update(values)
    row["SUBMIT_DATE_UT"] = stamp(row["SUBMIT_DATE_UT"])
    row["MAX_RESOLUTION_DATE_UT"] = stamp(row.get("MAX_RESOLUTION_DATE_UT"))
    return row


def action(action_id, request_id, start=None, kind=20, done_by="x", **values):
    return {
        "ACTION_ID": action_id, "REQUEST_ID": request_id,
        "RFC_NUMBER": f"I{request_id or 0:06d}", "ACTION_TYPE_ID": kind,
        "START_DATE_UT": stamp(start), "DONE_BY_NAME": done_by,
        "ACTION_LABEL_FR": "Traitement", "GROUP_FR": "Hotline", **values,
    }


def raw_tickets(spark, *rows):
    return from_records(spark, rows, schemas.TICKETS)


def raw_actions(spark, *rows):
    return from_records(spark, rows, schemas.ACTIONS)


def tickets(spark, *rows):
    return cleaning.clean_tickets(raw_tickets(spark, *rows))


def actions(spark, *rows):
    return cleaning.clean_actions(raw_actions(spark, *rows))


def types(spark):
    return spark.range(1, 17).select(
        "id", *[F.concat(F.lit("Type "), F.col("id").cast("string")).alias(name)
                for name in ("AP_TYPE", "AP_TYPE_FR", "AP_Description", "AP_Description_FR")])


def classification(spark, rows=()):
    return spark.createDataFrame(
        [(i, request, f"I{request:06d}", kind) for i, (request, kind) in enumerate(rows)],
        schemas.CLASSIFICATION)


def desk(spark, ticket_rows, action_rows, classes=(), vip=()):
    return Desk(raw_tickets(spark, *ticket_rows), raw_actions(spark, *action_rows),
                classification(spark, classes), types(spark),
                as_of=XT.moment(AS_OF), vip_names=vip)


def values(df, *columns):
    """Rows as tuples, sorted with nulls first."""
    rows = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(rows, key=lambda row: [(v is not None, v) for v in row])
