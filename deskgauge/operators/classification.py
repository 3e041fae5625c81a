"""Intervention classification: reading it, completing it, changing it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from deskgauge import constants as K
from deskgauge.operators import joins


def _types_by_id(types: DataFrame) -> DataFrame:
    return types.select(F.col("id").alias("_type_id"), "AP_TYPE_FR", "AP_Description_FR")


def label_types(classification: DataFrame, types: DataFrame) -> DataFrame:
    """Classification rows with the French label of their type."""
    labels = _types_by_id(types)
    return classification.join(
        labels, classification["AP_INTERVENTION_TYPE"] == labels["_type_id"], "left"
    ).drop("_type_id")


def with_classification(tickets: DataFrame, classification: DataFrame,
                        types: DataFrame) -> DataFrame:
    """Tickets with type id, label and description; type 1 where unseen.

    Reading does not write: :func:`missing_rows` gives the rows to append.
    """
    known = classification.select("AP_REQUEST_ID", "AP_INTERVENTION_TYPE")
    merged = joins.merge(tickets, known, "AP_SD_REQUEST_ID", "AP_REQUEST_ID")
    merged = merged.withColumns({
        "AP_REQUEST_ID": F.col("AP_SD_REQUEST_ID"),
        "AP_INTERVENTION_TYPE": F.coalesce(
            "AP_INTERVENTION_TYPE", F.lit(K.INTERVENTION_UNCLASSIFIED).cast("bigint")
        ),
    })
    return label_types(merged, types)


def one_per_request(classification: DataFrame) -> DataFrame:
    """Classification with one row per request: the one with the greatest id.

    Rows without an id, the appended ones, give way; among equals the greatest
    type stays.
    """
    columns = classification.columns
    rank = F.struct(F.col("id").isNotNull(), "id", "AP_INTERVENTION_TYPE", "AP_RFC_NUMBER")
    kept = classification.groupBy("AP_REQUEST_ID").agg(
        F.max_by(F.struct(*[c for c in columns if c != "AP_REQUEST_ID"]), rank).alias("_row"))
    return kept.select("AP_REQUEST_ID", "_row.*").select(*columns)


def missing_rows(tickets: DataFrame, classification: DataFrame) -> DataFrame:
    """Default rows, one per request, for tickets that have no classification yet."""
    return (
        joins.unclassified(tickets, classification)
        .groupBy(F.col("AP_SD_REQUEST_ID").alias("AP_REQUEST_ID"))
        .agg(F.max("AP_SD_RFC_NUMBER").alias("AP_RFC_NUMBER"))
        .select(
            F.lit(None).cast("bigint").alias("id"), "AP_REQUEST_ID", "AP_RFC_NUMBER",
            F.lit(K.INTERVENTION_UNCLASSIFIED).cast("bigint").alias("AP_INTERVENTION_TYPE"),
        )
    )


def complete(tickets: DataFrame, classification: DataFrame) -> DataFrame:
    """Classification with exactly one row for every stored request and ticket."""
    return one_per_request(classification).unionByName(missing_rows(tickets, classification))


UNKNOWN_TYPE = "unknown type"
UNKNOWN_REQUEST = "unknown request"


@dataclass(frozen=True)
class TypeChange:
    """Outcome of a batch of type changes; ``rejects`` carry a ``reason``."""

    classification: DataFrame
    rejects: DataFrame


def change_types(classification: DataFrame, types: DataFrame, updates: DataFrame,
                 tickets: DataFrame) -> TypeChange:
    """Apply a batch of (request id, French type label) changes.

    Every ticket has a type, stored or the default, so a change of a ticket
    without a row adds the row.  The newest change of a request wins (greatest
    label on a tie).  Changes with an unknown label, and those of a request
    that is neither stored nor a ticket, change nothing and come back as
    rejects.
    """
    whole = complete(tickets, classification)
    by_label = types.select(F.col("id").alias("_new_type"), "AP_TYPE_FR")
    known = whole.select(F.col("AP_REQUEST_ID").alias("_known"))
    resolved = updates.join(by_label, "AP_TYPE_FR", "left").join(
        known, F.col("AP_REQUEST_ID") == F.col("_known"), "left")
    reason = F.when(F.col("_new_type").isNull(), UNKNOWN_TYPE).when(
        F.col("_known").isNull(), UNKNOWN_REQUEST)
    judged = resolved.withColumn("reason", reason).drop("_known")
    rejects = judged.filter(F.col("reason").isNotNull()).drop("_new_type")
    newest = (
        judged.filter(F.col("reason").isNull())
        .groupBy(F.col("AP_REQUEST_ID").alias("_request"))
        .agg(F.max_by("_new_type", F.struct("requested_at", "AP_TYPE_FR")).alias("_new_type"))
    )
    changed = (
        whole.join(newest, whole["AP_REQUEST_ID"] == newest["_request"], "left")
        .withColumn("AP_INTERVENTION_TYPE", F.coalesce("_new_type", "AP_INTERVENTION_TYPE"))
        .drop("_request", "_new_type")
    )
    return TypeChange(changed, rejects)
