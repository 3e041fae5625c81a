"""Calendar events: nested records for the two calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deskgauge import constants as K
from deskgauge.functions import text as X
from deskgauge.functions import time as XT
from deskgauge.operators import selectors

EVENT_COLUMNS = ("title", "start", "color", "extendedProps")


def _event(title: Column, start: Column, color: Column, props: dict[str, Column]):
    nested = F.struct(*[value.alias(name) for name, value in props.items()])
    return [title.alias("title"), start.alias("start"), color.alias("color"),
            nested.alias("extendedProps")]


def employee_events(people: DataFrame) -> DataFrame:
    """One event per new arrival, from the pivoted questionnaire.

    A "no" to "PC present" means a PC must be prepared.
    """
    flag = lambda condition: F.when(condition, 1).otherwise(0)
    people = people.withColumns({
        "NOM": X.upper(F.col("NOM")),
        "PRENOM": X.title_case(F.col("PRENOM")),
        "LOCATION": X.display_location(F.col("LOCATION")),
        "ARRIVAL_DATE": XT.day_text(XT.parse_day(F.col("ARRIVAL_DATE"))),
        "PC": flag(F.col("PC_PRESENT") == "Non"),
        "TELEPHONE": flag(F.col("TELEPHONE") == "Oui"),
    })
    needs_visit = (F.col("PC") == 1) | (F.col("TELEPHONE") == 1)
    is_arrival = X.member(F.col("SD_CATALOG_ID"), (K.CATALOG_NEW_ARRIVAL,))
    title = X.joined(
        F.col("RFC_NUMBER"), " - ", F.col("NOM"), ", ", F.col("PRENOM"),
        " - ", F.col("LOCATION"), " - PC:", F.col("PC"), " Tel:", F.col("TELEPHONE"),
    )
    return people.select(*_event(
        title,
        F.col("ARRIVAL_DATE"),
        F.when(is_arrival & ~needs_visit, "green").otherwise("blue"),
        {
            "SPOT": F.col("RFC_NUMBER"),
            "Nom": F.col("NOM"),
            "Prenom": F.col("PRENOM"),
            "Location": F.col("LOCATION"),
            "Contract": F.col("CONTRACT"),
            "Arrivée": F.col("ARRIVAL_DATE"),
            "PC": F.col("PC"),
            "Telephone": F.col("TELEPHONE"),
        },
    ))


def _location_color(location: Column) -> Column:
    color = F.lit("")
    for prefix, value in K.RDV_COLORS.items():
        color = F.when(location.startswith(prefix), value).otherwise(color)
    return color


def rdv_events(tickets: DataFrame) -> DataFrame:
    """One event per dated appointment; the title keeps the raw location."""
    raw_location = F.col("AP_SD_RECIPIENT_LOCATION_RH")
    title = X.joined(
        F.col("AP_SD_RFC_NUMBER"), " - ", F.col("AP_SD_RECIPIENT_LAST_NAME"),
        ", ", raw_location, " - ", F.col("AP_TYPE_FR"),
    )
    location = X.display_location(raw_location)
    return tickets.filter(selectors.has_dated_rdv()).select(*_event(
        title,
        XT.day_text(XT.local(F.col("C_RDV_DATE"))),
        _location_color(location),
        {
            "SPOT": F.col("AP_SD_RFC_NUMBER"),
            "Nom": F.col("AP_SD_RECIPIENT_LAST_NAME"),
            "Location": location,
            "Ticket type": F.col("AP_TYPE_FR"),
            "Description": F.col("AP_SD_COMMENT"),
        },
    ))


def as_json(events: DataFrame) -> DataFrame:
    """Events as one JSON text per row."""
    return events.select(F.to_json(F.struct(*EVENT_COLUMNS)).alias("event"))
