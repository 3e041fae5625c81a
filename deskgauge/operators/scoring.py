"""Ticket scoring: six components per ticket, added up without a join."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from deskgauge import constants as K
from deskgauge.functions import text as X
from deskgauge.functions import time as XT
from deskgauge.operators import selectors
from deskgauge.operators.columns import require_columns

NEEDED_COLUMNS = ("C_TICKET_TYPE", "C_TICKET_AGE", "C_LAST_ACTION_DATE",
                  "AP_SD_URGENCY_ID", "AP_SD_STATUS_ID")


@dataclass(frozen=True, eq=False)
class Component:
    """One part of the score.

    ``grant`` is a struct (base, per_day, text), null where the part does not
    apply; ``minutes`` names the duration whose whole days count, if any.  A
    null duration gives no points at all, but keeps the text.
    """

    name: str
    grant: Column
    minutes: str | None = None

    def points(self, grant: Column | None = None) -> Column:
        grant = self.grant if grant is None else grant
        points = grant["base"]
        if self.minutes:
            points = points + XT.whole_days(F.col(self.minutes)) * grant["per_day"]
        return F.coalesce(points, F.lit(0)).cast("bigint")

    def text(self, grant: Column | None = None) -> Column:
        return F.coalesce((self.grant if grant is None else grant)["text"], F.lit(""))


def _grant(base: int, per_day: int, text: str) -> str:
    return (f"named_struct('base', {base}L, 'per_day', {per_day}L, "
            f"'text', {X.sql_text(text)})")


def _by_rate(rates: dict, reason: str, show_base: bool = False) -> Column:
    """The grant of the rate that fits urgency and ticket type.

    A map lookup compiles to a loop; the same as a CASE, three times over,
    would make the generated method too long for the JVM to compile.
    """
    entries = []
    for (urgency, kind), (base, per_day) in rates.items():
        lead = f"{base} base + " if show_base and urgency != K.URGENCY_NORMAL else "+"
        name = f"{K.TICKET_TYPE_NAMES[kind]}-{K.URGENCY_NAMES[urgency]}"
        text = f"{lead}{per_day} pt/jour pour {name} {reason}"
        entries.append(f"{urgency * 10 + kind}L, {_grant(base, per_day, text)}")
    return F.expr(f"try_element_at(map({', '.join(entries)}), "
                  "AP_SD_URGENCY_ID * 10 + C_TICKET_TYPE)")


def since_creation() -> Component:
    grant = _by_rate(K.RATE_SINCE_CREATION, K.REASON_SINCE_CREATION, show_base=True)
    return Component("since_creation", grant, "C_TICKET_AGE")


def since_last_action() -> Component:
    grant = _by_rate(K.RATE_SINCE_LAST_ACTION, K.REASON_SINCE_LAST_ACTION)
    return Component("since_last_action", grant, "C_LAST_ACTION_DATE")


def not_suspended() -> Component:
    running = ~X.member(F.col("AP_SD_STATUS_ID"), K.STATUS_SUSPENDED_FOR_SCORE)
    grant = F.when(running, _by_rate(K.RATE_NOT_SUSPENDED, K.REASON_NOT_SUSPENDED))
    return Component("not_suspended", grant, "C_LAST_ACTION_DATE")


def security() -> Component:
    grant = F.expr(_grant(K.SECURITY_POINTS, 0, K.SECURITY_TEXT))
    return Component("security", F.when(selectors.is_security(), grant))


def vip(vip_names: Sequence[str]) -> Component:
    grant = F.expr(_grant(K.VIP_BASE, K.VIP_PER_DAY, K.VIP_TEXT))
    return Component("vip", F.when(selectors.is_about(vip_names), grant), "C_LAST_ACTION_DATE")


def industrial() -> Component:
    grant = F.expr(_grant(K.INDUSTRIAL_POINTS, 0, K.INDUSTRIAL_TEXT))
    return Component("industrial", F.when(selectors.is_industrial(), grant))


def components(vip_names: Sequence[str] = ()) -> list[Component]:
    return [since_creation(), since_last_action(), not_suspended(),
            security(), vip(vip_names), industrial()]


def with_score(tickets: DataFrame, vip_names: Sequence[str] = ()) -> DataFrame:
    """Total points and the six justification texts, each after a separator.

    The grants are columns of their own first, so that points and texts share
    one evaluation of the patterns; no join and no shuffle is involved.
    """
    require_columns(tickets, NEEDED_COLUMNS)
    parts = components(vip_names)
    granted = {part: f"_{part.name}" for part in parts}
    pieces = [
        piece for part, name in granted.items()
        for piece in (F.lit(K.JUSTIFICATION_SEPARATOR), part.text(F.col(name)))
    ]
    points = [part.points(F.col(name)) for part, name in granted.items()]
    return (
        tickets
        .withColumns({name: part.grant for part, name in granted.items()})
        .withColumns({
            "C_POINTS": reduce(lambda a, b: a + b, points),
            "C_POINTS_JUSTIFICATION": F.concat(*pieces),
        })
        .drop(*granted.values())
    )
