"""A copy of the two big source tables, kept up to date by the rows that changed.

A full extract reads all requests and actions of the source.  Here they are copied
once; then a refresh asks the source for the rows with a late ``LAST_UPDATE`` only (the
filter reaches parquet and databases) and stores them beside the copy, the newest
row per key.  Readers see the copy without the keys that changed (an anti join, a
broadcast while the changes are few) and the changes.  When these have grown to a
share of the copy, both are written as a new one.

The mirror is a kind of version in the store, each the successor of the one before: of
two refreshes at once one is refused, and a driver lost during one changes nothing.

Rows without ``LAST_UPDATE`` are read every time, rows without a key stay as first
copied, and rows deleted at the source stay until :func:`take_mirror` copies anew.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from deskgauge.sources import idsets, snapshots
from deskgauge.sources.extracts import ServiceDesk
from deskgauge.sources.snapshots import VersionStore

MIRROR = "mirror"
KEYS = {"sd_request": "REQUEST_ID", "am_action": "ACTION_ID"}
CHANGED_AT = "LAST_UPDATE"
OVERLAP = dt.timedelta(hours=1)
# Written once, read a few times, never a side that Spark might broadcast.
CODEC = "zstd"

_ABOUT = "base string, name string, mark timestamp_ntz"


def changed_since(table: DataFrame, mark: dt.datetime | None) -> DataFrame:
    """Rows changed at ``mark`` or later, and those that do not tell."""
    if mark is None:
        return table
    at = F.col(CHANGED_AT)
    return table.filter(at.isNull() | (at >= F.lit(mark.isoformat(sep=" ")).cast("timestamp_ntz")))


def newest(reads: list[DataFrame], key: str) -> DataFrame:
    """One row per key: of the last read that has it, the one changed last.

    Equal times are settled by the values, so a task that runs again agrees.
    """
    columns = reads[0].columns
    # The key and the time are not carried twice.
    rest = [c for c in columns if c not in (key, CHANGED_AT)] or [key]
    shown = {key: F.col("key"), CHANGED_AT: F.col("last.at")}

    def ranked(number: int, frame: DataFrame) -> DataFrame:
        rank = [F.lit(number).alias("read"), F.col(CHANGED_AT).alias("at")]
        return frame.filter(F.col(key).isNotNull()).select(
            F.col(key).alias("key"),
            F.struct(*rank, F.struct(*rest).alias("row")).alias("ranked"))

    rows = ranked(0, reads[0])
    for number, frame in enumerate(reads[1:], 1):
        rows = rows.unionByName(ranked(number, frame))
    return rows.groupBy("key").agg(F.max("ranked").alias("last")).select(
        *[shown.get(c, F.col(f"last.row.`{c}`")).alias(c) for c in columns])


def _latest_mark(frame: DataFrame) -> dt.datetime | None:
    return frame.agg(F.max(CHANGED_AT)).first()[0]


def _about(store: VersionStore, version: str) -> dict[str, tuple[str, dt.datetime | None]]:
    """Per table: the version of its copy and the latest time of change seen."""
    return {r["name"]: (r["base"], r["mark"]) for r in store.read(version, "about").collect()}


def _describe(store: VersionStore, version: str, about: list[tuple]) -> None:
    store.put(version, "about", store.spark.createDataFrame(about, _ABOUT).coalesce(1))


def take_mirror(store: VersionStore, desk: ServiceDesk,
                created_at: dt.datetime | None = None) -> str:
    """Copy both tables whole, as a new version after the latest one."""
    return _copied(store, {name: getattr(desk, name) for name in KEYS},
                   store.latest(MIRROR), created_at)


def _copied(store: VersionStore, tables: dict[str, DataFrame], before: str | None,
            created_at: dt.datetime | None) -> str:
    version = snapshots.new_version()
    about = [(version, name, _latest_mark(store.put(version, name, table, codec=CODEC)))
             for name, table in tables.items()]
    _describe(store, version, about)
    if before is None:
        return store.publish(version, MIRROR, created_at)
    return store.follow(before, version, MIRROR, created_at)


def refresh_mirror(store: VersionStore, desk: ServiceDesk, most_changed: float = 0.1,
                   overlap: dt.timedelta = OVERLAP,
                   created_at: dt.datetime | None = None) -> str:
    """New version with what changed at the source since the latest, or a first copy.

    ``overlap`` is how late a change may become visible after its own time; rows
    read again on that account replace themselves.  Changes of more than
    ``most_changed`` of a copy's rows are merged into a new copy.
    """
    before = store.latest(MIRROR)
    if before is None:
        return take_mirror(store, desk, created_at)
    version, about, large = snapshots.new_version(), [], False
    for name, (base, mark) in _about(store, before).items():
        since = None if mark is None else mark - overlap
        reads = [changed_since(getattr(desk, name), since)]
        if base != before:
            reads.insert(0, store.read(before, f"{name}_changes").select(*reads[0].columns))
        changes = store.put(version, f"{name}_changes", newest(reads, KEYS[name]), codec=CODEC)
        if idsets.whole_numbers(changes, KEYS[name]):
            store.put(version, f"{name}_changed", idsets.bitmaps(changes, KEYS[name]))
        seen = [m for m in (mark, _latest_mark(changes)) if m is not None]
        about.append((base, name, max(seen, default=None)))
        large |= changes.count() > most_changed * store.read(base, name).count()
    _describe(store, version, about)
    if large:
        merged = {name: _merged(store, version, name, base) for base, name, _ in about}
        return _copied(store, merged, before, created_at)
    return store.follow(before, version, MIRROR, created_at)


def _merged(store: VersionStore, version: str, name: str, base: str) -> DataFrame:
    copy = store.read(base, name)
    if base == version:
        return copy
    key, changes = KEYS[name], store.read(version, f"{name}_changes")
    # None of keys that are not whole numbers, nor with versions of before there were any.
    changed = f"{name}_changed"
    bits = store.read(version, changed) if store.holds(version, changed) else None
    if bits is not None and idsets.can_be_sent(bits):
        kept = idsets.without(copy, key, bits)
    else:
        kept = copy.join(changes.select(key), key, "left_anti").select(*copy.columns)
    return kept.unionByName(changes)


def mirrored(store: VersionStore, version: str, desk: ServiceDesk) -> ServiceDesk:
    """The desk with its two big tables from the mirror; lookups stay the source's."""
    return replace(desk, **{
        name: _merged(store, version, name, base)
        for name, (base, _) in _about(store, version).items()
    })


def take_incremental_snapshot(store: VersionStore, desk: ServiceDesk,
                              as_of: dt.datetime | None = None, **options) -> str:
    """Like ``snapshots.take_snapshot``, reading from the source what changed."""
    version = refresh_mirror(store, desk, created_at=as_of)
    return snapshots.take_snapshot(store, mirrored(store, version, desk), as_of=as_of, **options)
