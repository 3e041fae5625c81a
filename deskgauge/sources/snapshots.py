"""Versioned parquet frames that are written together and read together.

A version is a new directory; nothing that may be read is ever overwritten.  It
becomes visible by one small file that names it, which is moved into the manifest
when all its frames are committed.  The move is atomic and fails if the name is
taken.  The file of a version that succeeds another is named after that one, so the
same move claims the base and lists the change: of two changes at once one is refused,
and a driver lost before the move leaves the base as it was.  The shared folder must
be on a file system that renames atomically (HDFS and the like).

Frames can be bucketed by a key.  Spark knows buckets from its catalog only, so such
a frame is read through a table over its files, made in the session on first use.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from deskgauge import schemas
from deskgauge.functions import time as XT
from deskgauge.operators import classification as C, quality
from deskgauge.sources import extracts, idsets
from deskgauge.sources.extracts import ServiceDesk

_LINE = "base string, kind string, version string, created_at timestamp_ntz"

EXTRACT = "extract"
CLASSIFICATION = "classification"
BUCKETS = 64


class StaleVersion(RuntimeError):
    """A change was based on a version that is not the newest of its kind."""


def new_version() -> str:
    return str(uuid.uuid4())


def _utc_text(moment: dt.datetime | None) -> str:
    moment = moment or dt.datetime.now(dt.timezone.utc)
    if moment.tzinfo is not None:
        moment = moment.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return moment.isoformat()


@dataclass(frozen=True)
class VersionStore:
    """Versions under ``root``, a folder every executor can reach.

    Each version is of a kind - the extracts, the classification - and the
    newest one is looked up per kind, so the kinds share a store.
    """

    spark: SparkSession
    root: str

    def _path(self, version: str, name: str) -> str:
        return f"{self.root}/versions/{version}/{name}"

    def _table(self, version: str, name: str) -> str:
        return f"desk_{version.replace('-', '')}_{name}"

    def put(self, version: str, name: str, frame: DataFrame,
            measures: list[Column] | None = None, codec: str = "snappy") -> DataFrame:
        """Store a frame of a version that is not listed yet; read it back.

        ``measures``, named aggregates of the frame, are taken while it is written and
        kept beside it, see :meth:`measured`.
        """
        frame, note = self._watched(version, name, frame, measures)
        frame.write.parquet(self._path(version, name), compression=codec)
        note()
        return self.read(version, name)

    def put_bucketed(self, version: str, name: str, frame: DataFrame, key: str,
                     buckets: int, measures: list[Column] | None = None) -> DataFrame:
        """Like :meth:`put`, one file per bucket of ``key``.

        What is grouped or joined by the key later is not shuffled again.
        """
        frame, note = self._watched(version, name, frame.repartition(buckets, key), measures)
        frame.write.format("parquet").bucketBy(buckets, key).option(
            "path", self._path(version, name)).saveAsTable(self._table(version, name))
        note()
        self._create(f"versions/{version}/{name}.buckets.json", {"key": key, "buckets": buckets})
        return self.read(version, name)

    def _watched(self, version: str, name: str, frame: DataFrame,
                 measures: list[Column] | None):
        """The frame as it is to be written, and what notes its measures after that.

        They are taken in the stage that writes, of which each task counts once,
        however often executors are lost.
        """
        if not measures:
            return frame, lambda: None
        seen = Observation()
        return frame.observe(seen, *measures), lambda: self._create(
            f"versions/{version}/{name}.measures.json", seen.get)

    def measured(self, version: str, name: str, schema: str) -> dict | None:
        """The measures noted with a frame, none if it was stored without."""
        return self._note(f"{self._path(version, name)}.measures.json", schema)

    def _create(self, name: str, content: dict) -> bool:
        """A small file that appears whole; false if the name is taken."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        fs = jvm.org.apache.hadoop.fs
        draft, target = fs.Path(f"{self.root}/drafts/{uuid.uuid4()}"), fs.Path(f"{self.root}/{name}")
        files = target.getFileSystem(conf)
        draft, target = files.makeQualified(draft), files.makeQualified(target)
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        files.mkdirs(target.getParent())
        no_overwrite = self.spark._sc._gateway.new_array(fs.Options.Rename, 1)
        no_overwrite[0] = fs.Options.Rename.NONE
        try:
            fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, no_overwrite)
        except Py4JJavaError as error:
            files.delete(draft, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def _list(self, base: str | None, version: str, kind: str,
              created_at: dt.datetime | None) -> bool:
        name = f"after-{base}" if base else f"new-{version}"
        return self._create(f"manifest/{name}.json", {
            "base": base, "kind": kind, "version": version, "created_at": _utc_text(created_at)})

    def publish(self, version: str, kind: str, created_at: dt.datetime | None = None) -> str:
        """List a version whose frames are all stored."""
        self._list(None, version, kind, created_at)
        return version

    def write(self, frames: dict[str, DataFrame], kind: str,
              created_at: dt.datetime | None = None) -> str:
        """Store all frames as one new version and list it."""
        version = new_version()
        for name, frame in frames.items():
            self.put(version, name, frame)
        return self.publish(version, kind, created_at)

    def succeed(self, base: str, frames: dict[str, DataFrame], kind: str,
                created_at: dt.datetime | None = None) -> str:
        """Like :meth:`write`, for frames derived from ``base``.

        Only one version may succeed another: the first one listed.  Any other is
        refused, so that no change is lost; it can be made anew on the latest.
        """
        version = new_version()
        for name, frame in frames.items():
            self.put(version, name, frame)
        return self.follow(base, version, kind, created_at)

    def follow(self, base: str, version: str, kind: str,
               created_at: dt.datetime | None = None) -> str:
        """List a version whose frames are all stored as the successor of ``base``."""
        if not self._list(base, version, kind, created_at):
            raise StaleVersion(f"version {base} already has a successor")
        return version

    def latest(self, kind: str, max_age: dt.timedelta | None = None,
               as_of: dt.datetime | None = None) -> str | None:
        """Newest listed version of a kind, if younger than ``max_age``.

        A version with a successor is not the latest, whatever their clocks say.
        """
        if not self._exists(f"{self.root}/manifest"):
            return None
        lines = self.spark.read.schema(_LINE).json(f"{self.root}/manifest")
        followed = lines.select(F.col("base").alias("version")).filter("version IS NOT NULL")
        lines = lines.filter(F.col("kind") == kind).join(followed, "version", "left_anti")
        if max_age is not None:
            age = XT.seconds_between(F.col("created_at"), XT.moment(as_of))
            lines = lines.filter(age < max_age.total_seconds())
        newest = lines.orderBy(F.desc("created_at"), F.desc("version")).limit(1).collect()
        return newest[0]["version"] if newest else None

    def holds(self, version: str, name: str) -> bool:
        return self._exists(self._path(version, name))

    def read(self, version: str, name: str) -> DataFrame:
        path, table = self._path(version, name), self._table(version, name)
        if self.spark.catalog.tableExists(table):
            return self.spark.table(table)
        frame = self.spark.read.parquet(path)
        buckets = self._buckets(version, name)
        if buckets is None:
            return frame
        # The files of another session's buckets, made known to this one.
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
        where = path.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
            f"CLUSTERED BY (`{buckets['key']}`) INTO {buckets['buckets']} BUCKETS "
            f"LOCATION '{where}'")
        return self.spark.table(table)

    def _buckets(self, version: str, name: str) -> dict | None:
        return self._note(f"{self._path(version, name)}.buckets.json", "key string, buckets int")

    def _note(self, path: str, schema: str) -> dict | None:
        """The content of a small file, none if there is no such file."""
        if not self._exists(path):
            return None
        return self.spark.read.schema(schema).json(path).first().asDict()

    def _exists(self, path: str) -> bool:
        file = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return file.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(file)


def evenly_bucketed(frame: DataFrame, key: str, buckets: int, most: float = 2.0) -> bool:
    """Whether no bucket holds more than ``most`` times its share of the rows.

    One task reads a bucket, so a key with very many rows must not be bucketed.
    """
    sizes = frame.groupBy(F.pmod(F.hash(key), F.lit(buckets)).alias("bucket")).agg(
        F.count("*").alias("n"))
    total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return largest * buckets <= most * total + buckets


def take_snapshot(store: VersionStore, desk: ServiceDesk,
                  max_age: dt.timedelta | None = None,
                  as_of: dt.datetime | None = None, buckets: int = BUCKETS) -> str:
    """Version that holds both extracts; a young enough one is reused.

    The ids of the open requests and the lookup tables are stored first.  The
    ids are computed once, and whatever meets the big tables has a known size:
    Spark broadcasts it if it is small, and shuffles if it is too large for that.  Then
    only rows of open requests are shuffled: the ids, as bitmaps, filter both scans, and
    the actions, named first, go to their buckets and to the ids in one shuffle.

    Tickets and actions are bucketed alike by request, so flows on the snapshot group
    and join them without a shuffle; not so (or with ``buckets`` 0) where some request
    owns so many actions that one task could not read its bucket.  What the quality
    report asks of single actions is measured while they are written.
    """
    if max_age is not None:
        young = store.latest(EXTRACT, max_age, as_of)
        if young:
            return young
    version = new_version()
    desk = replace(desk, **{
        name: store.put(version, name, getattr(desk, name)) for name in extracts.LOOKUPS
    })
    hotline = store.put(version, "hotline_ids", extracts.open_hotline_ids(desk.am_action))
    big = {name: getattr(desk, name) for name in ("sd_request", "am_action")}
    hotline_bits = None
    if all(idsets.whole_numbers(table, "REQUEST_ID") for table in big.values()):
        bits = store.put(version, "wanted_bits", idsets.bitmaps(
            extracts.open_ids(desk, hotline), "REQUEST_ID"))
        if idsets.can_be_sent(bits):
            # No more of them than of all open requests.
            hotline_bits = store.put(version, "hotline_bits", idsets.bitmaps(hotline, "REQUEST_ID"))
            desk = replace(desk, **{
                name: idsets.possible(table, "REQUEST_ID", bits) for name, table in big.items()})
    wanted = store.put(version, "wanted", extracts.wanted_requests(desk, hotline))
    tickets = extracts.extract_tickets(desk, hotline_ids=hotline, hotline_bits=hotline_bits)
    if hotline_bits is not None:
        extracted = desk.am_action.filter(F.col("REQUEST_ID").isNotNull())
    else:
        extracted = desk.am_action.join(wanted.select("REQUEST_ID"), "REQUEST_ID", "left_semi")
    even = buckets and evenly_bucketed(extracted, "REQUEST_ID", buckets)
    actions = extracts.extract_actions(
        desk, wanted=wanted, buckets=buckets if even and hotline_bits is not None else 0)
    measures = quality.extract_measures()
    if even:
        store.put_bucketed(version, "tickets", tickets, "REQUEST_ID", buckets)
        store.put_bucketed(version, "actions", actions, "REQUEST_ID", buckets, measures)
    else:
        store.put(version, "tickets", tickets)
        store.put(version, "actions", actions, measures)
    return store.publish(version, EXTRACT, as_of)


def action_measures(store: VersionStore, version: str) -> dict | None:
    """What :func:`take_snapshot` measured on the actions, for ``quality.report``."""
    return store.measured(version, "actions", quality.MEASURES)


def complete_classification(store: VersionStore, version: str, tickets: DataFrame) -> str:
    """New version with one row per stored request and per ticket."""
    whole = C.complete(tickets, store.read(version, "classification"))
    return store.succeed(version, {"classification": whole}, CLASSIFICATION)


def change_stored_types(store: VersionStore, version: str, types: DataFrame,
                        updates: DataFrame, tickets: DataFrame) -> tuple[str, DataFrame]:
    """Write the changed classification as a new version; also the rejects.

    Tickets without a stored row get theirs first, so that their changes hold.
    A version that has been changed meanwhile is refused with ``StaleVersion``.
    """
    change = C.change_types(store.read(version, "classification"), types, updates, tickets)
    rows = change.classification.select(*schemas.CLASSIFICATION.names)
    return store.succeed(version, {"classification": rows}, CLASSIFICATION), change.rejects
