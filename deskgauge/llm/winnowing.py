"""Document fingerprints by winnowing.

Every run of GRAM code points (a shorter text: the whole of it) has a rolling hash: a
polynomial modulo 2**64 whose upper 44 bits are the hash.  Of every WINDOW grams in a
row the one with the least hash is kept, of equal ones the rightmost.  A kept gram is a
mark: hash and position.  Two texts that share GRAM + WINDOW - 1 code points in a row
share a mark there, and positions tell where; no shorter match than GRAM is ever seen.

``with_next`` pairs documents with what follows them in sorted ranges; texts are
shuffled once.

Cases: a null text counts as empty; an empty text has no marks and the empty
fingerprint, like only to another empty one; a text of repeats keeps one mark per
window.  Rows of one doc_id follow each other by the hash of their texts, null ids come
first, repeated rows are each other's next, and a table of one row is followed by
itself.  Rows of a hot id are spread by their texts; only rows equal in both stay in
one range, which is sorted with spill and streamed, never held.  An empty table gives
no rows; other columns are not read.  Whole texts, however long, in pieces of PIECE
code points.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from deskgauge.llm import common

GRAM = 16
WINDOW = 32  # 255 at most: a packed mark has one byte for the gap before it
PIECE = 1 << 19

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(BASE, -1, 1 << 64)
HASH_BITS = 44
PLACE_BITS = 64 - HASH_BITS
_PLACES = np.uint64((1 << PLACE_BITS) - 1)
_MARK = np.dtype([("hash", "<u8"), ("position", "<u4")])


class _Powers:
    """Powers of a number modulo 2**64, extended as texts need them."""

    def __init__(self, base: int):
        self.base = np.uint64(base)
        self.values = np.ones(1, np.uint64)

    def first(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            factors = np.full(max(n, 2 * len(self.values)), self.base)
            factors[0] = 1
            self.values = np.multiply.accumulate(factors)
        return self.values[:n]


_UP, _DOWN = _Powers(BASE), _Powers(_INVERSE)


def rolling(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every run of ``gram`` codes: sum of code * BASE**(gram - 1 - its place).

    The sum rolls: its running total is scaled back, so a step adds one code and the
    difference of two totals drops those before the run.
    """
    n = len(codes)
    totals = np.zeros(n + 1, np.uint64)
    np.cumsum(codes.astype(np.uint64) * _DOWN.first(n), out=totals[1:])
    runs = totals[gram:] - totals[:n - gram + 1]
    return (runs * _UP.first(n)[gram - 1:]) >> np.uint64(PLACE_BITS)


def sliding_min(keys: np.ndarray, window: int) -> np.ndarray:
    """Least key of every ``window`` keys in a row, by minima from both block ends."""
    n = len(keys)
    blocks = -(-n // window)
    padded = np.full(blocks * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    square = padded.reshape(blocks, window)
    head = np.minimum.accumulate(square, axis=1).ravel()
    tail = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - window + 1
    return np.minimum(tail[:last], head[window - 1:window - 1 + last])


def marks(codes: np.ndarray, gram: int = GRAM, window: int = WINDOW,
          piece: int = PIECE) -> np.ndarray:
    """(hash, position) of the kept grams in text order."""
    n = len(codes)
    if not n:
        return np.zeros(0, _MARK)
    gram = min(gram, n)
    window = min(window, n - gram + 1)
    found = []
    # Windows that start in one piece; places count from the piece, so no key repeats.
    for start in range(0, n - gram - window + 2, piece):
        part = codes[start:start + piece + window + gram - 2]
        hashes = rolling(part, gram)
        places = _PLACES - np.arange(len(hashes), dtype=np.uint64)
        least = sliding_min(hashes << np.uint64(PLACE_BITS) | places, window)
        kept = least[np.flatnonzero(np.diff(least, prepend=~least[:1]))]
        out = np.zeros(len(kept), _MARK)
        out["hash"] = kept >> np.uint64(PLACE_BITS)
        out["position"] = start + (_PLACES - (kept & _PLACES))
        found.append(out)
    whole = np.concatenate(found)
    return whole[np.concatenate([[True], np.diff(whole["position"].astype(np.int64)) != 0])]


def codes_of(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")


def text_of(codes: np.ndarray) -> bytes:
    return codes.tobytes().decode("utf-32-le").encode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes of two mark lists over all their hashes; two empty ones are alike."""
    a, b = np.unique(a["hash"]), np.unique(b["hash"])
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def packed(found: np.ndarray) -> str:
    """Marks as text: base 64 of seven bytes each, six of hash and one of the distance
    from the mark before, which no window lets exceed WINDOW."""
    gaps = np.diff(found["position"].astype(np.int64), prepend=0).astype(np.uint64)
    words = (found["hash"] << np.uint64(8) | gaps).astype(">u8")
    return base64.b64encode(words.view(np.uint8).reshape(-1, 8)[:, 1:].tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    rows = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 7)
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (1, 0)))).view(">u8").ravel()
    out = np.zeros(len(rows), _MARK)
    out["hash"] = words >> np.uint64(8)
    out["position"] = np.cumsum((words & np.uint64(255)).astype(np.int64))
    return out


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, hash, position: the marks of every document, one a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0), common.utf8(batch.column(1))):
                found = marks(codes_of(text), gram, window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id.as_py()] * len(found), pa.int64()),
                     pa.array(found["hash"].astype(np.int64)),
                     pa.array(found["position"].astype(np.int64))],
                    ["doc_id", "hash", "position"])

    return common.documents(docs).mapInArrow(run, "doc_id bigint, hash bigint, position bigint")


def edited(codes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last quarter (rounded down) replaced by the start of the following text."""
    quarter = len(codes) // 4
    return np.concatenate([codes[:len(codes) - quarter], following[:quarter]])


_RESULT = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(),
    "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(), "near_next": pa.float64(),
}
_COLUMNS = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
            "edited_fingerprint string, near_edited double, near_next double")


def _compared(doc_id, codes, found, next_codes, next_found) -> tuple:
    changed = edited(codes, next_codes)
    other = marks(changed)
    return (doc_id, len(codes), hashlib.sha256(text_of(changed)).hexdigest(),
            packed(found), packed(other), likeness(found, other), likeness(found, next_found))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_RESULT)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, _RESULT.values())], list(_RESULT))


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row against the one after it; a guard only stands after its range."""
    before = None
    for batch in batches:
        out = []
        guards = batch.column(2).to_pylist()
        for doc_id, text, guard in zip(batch.column(0), common.utf8(batch.column(1)), guards):
            if guard and before is None:
                continue
            codes = codes_of(text)
            found = marks(codes)
            if before is not None:
                out.append(_compared(*before, codes, found))
            before = None if guard else (doc_id.as_py(), codes, found)
        yield _batch(out)


def _key() -> Column:
    """Order of documents: null ids, ids, and the hash of the text where ids are equal."""
    return F.struct(
        F.col("doc_id").isNotNull().cast("int").alias("known"),
        F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("tie"))


def _least_keys(rows: DataFrame, ranges: int) -> list[tuple]:
    """The least key of each of ``ranges`` ranges of about equal numbers of rows."""
    found = (
        rows.select("key").repartitionByRange(ranges, "key")
        .groupBy(F.spark_partition_id().alias("range")).agg(F.min("key").alias("least"))
    )
    return sorted(tuple(r["least"]) for r in found.collect())


def _starts(least: list[tuple]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("known"), F.lit(i).cast("bigint").alias("id"),
                              F.lit(t).cast("bigint").alias("tie")) for k, i, t in least])


def _range_of(key: Column, starts: Column, ranges: int) -> Column:
    """The range a key lies in, by binary search over the least keys of ranges."""
    steps = [1 << b for b in reversed(range(ranges.bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(-1),
        lambda at, step: F.when(F.get(starts, at + step) <= key, at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint against its edited text's and the next document's.

    The rows are dealt out by ranges of their order, which a pass over the ids and text
    hashes finds.  The first row of a range also goes to the range before it (of the
    very first to the very last) as its guard, so each range knows what follows it.
    """
    spark = docs.sparkSession
    rows = common.documents(docs).withColumn("key", _key())
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = _least_keys(rows, ranges)
    if not least:
        return spark.createDataFrame([], _COLUMNS)
    starts = _starts(least)
    own = F.struct(F.col("range"), F.lit(False).alias("guard"))
    before = F.struct(F.pmod(F.col("range") - 1, F.lit(len(least))).alias("range"),
                      F.lit(True).alias("guard"))
    is_least = F.get(starts, F.col("range")) == F.col("key")
    placed = rows.withColumn("range", _range_of(F.col("key"), starts, len(least))).withColumn(
        "place", F.explode(F.when(is_least, F.array(own, before)).otherwise(F.array(own))))
    return (
        placed.select("doc_id", "text", "place.guard", "place.range", "key")
        .repartitionByRange(ranges, "range")
        .sortWithinPartitions("range", "guard", "key")
        .select("doc_id", "text", "guard")
        .mapInArrow(_compare_neighbours, _COLUMNS)
    )
