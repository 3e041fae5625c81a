"""Fill-in-the-middle examples, cut at line ends found in a compressed boundary set.

A text is cut into units (lines with their line feed); the places between units,
with the start and the end of the text, are its boundaries, kept as byte offsets in
a :class:`BoundarySet`.  A set holds containers of 65,536 offsets: sorted arrays where
offsets are few, bitmaps where they are many, runs where they follow each other
without a gap.  Container totals are kept cumulatively, so the k-th boundary is a
binary search over containers and one select inside a container.  A document's two
cuts are two such selects; nothing else of the set is unfolded.

The draws behind a cut come from a hash of the seed and the doc_id, so a document is
cut alike in every run and on every executor.

Cases: a null text counts as empty; an empty text, and a text with one of the marks,
stays plain; a null doc_id is hashed as empty text; a text of one line may get cuts at
its ends, so that parts are empty; repeated rows give repeated results, rows of one id
but other texts are cut by the same draws; no limit on the length of a text or line;
an empty table gives no rows; other columns are not read.  Bytes that are not UTF-8
stay as they are, each run of a lead byte and its followers counting as one character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from deskgauge.llm import common

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

_BITS = 16
_SPAN = 1 << _BITS
_BITMAP_BYTES = _SPAN // 8


class _Array:
    """Sorted 16-bit values: the k-th is where it stands."""

    def __init__(self, values: np.ndarray):
        self.values = values

    @staticmethod
    def size(values: np.ndarray) -> int:
        return 2 * len(values)

    def select(self, k: int) -> int:
        return int(self.values[k])


class _Bitmap:
    """One bit per value; a count before every 64-bit word leads select to its word."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(_SPAN, bool)
        bits[values] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

    @staticmethod
    def size(values: np.ndarray) -> int:
        return _BITMAP_BYTES

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1
        return at * 64 + (word & -word).bit_length() - 1


class _Runs:
    """First values of unbroken runs and the counts before them."""

    def __init__(self, values: np.ndarray):
        first = self._firsts(values)
        self.before = first
        self.starts = values[first]

    @staticmethod
    def _firsts(values: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.flatnonzero(np.diff(values) != 1) + 1])

    @staticmethod
    def size(values: np.ndarray) -> int:
        return 2 + 4 * (int(np.count_nonzero(np.diff(values) != 1)) + 1)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[at]) + k - int(self.before[at])


class BoundarySet:
    """An ordered set of offsets with ``select``; containers by their smallest form."""

    def __init__(self, offsets: np.ndarray):
        offsets = np.asarray(offsets, np.int64)
        high = offsets >> _BITS
        firsts = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys = high[firsts]
        self.cumulative = np.append(firsts, len(offsets))
        self.containers = []
        for a, b in zip(self.cumulative[:-1], self.cumulative[1:]):
            low = offsets[a:b] & (_SPAN - 1)
            form = min((_Array, _Runs, _Bitmap), key=lambda kind: kind.size(low))
            self.containers.append(form(low))

    def __len__(self) -> int:
        return int(self.cumulative[-1])

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.cumulative, k, "right")) - 1
        inside = self.containers[at].select(k - int(self.cumulative[at]))
        return (int(self.keys[at]) << _BITS) + inside


def line_boundaries(text: bytes) -> BoundarySet:
    """Start, every place after a line feed, and the end."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    if text and not text.endswith(b"\n"):
        ends = np.append(ends, len(text))
    return BoundarySet(np.concatenate([[0], ends]))


@dataclass(frozen=True)
class Rates:
    """How often, in percent, texts are cut at all, and cut ones put their suffix first."""

    cut: int = 100
    suffix_first: int = 50
    seed: int = 7


@dataclass(frozen=True)
class Example:
    form: str
    units: int
    prefix: bytes
    middle: bytes
    suffix: bytes
    output: bytes


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]


def transform(doc_id: int | None, text: bytes, rates: Rates = Rates()) -> Example:
    places = line_boundaries(text)
    units = len(places) - 1
    one, two, cut, order = draws(doc_id, rates.seed)
    marked = any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE))
    if not text or marked or cut % 100 >= rates.cut:
        return Example(PLAIN, units, text, b"", b"", text)
    low, high = sorted((one % (units + 1), two % (units + 1)))
    low, high = places.select(low), places.select(high)
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if order % 100 < rates.suffix_first:
        output = SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
        return Example(SPM, units, prefix, middle, suffix, output)
    output = PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return Example(PSM, units, prefix, middle, suffix, output)


def restore(output: bytes, form: str) -> bytes:
    """The text an output was made of, read from the output and its form alone."""
    if form == PLAIN:
        return output
    first, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    head, middle = output.removeprefix(first).split(MIDDLE)
    left, right = head.split(second)
    return left + middle + right if form == PSM else right + middle + left


def characters(text: bytes) -> int:
    """Code points: all bytes but those that continue one."""
    raw = np.frombuffer(text, np.uint8)
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def _mapped(docs: DataFrame, schema: str, row) -> DataFrame:
    """``row(doc_id, text)`` of every document, as rows of ``schema``."""
    parsed = [field.split() for field in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [row(i, t) for i, t in zip(ids, common.utf8(batch.column(1)))]
            columns = [pa.array([f[k] for f in found], kinds[kind])
                       for k, (_, kind) in enumerate(parsed)]
            yield pa.RecordBatch.from_arrays(columns, [name for name, _ in parsed])

    return common.documents(docs).mapInArrow(run, schema)


def examples(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """The training text of every document: doc_id, form, output."""
    def row(doc_id, text):
        made = transform(doc_id, text, rates)
        return doc_id, made.form, made.output

    return _mapped(docs, "doc_id bigint, form string, output string", row)


def digests(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """Per document its cut, the digest of its output, and of the text restored from it."""
    def row(doc_id, text):
        made = transform(doc_id, text, rates)
        cut = made.form != PLAIN
        back = restore(made.output, made.form)
        return (doc_id, made.units, made.form,
                characters(made.prefix) if cut else None,
                characters(made.middle) if cut else None,
                hashlib.sha256(made.output).hexdigest(), hashlib.sha256(back).hexdigest())

    return _mapped(docs, "doc_id bigint, n bigint, form string, prefix_chars bigint, "
                         "middle_chars bigint, output_sha256 string, restored_sha256 string", row)
