"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

ASCII capitals are lowered; words are runs of ASCII digits, ASCII lower-case
letters and any character beyond ASCII.  A window is 13 words of an item in a
row; a shorter item, if it has a word, is one window.  A document word inside an
occurrence of a window is hit; a document is contaminated if a word is hit and
the hits are a twentieth of its words or more.

The set holds the windows themselves, so a hit of the hash table is verified by
comparing the words.  It is broadcast in blocks of a bounded number of windows,
split by their hash: one block for any usual benchmark, and beyond that one pass
per block, with the words hit so far carried along in a written table.  The
result does not depend on the number of blocks.

Cases: a null or empty text has no words and is clean; an item without words
matches nothing; repeated items count once per item id, a null id as the empty
id; repeated documents repeat their result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deskgauge.llm import common

WINDOW = 13
BLOCK_WINDOWS = 300_000

_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_STATE = "doc_id bigint, text string, spans binary, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct (window, item) pairs; ``n`` is the words of the window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for item, text in zip(batch.column(0).to_pylist(), common.utf8(batch.column(1))):
                words = words_of(text)
                n = min(size, len(words))
                if n:
                    found += [(item, n, b" ".join(words[i:i + n]))
                              for i in range(len(words) - n + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], kind) for k, kind in
                 enumerate((pa.string(), pa.int32(), pa.binary()))], ["item", "n", "gram"])

    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.col("text").cast("string").alias("text"))
    return items.mapInArrow(run, "item string, n int, gram binary").distinct()


def _table(rows: pa.Table) -> dict[int, dict[bytes, list[str]]]:
    """Window lengths to their windows to the items that have them."""
    out: dict[int, dict[bytes, list[str]]] = {}
    columns = (rows.column(c).to_pylist() for c in ("item", "n", "gram"))
    for item, n, gram in zip(*columns):
        out.setdefault(n, {}).setdefault(gram, []).append(item)
    return out


def hits(words: list[bytes], grams: dict[int, dict[bytes, list[str]]]):
    """Which words are hit (one byte each) and the items whose windows occur."""
    n = len(words)
    covered, items = None, set()
    if n:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
        ends = ends.tolist()
        for size, table in grams.items():
            if size > n:
                continue
            found = [i for i, (a, b) in enumerate(zip(starts, ends[size - 1:]))
                     if joined[a:b] in table]
            for i in found:
                if covered is None:
                    covered = bytearray(n)
                covered[i:i + size] = b"\1" * size
                items.update(table[joined[starts[i]:ends[i + size - 1]]])
    return covered, items


class _Blocks:
    """The window table in blocks of about ``limit`` windows, broadcast one by one."""

    def __init__(self, benchmark: DataFrame, limit: int):
        self.spark = benchmark.sparkSession
        self.rows = common.stored(windows(benchmark), common.scratch(self.spark), "windows")
        self.count = max(1, -(-self.rows.count() // limit))

    def broadcast(self, number: int):
        block = F.pmod(F.xxhash64("gram", "item"), F.lit(self.count))
        part = self.rows if self.count == 1 else self.rows.filter(block == number)
        return self.spark.sparkContext.broadcast(_table(part.toArrow()))


def _scan(state: DataFrame, grams, schema: str, finish) -> DataFrame:
    """One pass over (doc_id, text, spans, items); ``finish`` makes the columns."""
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = grams.value
        for batch in batches:
            out = []
            before = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for text, (spans, known) in zip(common.utf8(batch.column(1)), before):
                words = words_of(text)
                covered, items = hits(words, table)
                if spans is not None:
                    old = np.frombuffer(spans, np.uint8)
                    new = old if covered is None else old | np.frombuffer(covered, np.uint8)
                    covered = bytearray(new.tobytes())
                items.update(known or ())
                out.append((text, words, covered, items))
            yield pa.RecordBatch.from_arrays([batch.column(0), *finish(out)], names)

    return state.mapInArrow(run, schema)


def _carried(out):
    return [pa.array([o[0] for o in out], pa.binary()).cast(pa.string()),
            pa.array([None if o[2] is None else bytes(o[2]) for o in out], pa.binary()),
            pa.array([sorted(o[3]) for o in out], pa.list_(pa.string()))]


def _through_blocks(docs: DataFrame, blocks: _Blocks, schema: str, finish) -> DataFrame:
    state = common.documents(docs).select(
        "doc_id", "text", F.lit(None).cast("binary").alias("spans"),
        F.lit(None).cast("array<string>").alias("items"))
    folder = common.scratch(docs.sparkSession)
    for number in range(blocks.count - 1):
        grams = blocks.broadcast(number)
        state = common.stored(_scan(state, grams, _STATE, _carried), folder, f"block{number}")
        grams.unpersist()  # its pass is written
    return _scan(state, blocks.broadcast(blocks.count - 1), schema, finish)


RESULT = ("doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, "
          "items_sha256 string, contaminated boolean")


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def report(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_WINDOWS) -> DataFrame:
    """Words, hit words and matched items of every document."""
    return _report(docs, _Blocks(benchmark, limit))


def _report(docs: DataFrame, blocks: _Blocks) -> DataFrame:
    def finish(out):
        words = [len(o[1]) for o in out]
        hit = [0 if o[2] is None else sum(o[2]) for o in out]
        digest = [hashlib.sha256(",".join(sorted(o[3])).encode()).hexdigest() for o in out]
        return [pa.array(words, pa.int64()), pa.array(hit, pa.int64()),
                pa.array([len(o[3]) for o in out], pa.int64()), pa.array(digest, pa.string()),
                pa.array([is_contaminated(h, n) for h, n in zip(hit, words)], pa.bool_())]

    return _through_blocks(docs, blocks, RESULT, finish)


def cut(text: bytes, covered: bytearray | None) -> bytes:
    """The text without its hit words; each run of them leaves one space."""
    if covered is None:
        return text
    mapped = text.translate(_LOWER)
    out, at, end, place = [], 0, 0, 0
    for word, hit in zip(mapped.split(), covered):
        start = mapped.index(word, place)
        place = start + len(word)
        if hit:
            if at is not None:
                out.append(text[at:start])
            at = None
            end = place
        elif at is None:
            at = end
    if at is not None:
        out.append(text[at:])
    else:
        out.append(text[end:])
    return b"".join(out)


def without_spans(docs: DataFrame, benchmark: DataFrame,
                  limit: int = BLOCK_WINDOWS) -> DataFrame:
    """``doc_id`` and the text of every document with all hit words removed."""
    def finish(out):
        return [pa.array([cut(o[0], o[2]) for o in out], pa.binary()).cast(pa.string())]

    return _through_blocks(
        docs, _Blocks(benchmark, limit), "doc_id bigint, text string", finish)


def without_documents(docs: DataFrame, benchmark: DataFrame,
                      limit: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    A benchmark of one block is one narrow pass.  Beyond that the rows are
    numbered in a written table and the contaminated numbers are joined away.
    """
    blocks = _Blocks(benchmark, limit)
    if blocks.count == 1:
        grams = blocks.broadcast(0)

        def keep(ids, texts):
            table = grams.value
            for text in common.utf8(texts):
                words = words_of(text)
                covered, _ = hits(words, table)
                yield covered is None or not is_contaminated(sum(covered), len(words))

        return common.filtered(docs, lambda ids, texts: list(keep(ids, texts)))
    folder = common.scratch(docs.sparkSession)
    row = "row_" + folder[-12:].replace("-", "")
    numbered = common.stored(docs.withColumn(row, F.monotonically_increasing_id()), folder, "docs")
    keyed = numbered.select(F.col(row).alias("doc_id"), "text")
    bad = _report(keyed, blocks).filter("contaminated").select(
        F.col("doc_id").alias(row))
    return numbered.join(bad, row, "left_anti").drop(row)
