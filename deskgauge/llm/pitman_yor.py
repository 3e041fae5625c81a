"""A hierarchical Pitman-Yor language model, seated by Gibbs sampling on Spark.

Tokens are the words of a text (ASCII capitals lowered; runs of anything but
ASCII white space) and one end.  The history of a token is the whole word before it (a
start at the head of a text).  A context is a suffix of that history and has a restaurant
of its own: the word, then its last two bytes, then nothing; a restaurant's tables are
customers of the one for the shorter suffix, so contexts share parents, and the last
parent is uniform over the known tokens and one unknown.  There are as many restaurants
as different words, so they grow with the corpus.

How it runs.  Texts are read in batches of about ``BATCH_TOKENS`` tokens.  A
batch becomes one row with the token numbers of its documents and, per range of
the tokens' 64-bit hashes, one row with its distinct (token, context) pairs and
their training counts: all a corpus sends is pairs counted before the shuffle.
Each range merges them into its part of the counts, stored bucketed by range.  A dish
(token) lies in one range with all its contexts, so its seating needs only the totals of
the restaurants from elsewhere.  Those of the 65,537 short contexts are one small table.
Those of the words are summed by ranges of the contexts: after every sweep a range says
what it has in each of its contexts and is told their totals, which are stored and meet
the counts in a join by range.  Sweeps are seeded and replayed from the counts, so a
lost task repeats the same seating.  Last, ranges answer the batches with the predictive
probabilities of their pairs, averaged over the seatings after the first, and batches
sum them by document.

One Gibbs step takes all customers of a dish in a restaurant out and seats them
one by one, given all other dishes; a customer opens a new table with weight
(strength + discount * tables) * P(parent), and joins one with the rest.  From
the ninth customer on, an eighth of those seated so far draws at once from one
probability.  Discounts follow from the numbers of pairs seen once and twice.

Cases: null and empty texts are one end token; a null doc_id counts as empty
text in the split; without training texts every probability is 1 (V = 0) and all
scores are 0; an empty table gives no rows; repeated rows repeat their result.
"""

from __future__ import annotations

import contextlib
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from deskgauge.llm import common

FOLDS, HELD_OUT = 7, 2
BATCH_TOKENS = 2_000_000
RANGE_BYTES = 16_000_000
LEAST_RANGES, MOST_RANGES = 4, 4096
SWEEPS, BURN_IN = 3, 1
STRENGTH = 1.0

_END = b" "              # no word has a space
_START = 0x2020           # nor is any two spaces
_TAILS = 1 << 16
_HASH_BITS = 40           # of the word before, beside its last two bytes
_MERGE_AT = 1_000_000
RESULT = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
          "train_tokens bigint, base_score double, score double")


# ------------------------------------------------------- arrays as compact bytes

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes."""
    parts = []
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for array in arrays:
        size = array.dtype.itemsize
        planes = np.ascontiguousarray(array).view(np.uint8).reshape(-1, size).T.tobytes()
        body = squeeze(planes)
        parts.append(np.array([len(array), len(body)], "<u8").tobytes()
                     + array.dtype.str.encode().ljust(4) + body)
    return b"".join(parts)


def unpack(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    grow = zstandard.ZstdDecompressor().decompress
    while at < len(raw):
        length, size = np.frombuffer(raw, "<u8", 2, at).tolist()
        kind = np.dtype(raw[at + 16:at + 20].decode().strip())
        planes = grow(raw[at + 20:at + 20 + size], max_output_size=length * kind.itemsize)
        array = np.frombuffer(planes, np.uint8).reshape(kind.itemsize, length).T
        out.append(np.ascontiguousarray(array).view(kind).ravel())
        at += 20 + size
    return out


# ---------------------------------------------------------------- texts to batches

def _tail(word: bytes) -> int:
    return (word[-2] << 8 | word[-1]) if len(word) > 1 else 0x2000 | word[-1]


def _contexts(hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Contexts of words: bits of the hash, then the last two bytes, the shorter context."""
    return (hashes >> np.uint64(64 - _HASH_BITS) << np.uint64(16) | tails).astype(np.int64)


def _coded(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted contexts in few bytes."""
    return np.diff(places >> 16, prepend=0).astype(np.uint64), (places % _TAILS).astype(np.uint16)


def _places(steps: np.ndarray, tails: np.ndarray) -> np.ndarray:
    return np.cumsum(steps.astype(np.int64)) << 16 | tails


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


class _Batch:
    """Documents on their way into one batch."""

    def __init__(self):
        self.words: dict[bytes, int] = defaultdict(count().__next__)
        self.words[_END]
        self.docs: list[int | None] = []
        self.rows: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = text.lower().split()
        words.append(_END)
        self.docs.append(doc_id)
        self.rows.append(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)))
        self.tokens += len(words)

    def emit(self, labels: list[int]) -> pa.RecordBatch:
        """One row of the documents' tokens, kept in any range, and one row per range of pairs."""
        words = list(self.words)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 0) for w in words), np.uint64, len(words))
        tails = np.fromiter(map(_tail, words), np.uint16, len(words))
        order = np.argsort(hashes)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        sizes = np.fromiter(map(len, self.rows), np.int64, len(self.rows))
        flat = np.concatenate(self.rows)
        starts = np.cumsum(sizes) - sizes
        after = np.append(_contexts(hashes, tails), _START)  # contexts of tokens after a word
        places, place = np.unique(after, return_inverse=True)
        context = np.empty(len(flat), np.int64)
        context[1:] = place[flat[:-1]]
        context[starts] = place[-1]
        pairs, of = np.unique(rank[flat] * len(places) + context, return_inverse=True)
        held = np.array([common.crc_of_id(i) % FOLDS == HELD_OUT for i in self.docs])
        trained = np.bincount(of, np.repeat(~held, sizes), len(pairs)).astype(np.uint32)
        per_word = np.bincount(pairs // len(places), minlength=len(words)).astype(np.uint32)
        contexts = pairs % len(places)
        # Sorted by document and pair, tokens are small steps.
        keyed = np.sort(np.repeat(np.arange(len(sizes)), sizes) * len(pairs) + of)
        steps = np.diff(keyed, prepend=0).astype(np.uint64)
        ids = np.array([0 if i is None else i for i in self.docs], np.int64)
        null = np.array([i is None for i in self.docs], np.uint8)
        docs = pack(ids, null, held.astype(np.uint8), sizes, steps, per_word)
        name = uuid.uuid4().hex
        sorted_hashes = hashes[order]
        ranges = len(labels)
        cut = np.searchsorted(_range_of(sorted_hashes, ranges), np.arange(ranges + 1, dtype=np.uint64))
        pair_cut = np.concatenate([[0], np.cumsum(per_word, dtype=np.int64)])[cut]
        asked = []
        for a, b, c, d in zip(cut, cut[1:], pair_cut, pair_cut[1:]):
            there, at = np.unique(contexts[c:d], return_inverse=True)
            asked.append(pack(sorted_hashes[a:b], per_word[a:b], *_coded(places[there]),
                              at.astype(np.uint32), trained[c:d]))
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * (ranges + 1)),
             pa.array([labels[int(name, 16) % ranges], *labels], pa.int32()),
             pa.array([docs] + [None] * ranges, pa.binary()),
             pa.array([None, *asked], pa.binary())], ["batch", "range", "docs", "pairs"])


_BATCHES = "batch string, range int, docs binary, pairs binary"


def even_labels(spark: SparkSession, ranges: int) -> list[int]:
    """Ascending numbers for ranges that Spark deals out one to a bucket or task."""
    number = F.col("id").cast("int")
    found = spark.range(32 * ranges + 100).groupBy(
        F.pmod(F.hash(number), F.lit(ranges)).alias("at")).agg(F.min(number).alias("label"))
    return sorted(r["label"] for r in found.collect())


def batches(docs: DataFrame, labels: list[int]) -> DataFrame:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = _Batch()
        for rows in source:
            for doc_id, text in zip(rows.column(0).to_pylist(), common.utf8(rows.column(1))):
                batch.add(doc_id, text)
                if batch.tokens >= BATCH_TOKENS:
                    yield batch.emit(labels)
                    batch = _Batch()
        if batch.docs:
            yield batch.emit(labels)

    return common.documents(docs).mapInArrow(run, _BATCHES)


# ------------------------------------------------------------------- merged counts

def _asked(raw: bytes) -> tuple[np.ndarray, ...]:
    """Token hashes, pairs of each, contexts of the pairs, and their training counts.

    Contexts are as they are, or steps and tails of the different ones and an index.
    """
    hashes, per_word, *context, n = unpack(raw)
    if len(context) == 1:
        return hashes, per_word, context[0].astype(np.int64), n
    *coded, at = context
    return hashes, per_word, _places(*coded)[at], n


@dataclass
class Counts:
    """Training counts of a range: tokens by hash, their pairs by context.

    ``places`` are the contexts that anyone asks for, in training texts or others.
    """

    hashes: np.ndarray
    word: np.ndarray       # of each pair: index of its token
    context: np.ndarray
    n: np.ndarray
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def merged(cls, parts: list["Counts"]) -> "Counts":
        hashes = np.unique(np.concatenate([p.hashes for p in parts]))
        places = np.unique(np.concatenate([p.places for p in parts]))
        keys = np.concatenate([
            np.searchsorted(hashes, p.hashes)[p.word] * len(places)
            + np.searchsorted(places, p.context) for p in parts])
        keys, of = np.unique(keys, return_inverse=True)
        n = np.bincount(of, np.concatenate([p.n for p in parts]), len(keys)).astype(np.int64)
        return cls(hashes, keys // len(places), places[keys % len(places)], n, places)

    @classmethod
    def trained(cls, raw: bytes) -> "Counts":
        """The pairs of a batch that occur in its training documents."""
        hashes, per_word, context, n = _asked(raw)
        word, seen = np.repeat(np.arange(len(hashes)), per_word), n > 0
        words, word = np.unique(word[seen], return_inverse=True)
        return cls(hashes[words], word, context[seen], n[seen].astype(np.int64),
                   np.unique(context))

    def packed(self) -> bytes:
        per_word = np.bincount(self.word, minlength=len(self.hashes)).astype(np.uint32)
        at = np.searchsorted(self.places, self.context).astype(np.uint32)
        return pack(self.hashes, per_word, *_coded(self.places), at, self.n)

    @classmethod
    def unpacked(cls, raw: bytes) -> "Counts":
        hashes, per_word, *coded, at, n = unpack(raw)
        places = _places(*coded)
        word = np.repeat(np.arange(len(hashes), dtype=np.int32), per_word)
        return cls(hashes, word, places[at], n, places)


def counts_by_range(asked: DataFrame) -> DataFrame:
    """``range`` and ``state``: the merged counts, one row per range that has any."""
    def run(rows: pa.Table) -> pa.Table:
        parts, held = [], 0
        for raw in rows.column("pairs"):
            parts.append(Counts.trained(raw.as_py()))
            held += len(parts[-1].n)
            if held > 2 * len(parts[0].n) + _MERGE_AT:
                parts = [Counts.merged(parts)]
                held = len(parts[0].n)
        state = Counts.merged(parts).packed()
        return pa.table({"range": rows.column("range").combine_chunks()[:1],
                         "state": pa.array([state], pa.binary())})

    return (asked.select("range", "pairs").groupBy("range")
            .applyInArrow(run, "range int, state binary"))


# ------------------------------------------------------------------------- seating

@dataclass(frozen=True)
class Totals:
    """Customers and tables of restaurants, discounts by level, tokens, types."""

    customers: tuple[np.ndarray, np.ndarray, np.ndarray]   # by level: none, two bytes, word
    tables: tuple[np.ndarray, np.ndarray, np.ndarray]
    discounts: tuple[float, float, float]
    types: int
    tokens: int
    places: np.ndarray   # sorted contexts of the last level; after them an empty one

    def at(self, level: int, context: np.ndarray) -> np.ndarray:
        """Where the totals of contexts are."""
        if level < 2:
            return context
        at, found = _found(self.places, context)
        return np.where(found, at, len(self.places))

    def told(self, places: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> "Totals":
        """The same with the totals of some contexts of the last level and of an empty one."""
        return replace(self, places=places, customers=(*self.customers[:2], customers),
                       tables=(*self.tables[:2], tables))


@dataclass
class Seating:
    """Customers and tables of each dish of a range, by level."""

    counts: Counts
    up: tuple[np.ndarray, np.ndarray]   # row of the parent level for each row
    context: tuple[np.ndarray, np.ndarray, np.ndarray]
    customers: list[np.ndarray]
    tables: list[np.ndarray]

    @classmethod
    def first(cls, counts: Counts) -> "Seating":
        """One table for every dish of a restaurant."""
        keys, up2 = np.unique(counts.word.astype(np.int64) * _TAILS + counts.context % _TAILS,
                              return_inverse=True)
        up2 = up2.astype(np.int32)
        customers2 = counts.n
        customers1 = np.bincount(up2, minlength=len(keys))
        up1 = (keys // _TAILS).astype(np.int32)
        customers0 = np.bincount(up1, minlength=len(counts.hashes))
        customers = [customers0, customers1, customers2]
        return cls(counts, (up1, up2),
                   (np.zeros(len(counts.hashes), np.int32), (keys % _TAILS).astype(np.int32),
                    counts.context), customers, [np.ones(len(c), np.int32) for c in customers])

    def dish_weights(self, totals: Totals) -> list[np.ndarray]:
        """Predictive probability of each dish at its restaurant, by level but the last."""
        parent = np.full(len(self.customers[0]), 1 / (totals.types + 1))
        out = []
        for level in range(2):
            if level:
                parent = out[-1][self.up[level - 1]]
            at, d = self.context[level], totals.discounts[level]
            size = STRENGTH + totals.customers[level][at]
            own = (self.customers[level] - d * self.tables[level]) / size
            out.append(own + (STRENGTH + d * totals.tables[level][at]) / size * parent)
        return out

    def sweep(self, totals: Totals, random: np.random.Generator) -> None:
        """Reseat all dishes, children first; each parent's customers follow."""
        weights = self.dish_weights(totals)
        for level in (2, 1, 0):
            if level < 2:
                self.customers[level] = np.bincount(
                    self.up[level], self.tables[level + 1], len(self.customers[level])
                ).astype(np.int64)
            many = np.flatnonzero(self.customers[level] > 1)  # one customer has one table
            parent = (weights[level - 1][self.up[level - 1][many]] if level
                      else np.full(len(many), 1 / (totals.types + 1)))
            d, at = totals.discounts[level], totals.at(level, self.context[level][many])
            others = np.maximum(totals.tables[level][at] - self.tables[level][many], 0)
            self.tables[level] = np.ones(len(self.tables[level]), np.int32)
            self.tables[level][many] = seat(
                self.customers[level][many], (STRENGTH + d * others) * parent, d * parent, d, random)


def seat(customers: np.ndarray, opening: np.ndarray, growth: np.ndarray, discount: float,
         random: np.random.Generator) -> np.ndarray:
    """Tables after seating each dish's customers in turn (the first opens one).

    ``opening`` is the weight of a new table without the dish's own tables and
    ``growth`` what each of them adds.
    """
    order = np.argsort(-customers, kind="stable")
    size, opening, growth = customers[order], opening[order], growth[order]
    tables = np.ones(len(size), np.int64)
    seated, active = 1, np.searchsorted(-size, -1, "left")
    while active:
        t = tables[:active]
        new = opening[:active] + growth[:active] * t
        chance = new / (new + np.maximum(seated - discount * t, 1e-9))
        step = max(1, seated // 8)
        if step == 1:
            t += random.random(active) < chance
        else:
            t += random.binomial(np.minimum(step, size[:active] - seated), chance)
        seated += step
        active = np.searchsorted(-size[:active], -seated, "left")
    out = np.empty_like(tables)
    out[order] = tables
    return out


def _random(number: int, sweep: int) -> np.random.Generator:
    return np.random.default_rng([number, sweep])


def replay(counts: Counts, number: int, chain: list[Totals]) -> Iterator[Seating]:
    """The seatings of a range: the first, then one per sweep of the chain."""
    seating = Seating.first(counts)
    yield seating
    for sweep, totals in enumerate(chain):
        seating = replace(seating, customers=list(seating.customers), tables=list(seating.tables))
        seating.sweep(totals, _random(number, sweep))
        yield seating


def _chain(told: Iterable[tuple[int, bytes]], chain: list[Totals],
           places: np.ndarray) -> list[Totals]:
    """The chain with the totals a range was told, in the order of sweeps and contexts."""
    by_sweep = [[] for _ in chain]
    for sweep, raw in told:
        by_sweep[sweep].append(unpack(raw))
    last = [np.zeros(1, np.int64)]
    customers = np.concatenate([part[0] for part in by_sweep[0]] + last) if chain else None
    return [totals.told(places, customers, np.concatenate([part[-1] for part in parts] + last))
            for totals, parts in zip(chain, by_sweep)]


def _said(seating: Seating, ranges: int) -> Iterator[tuple[int, bytes]]:
    """What a range has in its contexts, for each range of contexts that it has any of.

    Contexts of the last level, two bytes, none, and the numbers of tokens, types and
    dishes with one and two customers go out together.
    """
    places = seating.counts.places
    at = np.searchsorted(places, seating.context[2])
    c, t = (np.bincount(at, w, len(places)).astype(np.uint64)
            for w in (seating.customers[2], seating.tables[2]))
    c1, t1 = (np.bincount(seating.context[1], w, _TAILS).astype(np.uint64)
              for w in (seating.customers[1], seating.tables[1]))
    tails = np.flatnonzero(c1)
    whole = [seating.customers[0].sum(), seating.tables[0].sum(), seating.customers[2].sum(),
             len(seating.customers[0])]
    whole += [(x == k).sum() for k in (1, 2) for x in seating.customers]
    edges = np.arange(ranges + 1)
    cut = np.searchsorted((places >> 16) * ranges >> _HASH_BITS, edges)
    tail_cut = np.searchsorted(tails * ranges >> 16, edges)
    for k in range(ranges):
        own, short = slice(cut[k], cut[k + 1]), tails[tail_cut[k]:tail_cut[k + 1]]
        if k == 0 or len(short) or own.start < own.stop:
            yield k, pack(*_coded(places[own]), c[own], t[own], short.astype(np.uint16), c1[short],
                          t1[short], np.array(whole if k == 0 else [], np.int64))


def _summed(parts: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Totals of a range of contexts, for each range that has any; the short ones under -1."""
    asked = [(number, unpack(raw)) for number, raw in parts]
    places = [_places(*part[:2]) for _, part in asked]
    keys, of = np.unique(np.concatenate(places), return_inverse=True)
    c, t = (np.bincount(of, np.concatenate([part[k] for _, part in asked]), len(keys)).astype(
        np.uint64) for k in (2, 3))
    start = 0
    for (number, _), own in zip(asked, places):
        at = of[start:start + len(own)]
        start += len(own)
        if len(own):
            yield number, pack(c[at].astype(np.int64), t[at].astype(np.int64))
    tails, of = np.unique(np.concatenate([part[4] for _, part in asked]), return_inverse=True)
    short = [np.bincount(of, np.concatenate([part[k] for _, part in asked]), len(tails)).astype(
        np.int64) for k in (5, 6)]
    whole = [part[7] for _, part in asked if len(part[7])]
    yield -1, pack(tails, *short, np.sum(whole, axis=0) if whole else np.zeros(0, np.int64))


def _round(state: DataFrame, told: list[DataFrame], chain: list[Totals], labels: list[int]) -> DataFrame:
    """Ranges seat what the chain says and are told the totals: ``range``, ``part``, ``told``."""
    ranges = len(labels)

    def say(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            for number, raw, *heard in zip(rows.column(0).to_pylist(), rows.column(1),
                                           rows.column(2), rows.column(3)):
                counts = Counts.unpacked(raw.as_py())
                heard = zip(*(column.as_py() or [] for column in heard))
                *_, last = replay(counts, number, _chain(heard, chain, counts.places))
                for part, said in _said(last, ranges):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([labels[part]], pa.int32()), pa.array([number], pa.int32()),
                         pa.array([said], pa.binary())], ["part", "range", "said"])

    def tell(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def done():
            for number, raw in _summed(parts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int32()), pa.array([at], pa.int32()),
                     pa.array([raw], pa.binary())], ["range", "part", "told"])

        for rows in source:
            for part, number, raw in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(),
                                         rows.column(2)):
                if part != at and parts:
                    yield from done()
                    parts = []
                at = part
                parts.append((number, raw.as_py()))
        if parts:
            yield from done()

    return (_heard(state, told, ranges).mapInArrow(say, "part int, range int, said binary")
            .repartition(ranges, "part").sortWithinPartitions("part")
            .mapInArrow(tell, "range int, part int, told binary"))


def _heard(state: DataFrame, told: list[DataFrame], ranges: int) -> DataFrame:
    """Ranges with the totals they were told, by sweep and contexts: ``state``, ``sweep``, ``told``."""
    if not told:
        return state.select("range", "state", F.lit(None).cast("array<int>").alias("sweep"),
                            F.lit(None).cast("array<binary>").alias("told"))
    rows = None
    for sweep, frame in enumerate(told):
        frame = frame.filter("range >= 0").withColumn("sweep", F.lit(sweep))
        rows = frame if rows is None else rows.unionByName(frame)
    heard = rows.repartition(ranges, "range").groupBy("range").agg(
        F.sort_array(F.collect_list(F.struct("sweep", "part", "told"))).alias("heard"))
    return state.join(heard, "range", "left").select(
        "range", "state", F.col("heard.sweep"), F.col("heard.told"))


def _totals(rows: Iterable, discounts: tuple[float, ...] | None) -> Totals:
    """Sums by level and context: of the last level those given, 65,537 others at most."""
    rows = list(rows)
    places = np.array(sorted(r["context"] for r in rows if r["level"] == 2), np.int64)
    sizes = (1, _TAILS, len(places) + 1)
    customers = tuple(np.zeros(n, np.int64) for n in sizes)
    tables = tuple(np.zeros(n, np.int64) for n in sizes)
    once, twice, types = [0] * 3, [0] * 3, 0
    for r in rows:
        level, at = r["level"], r["context"]
        at = np.searchsorted(places, at) if level == 2 else at
        customers[level][at] = r["c"]
        tables[level][at] = r["t"]
        once[level] += r["once"]
        twice[level] += r["twice"]
        types += r["dishes"] if level == 0 else 0
    return Totals(customers, tables, discounts or _discounts(once, twice), types,
                  int(customers[2].sum()), places)


def _discounts(once, twice) -> tuple[float, ...]:
    return tuple(min(0.95, max(0.05, a / (a + 2 * b) if a + b else 0.5))
                 for a, b in zip(once, twice))


def _short_totals(parts: list[bytes], discounts: tuple[float, ...] | None) -> Totals:
    """Totals of the contexts of two bytes and of none, whatever the corpus 65,537 at most."""
    c, t = np.zeros(_TAILS, np.int64), np.zeros(_TAILS, np.int64)
    whole = np.zeros(10, np.int64)
    for raw in parts:
        tails, customers, tables, numbers = unpack(raw)
        c[tails], t[tails] = customers, tables
        if len(numbers):
            whole += numbers
    first, first_t, tokens, types, *rare = whole.tolist()
    empty = np.zeros(1, np.int64)
    return Totals((np.array([first]), c, empty), (np.array([first_t]), t, empty),
                  discounts or _discounts(rare[:3], rare[3:]), types, tokens, empty[:0])


def gibbs(state: DataFrame, labels: list[int], folder: str,
          sweeps: int = SWEEPS) -> tuple[list[Totals], list[DataFrame]]:
    """Totals of the first seating and after each sweep: the short contexts', and as told."""
    chain, told = [], []
    for sweep in range(sweeps + 1):
        said = common.stored(_round(state, told, list(chain), labels), folder, f"told_{sweep}")
        short = [bytes(r["told"]) for r in said.filter("range < 0").select("told").collect()]
        chain.append(_short_totals(short, chain[0].discounts if chain else None))
        told.append(said)
    return chain, told


# ------------------------------------------------------------------------- scoring

class _Predictor:
    """Log10 of the averaged predictive probabilities of pairs of a range."""

    def __init__(self, counts: Counts, number: int, chain: list[Totals], burn_in: int = BURN_IN):
        first = min(burn_in + 1, len(chain) - 1)
        self.chain, self.hashes = chain[first:], counts.hashes
        self.wide = len(self.chain[0].places) + 1
        # By seating and level, of each row the customers less the discounts of its tables.
        self.samples: list[list[np.ndarray]] = []
        if len(counts.hashes):
            for k, seating in enumerate(replay(counts, number, chain[:-1])):
                if k >= first:
                    self.samples.append([(c - d * t).astype(np.float32) for c, t, d in zip(
                        seating.customers, seating.tables, chain[k].discounts)])
            self.short_keys = seating.up[0].astype(np.int64) * _TAILS + seating.context[1]
        self.pair_keys = (counts.word.astype(np.int64) * self.wide
                          + self.chain[0].at(2, counts.context))
        self.n = np.bincount(counts.word, counts.n, len(counts.hashes)).astype(np.int64)

    def answer(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of each pair asked for and count of each token."""
        hashes, per_word, context, _ = _asked(raw)
        word = np.repeat(np.arange(len(hashes)), per_word)
        token, known = _found(self.hashes, hashes)
        n = np.where(known, self.n[token] if len(self.n) else 0, 0)
        tail, place = context % _TAILS, self.chain[0].at(2, context)
        # The rows of the pairs at each level, the same in all seatings.
        rows = [(token, known)]
        if self.samples:
            for keys, wide, at in ((self.short_keys, _TAILS, tail),
                                   (self.pair_keys, self.wide, place)):
                row, found = _found(keys, token[word] * wide + at)
                rows.append((row, found & known[word]))
        total = np.zeros(len(word))
        for k, totals in enumerate(self.chain):
            p = np.full(len(known), 1 / (totals.types + 1))
            for level, at in enumerate((0, tail, place)):
                if level == 1:  # from tokens to pairs
                    p = p[word]
                d = totals.discounts[level]
                size = STRENGTH + totals.customers[level][at]
                own = 0.0
                if self.samples:
                    row, found = rows[level]
                    own = np.where(found, self.samples[k][level][row], 0) / size
                p = own + (STRENGTH + d * totals.tables[level][at]) / size * p
            total += p
        return np.log10(total / len(self.chain)).astype(np.float32), n


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def answers(asked: DataFrame, state: DataFrame, chain: list[Totals], told: list[DataFrame],
            ranges: int) -> DataFrame:
    """``batch``, ``range`` and ``answer``: the counts of a range meet its askers."""
    shared = state.sparkSession.sparkContext.broadcast(chain)

    def run(rows: pa.Table, model: pa.Table) -> pa.Table:
        number, raw, *heard = (model.column(k)[0].as_py() for k in range(4))
        counts = Counts.unpacked(raw)
        heard = _chain(zip(*(h or [] for h in heard)), shared.value, counts.places)
        predictor = _Predictor(counts, number, heard)
        del counts, raw, heard
        said = [pack(*predictor.answer(pairs.as_py())) for pairs in rows.column("pairs")]
        return pa.table({"batch": rows.column("batch"), "range": rows.column("range"),
                         "answer": pa.array(said, pa.binary())})

    return (asked.select("batch", "range", "pairs").groupBy("range")
            .cogroup(_heard(state, told, ranges).groupBy("range"))
            .applyInArrow(run, "batch string, range int, answer binary"))


def _scored(docs: bytes, answer: list[bytes], tokens: int, types: int) -> pa.RecordBatch:
    ids, null, held, sizes, steps, per_word = unpack(docs)
    found = [unpack(raw) for raw in answer]
    log_p = np.concatenate([a for a, _ in found]).astype(float)
    n = np.repeat(np.concatenate([b for _, b in found]), per_word)
    pair = (np.cumsum(steps) % np.uint64(max(1, len(log_p)))).astype(np.int64)
    start = np.cumsum(sizes) - sizes
    sums = lambda values: np.add.reduceat(values[pair], start)
    base = sums(np.log10(n + 1.0)) - sizes * np.log10(tokens + types + 1.0)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(held.astype(bool)),
         pa.array(sizes), pa.array(sums((n > 0).astype(np.int64))),
         pa.array(np.full(len(ids), tokens)), pa.array(base), pa.array(sums(log_p))],
        [f.split()[0] for f in RESULT.split(", ")])


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Whatever is stored meanwhile needs its shuffle files no more."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bucketed(frame: DataFrame, path: str, ranges: int) -> DataFrame:
    """Stored by range, so that what meets it by range does not shuffle it again."""
    name = f"pitman_yor_{uuid.uuid4().hex}"
    frame.write.format("parquet").bucketBy(ranges, "range").option("path", path).saveAsTable(name)
    return frame.sparkSession.table(name)


def score_documents(docs: DataFrame) -> DataFrame:
    """Base and model log10 probability of every text, trained on the other folds."""
    spark = docs.sparkSession
    folder = common.scratch(spark)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    ranges = int(min(MOST_RANGES, max(LEAST_RANGES, size // RANGE_BYTES)))
    labels = even_labels(spark, ranges)
    ranges = len(labels)
    with _shuffles_dropped(spark):
        rows = batches(docs, labels).repartition(ranges, "range")
        rows = _bucketed(rows, f"{folder}/batches", ranges)
        asked = rows.filter("pairs IS NOT NULL")
        state = _bucketed(counts_by_range(asked), f"{folder}/state", ranges)
        chain, told = gibbs(state, labels, folder)
    tokens, types = chain[0].tokens, chain[0].types
    said = answers(asked, state, chain, told, ranges)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer: list[bytes] = []
        for part in source:
            for said, own in zip(part.column(2), part.column(3)):
                if own.as_py() is None:
                    answer.append(said.as_py())
                else:  # the documents come after all answers to their batch
                    yield _scored(own.as_py(), answer, tokens, types)
                    answer = []

    none = F.lit(None).cast("binary")
    own = rows.filter("docs IS NOT NULL").select(
        "batch", F.lit(2**31 - 1).alias("range"), none.alias("answer"), "docs")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ranges)
    return (said.withColumn("docs", none).unionByName(own)
            .repartition(parts, "batch").sortWithinPartitions("batch", "range")
            .mapInArrow(run, RESULT))


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of the model and of the base, by ``held_out``."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(
        per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
