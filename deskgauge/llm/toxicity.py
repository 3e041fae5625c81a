"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the bytes of words, one of toxic and one
of ordinary labelled texts, share their lower orders: an n-gram that a class has
not seen backs off to continuation counts pooled over both, so a rare word that
neither knows says nothing.  Each word gets the difference of the two log
likelihoods, normalised by its length.  Five bytes cannot tell a word made of
common syllables, whose n-grams ordinary texts are full of.  So a level of whole words
lies above the bytes, in the same back-off: of the number of a class's texts that
have a word, ``WORD_DISCOUNT`` is taken off, and what that leaves over goes to the
probability of its bytes, the mean of both classes.  A word of one event needs no
normalising; a rare one, in no more toxic texts than the discount, is as good as unseen.
The features of a text are the greatest difference of a word's bytes, their mean over the
whole text, and the greatest difference of a whole word above that of an unseen word; a
logistic curve fitted on labelled texts that the models have not seen makes them a
probability.

The fit reads a bounded sample of the labelled rows (``SAMPLE_ROWS`` per label,
smallest hash of the id first), counts their n-grams as a Spark job and brings
one row per distinct n-gram and per word that the toxic discount leaves to the driver:
the sampled rows are the only bound.  Scores read every text whole.

Words are runs of anything but ASCII white space, ASCII capitals lowered.
Cases: a null or empty text has all features 0; with one label only, or none,
every score is the share of label 1, predicted by the same threshold, but every document
is accepted; repeated rows repeat their score.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deskgauge.llm import common

FOLDS, HELD_OUT = 4, 2
SAMPLE_ROWS = 6000
ORDER = 5          # bytes of an n-gram; packed in one 64-bit number
SHARED = 3         # orders below this one are pooled over both classes
DISCOUNT = 0.9
# Off a word's toxic and ordinary texts; the least loss of four-fold cross-validation among
# labelled texts outside the held-out fold, of ten pairs from 2.9 to 4.9 and 0.2 to 0.5.
WORD_DISCOUNT = (3.5, 0.5)
THRESHOLD = 0.3
BLOCK = 3_000_000    # bytes of text in memory at a time

_PAD = b"\0" * (ORDER - 1)
_SPACE = 32


def _positions(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of padded words, the positions to predict, and the word of each."""
    if not words:
        return (np.zeros(0, np.uint8), *(np.zeros(0, np.int64) for _ in range(2)))
    raw = np.frombuffer(_PAD + (b" " + _PAD).join(w.replace(b"\0", b"\1") for w in words) + b" ",
                        np.uint8)
    at = np.flatnonzero(raw)
    space = raw == _SPACE
    return raw, at, (np.cumsum(space) - space)[at]


def _grams(raw: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` bytes up to and with each position, packed."""
    out = np.zeros(len(at), np.uint64)
    for back in range(order - 1, -1, -1):
        out = (out << np.uint64(8)) | raw[np.maximum(at - back, 0)].astype(np.uint64)
    return out


@dataclass(frozen=True)
class Order:
    """Log probabilities of the seen n-grams and log back-off of the contexts."""

    grams: np.ndarray      # sorted
    prob: np.ndarray       # toxic, ordinary
    contexts: np.ndarray   # sorted
    backoff: np.ndarray    # toxic, ordinary


@dataclass(frozen=True)
class Model:
    orders: tuple[Order, ...]
    words: dict[bytes, float]   # difference above that of an unseen word
    weights: np.ndarray

    def rejects(self, scores: np.ndarray) -> np.ndarray:
        """Without trained models no text is."""
        return (scores >= THRESHOLD) & bool(self.orders)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def _difference(orders: tuple[Order, ...], raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Toxic minus ordinary log probability of each position, longest n-gram first."""
    total = np.zeros(len(at))
    left = np.arange(len(at))
    for n in range(len(orders), 0, -1):
        if not len(left):
            break
        order, gram = orders[n - 1], _grams(raw, at[left], n)
        i, seen = _find(order.grams, gram)
        total[left[seen]] += order.prob[0, i[seen]] - order.prob[1, i[seen]]
        left, gram = left[~seen], gram[~seen]
        j, known = _find(order.contexts, gram >> np.uint64(8))
        total[left[known]] += order.backoff[0, j[known]] - order.backoff[1, j[known]]
    return total


def _build(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[Order, ...]:
    """Orders from (sorted n-grams, counts per class) of every length.

    Below the longest, counts are numbers of distinct left extensions.  From
    ``SHARED`` on each class has its own; under it they are pooled.
    """
    orders: list[Order] = []
    for n in range(1, len(tables) + 1):
        grams, counts = tables[n - 1]
        if n < len(tables):
            longer, above = tables[n]
            at, seen = _find(grams, longer & np.uint64((1 << (8 * n)) - 1))
            pooled = above.sum(axis=0, keepdims=True).repeat(2, axis=0)
            source = (above if n >= SHARED else pooled) > 0
            counts = np.stack([np.bincount(at[seen & s], minlength=len(grams)) for s in source])
        counts = counts.astype(float)
        contexts, of = np.unique(grams >> np.uint64(8), return_inverse=True)
        total = np.stack([np.bincount(of, c, len(contexts)) for c in counts])
        types = np.stack([np.bincount(of, c > 0, len(contexts)) for c in counts])
        # A context that a class has not seen passes everything on.
        backoff = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
        if n == 1:
            lower = np.full(counts.shape, 1 / 256)
        else:
            lower = _probability(orders, grams & np.uint64((1 << (8 * (n - 1))) - 1), n - 1)
        seen = np.maximum(counts - DISCOUNT, 0) / np.maximum(total, 1)[:, of]
        prob = seen + backoff[:, of] * lower
        orders.append(Order(grams, np.log(prob), contexts, np.log(backoff)))
    return tuple(orders)


def _probability(orders: list[Order], grams: np.ndarray, n: int) -> np.ndarray:
    """Probability of packed n-grams of length ``n`` under both classes."""
    out = np.zeros((2, len(grams)))
    left = np.arange(len(grams))
    for k in range(n, 0, -1):
        order, gram = orders[k - 1], grams[left] & np.uint64((1 << (8 * k)) - 1)
        i, seen = _find(order.grams, gram)
        out[:, left[seen]] += order.prob[:, i[seen]]
        left, gram = left[~seen], gram[~seen]
        j, known = _find(order.contexts, gram >> np.uint64(8))
        out[:, left[known]] += order.backoff[:, j[known]]
    out[:, left] += np.log(1 / 256)
    return np.exp(out)


class Scorer:
    """Features of texts; distinct words of a block of texts are looked up once."""

    def __init__(self, model: Model):
        self.model = model

    def features(self, texts: Iterable[bytes]) -> np.ndarray:
        """One row per text, ``BLOCK`` bytes or one text at a time."""
        out, block, size = [np.zeros((0, 3))], [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= BLOCK:
                out.append(self._block(block))
                block, size = [], 0
        return np.concatenate([*out, self._block(block)])

    def _block(self, texts: list[bytes]) -> np.ndarray:
        ids: dict[bytes, int] = defaultdict(count().__next__)
        rows = [np.fromiter(map(ids.__getitem__, t.lower().split()), np.int64) for t in texts]
        raw, at, owner = _positions(list(ids))
        difference = np.bincount(owner, _difference(self.model.orders, raw, at), len(ids))
        length = np.bincount(owner, minlength=len(ids))
        above = np.fromiter(map(self.model.words.get, ids, repeat(0.0)), float, len(ids))
        out = np.zeros((len(texts), 3))
        normalised = difference / np.maximum(length, 1)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        full = np.flatnonzero(sizes)
        if len(full):
            flat = np.concatenate([rows[i] for i in full])
            start = np.cumsum(sizes[full]) - sizes[full]
            out[full, 0] = np.maximum.reduceat(normalised[flat], start)
            out[full, 1] = (np.add.reduceat(difference[flat], start)
                            / np.add.reduceat(length[flat], start))
            out[full, 2] = np.maximum(np.maximum.reduceat(above[flat], start), 0)
        return out

    def scores(self, texts: Iterable[bytes]) -> np.ndarray:
        if not self.model.orders:
            return common.logistic(np.zeros((sum(1 for _ in texts), 3)), self.model.weights)
        return common.logistic(self.features(texts), self.model.weights)


def _word_counts(sample: DataFrame) -> DataFrame:
    """A written table of the words of the sample: occurrences and texts, by class."""
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            texts: Counter = Counter()
            for text, label in zip(common.utf8(batch.column(0)), batch.column(1).to_pylist()):
                once = Counter((w, label) for w in text.lower().split())
                found.update(once)
                texts.update(once.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in found], pa.binary()),
                 pa.array([k for _, k in found], pa.int32()),
                 pa.array(list(found.values()), pa.int64()),
                 pa.array([texts[w] for w in found], pa.int64())],
                ["word", "label", "n", "texts"])

    count = lambda c, k: F.sum(F.when(F.col("label") == k, F.col(c)).otherwise(0))
    counted = (
        sample.select("text", "label")
        .mapInArrow(words, "word binary, label int, n bigint, texts bigint")
        .groupBy("word").agg(
            count("n", 1).alias("toxic"), count("n", 0).alias("ordinary"),
            count("texts", 1).alias("toxic_texts"), count("texts", 0).alias("ordinary_texts"))
    )
    return common.stored(counted, common.scratch(sample.sparkSession), "words")


def _word_level(counted: DataFrame, orders: tuple[Order, ...]) -> dict[bytes, float]:
    """Toxic minus ordinary log probability of words, above that of an unseen word.

    Words that the toxic discount leaves nothing of are not above it.
    """
    texts = ("toxic_texts", "ordinary_texts")
    whole = counted.agg(*[
        F.coalesce(F.sum(value).cast("double"), F.lit(0.0)) for c, d in zip(texts, WORD_DISCOUNT)
        for value in (F.col(c), F.least(F.col(c), F.lit(d)))]).first()
    total, passed = np.array(whole[0::2]), np.array(whole[1::2])
    rows = counted.filter(F.col(texts[0]) > WORD_DISCOUNT[0]).select("word", *texts).toArrow()
    words = rows.column("word").to_pylist()
    if not words or not total.all():
        return {}
    raw, at, owner = _positions(words)
    letters = np.log(_probability(list(orders), _grams(raw, at, ORDER), ORDER))
    spelled = np.stack([np.bincount(owner, p, len(words)) for p in letters])
    shared = np.logaddexp(*spelled) - np.log(2)
    return dict(zip(words, _above_unseen(
        np.stack([rows.column(c).to_numpy() for c in texts]), total, passed, shared).tolist()))


def _above_unseen(texts: np.ndarray, total: np.ndarray, passed: np.ndarray,
                  shared: np.ndarray) -> np.ndarray:
    """``texts``: of each class with the word; ``shared``: log probability of its bytes."""
    kept = np.maximum(texts - np.array(WORD_DISCOUNT)[:, None], 0) / total[:, None]
    base = np.log(passed / total)[:, None] + shared
    with np.errstate(divide="ignore"):
        above = np.logaddexp(np.log(kept), base) - base
    return above[0] - above[1]


def _gram_counts(words: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of the n-grams of every length in the words, by class."""
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at, owner = _positions(batch.column(0).to_pylist())
            weight = [batch.column(k).to_numpy(zero_copy_only=False)[owner] for k in (1, 2)]
            for n in range(1, ORDER + 1):
                keys, of = np.unique(_grams(raw, at, n), return_inverse=True)
                sums = [np.bincount(of, w, len(keys)).astype(np.int64) for w in weight]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), n, np.int32)),
                     pa.array(keys.view(np.int64)), *map(pa.array, sums)],
                    ["order", "gram", "toxic", "ordinary"])

    counted = (
        words.select("word", "toxic", "ordinary")
        .mapInArrow(grams, "order int, gram bigint, toxic bigint, ordinary bigint")
        .groupBy("order", "gram").agg(F.sum("toxic").alias("toxic"),
                                      F.sum("ordinary").alias("ordinary"))
    )
    counted = common.stored(counted, common.scratch(words.sparkSession), "grams")
    tables = []
    for n in range(1, ORDER + 1):
        rows = counted.filter(F.col("order") == n).select("gram", "toxic", "ordinary").toArrow()
        keys = rows.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        tables.append((keys[order], np.stack(
            [rows.column(c).to_numpy()[order] for c in ("toxic", "ordinary")])))
    return tables


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Both models and the curve, from the bounded sample."""
    sample, counts = common.labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, SAMPLE_ROWS)
    constant = Model((), {}, np.array([0.0, 0.0, 0.0, common.prior(counts)]))
    words = _word_counts(sample.filter(~F.col("curve")))
    tables = _gram_counts(words)
    if not all(c.any() for c in tables[-1][1]):
        return constant
    orders = _build(tables)
    model = Model(orders, _word_level(words, orders), constant.weights)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            rows = scorer.features(common.utf8(batch.column(0)))
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, rows.T.copy()), batch.column(1)], ["a", "b", "c", "label"])

    rows = sample.filter("curve").select("text", "label").mapInArrow(
        run, "a double, b double, c double, label int").toArrow()
    label = rows.column("label").to_numpy()
    if len(set(label.tolist())) < 2:
        return constant
    features = np.column_stack([rows.column(c).to_numpy() for c in "abc"])
    order = np.lexsort((label, *features.T))  # sums in one order
    return Model(model.orders, model.words, common.logistic_fit(features[order], label[order], counts))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Probability of label 1 of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model)
        for batch in batches:
            ids = batch.column(0)
            held = [common.crc_of_id(i) % FOLDS == HELD_OUT for i in ids.to_pylist()]
            values = scorer.scores(common.utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(held, pa.bool_()), pa.array(values, pa.float64()),
                 pa.array((values >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return common.documents(docs).mapInArrow(
        run, "doc_id bigint, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(ids, texts):
        model = shared.value
        return ~model.rejects(Scorer(model).scores(common.utf8(texts)))

    return common.filtered(docs, keep)
