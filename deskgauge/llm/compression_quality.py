"""Quality classifier by compression.

A zstandard dictionary is trained from pieces of good labelled texts and one
from pieces of bad ones.  A text is compressed whole, piece by piece, with
either.  What the good dictionary saves against the bad one, normalised by the
size of the text, is the feature; the normalised size itself and its square
stand beside it, as a text of one repeated word saves nothing with either.  A
logistic curve fitted on labelled texts that neither dictionary has seen turns
them into a probability of label 1.

The fit reads a bounded sample of the labelled rows (``SAMPLE_ROWS`` per label,
smallest hash of the id first), the only bound; scores read every text whole.

Cases: a null or empty text has no difference and gets the curve's value there;
with one label or too few texts to train on, every score is the share of label 1
(0.5 without labels), predicted by the same threshold, but every document is accepted;
repeated rows repeat their score; a document with several labels counts with its
greatest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from deskgauge.llm import common

FOLDS, HELD_OUT = 5, 0
SAMPLE_ROWS = 4000
PIECE = 2048
DICTIONARY = 262_144
LEVEL = 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the weights of the curve."""

    good: bytes
    bad: bytes
    weights: np.ndarray

    def keeps(self, scores: np.ndarray) -> np.ndarray:
        """Without dictionaries all texts are kept."""
        return (scores >= THRESHOLD) | (not (self.good and self.bad))


def pieces(text: bytes) -> list[bytes]:
    return [text[i:i + PIECE] for i in range(0, len(text), PIECE)]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.compress = [
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw),
                write_content_size=False, write_dict_id=False).compress
            for raw in (model.good, model.bad) if raw
        ]

    def features(self, text: bytes) -> tuple[float, float, float]:
        """Bytes the good dictionary saves per byte, and the size with it and squared."""
        if not self.compress:
            return 0.0, 0.0, 0.0
        good, bad = (sum(len(c(p)) for p in pieces(text)) for c in self.compress)
        size = (good + 50) / (len(text) + 100)
        return (bad - good) / (len(text) + 200), size, size * size

    def scores(self, texts) -> np.ndarray:
        rows = np.array([self.features(t) for t in texts], float).reshape(-1, 3)
        return common.logistic(rows, self.model.weights)


def _dictionary(sample: DataFrame, label: int) -> bytes:
    """Dictionary from the pieces of one label with the smallest hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [p for text in common.utf8(batch.column(0)) for p in pieces(text)]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], ["piece"])

    parts = (
        sample.filter((F.col("label") == label) & ~F.col("curve")).select("text")
        .mapInArrow(run, "piece binary")
        .orderBy(F.xxhash64("piece"), "piece")
        .toArrow().column("piece").to_pylist()
    )
    size = min(DICTIONARY, sum(map(len, parts)) // 4)
    if size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too few or too equal pieces for the trainer
        return b""


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on the sample; the driver gets the pieces of the dictionaries and, of
    the texts for the curve, three numbers each."""
    sample, counts = common.labelled_sample(
        docs, labels, "quality", FOLDS, HELD_OUT, SAMPLE_ROWS)
    constant = Model(b"", b"", np.array([0.0, 0.0, 0.0, common.prior(counts)]))
    good, bad = _dictionary(sample, 1), _dictionary(sample, 0)
    if not (good and bad):
        return constant
    shared = docs.sparkSession.sparkContext.broadcast(Model(good, bad, constant.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            rows = np.array([scorer.features(t) for t in common.utf8(batch.column(0))])
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, rows.reshape(-1, 3).T.copy()), batch.column(1)],
                ["a", "b", "c", "label"])

    rows = sample.filter("curve").select("text", "label").mapInArrow(
        run, "a double, b double, c double, label int").toArrow()
    label = rows.column("label").to_numpy()
    if len(set(label.tolist())) < 2:
        return constant
    features = np.column_stack([rows.column(c).to_numpy() for c in "abc"])
    order = np.lexsort((label, *features.T))  # sums in one order
    return Model(good, bad, common.logistic_fit(features[order], label[order], counts))


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
    """The documents the classifier keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(ids, texts):
        model = shared.value
        return model.keeps(Scorer(model).scores(common.utf8(texts)))

    return common.filtered(docs, keep)
