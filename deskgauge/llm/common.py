"""Small helpers the operators share: stored tables, Arrow columns, splits."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared folder that the session names.

    Whoever owns that folder clears it; nothing in it is needed after the job.  Without
    it the warehouse serves, on a cluster only if it is not a folder of one machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir")
        if shared.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/')}/llm-{uuid.uuid4()}"


def stored(frame: DataFrame, folder: str, name: str) -> DataFrame:
    """The frame as a written table: lineage ends there and lost executors cost nothing."""
    path = f"{folder}/{name}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """Id and text alone: other columns, whatever their names, stay out of the way."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value, one at a time; null gives none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for value in raw:
        yield value.as_py() or b""


def crc_of_id(doc_id: int | None) -> int:
    """crc32 of the id as text; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def crc_column(name: str = "doc_id") -> Column:
    """The same value as a column."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def filtered(docs: DataFrame, keep) -> DataFrame:
    """Rows of ``docs`` that ``keep(ids, texts)`` marks, with all their columns.

    ``keep`` gets the doc_id and text columns of an Arrow batch and returns one
    boolean per row.  The batch is cut by position, so no column is added.
    """
    names = docs.columns
    at_id, at_text = names.index("doc_id"), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = keep(batch.column(at_id), batch.column(at_text))
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int,
                    rows: int) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample of labelled texts as a written table, and all labels' counts.

    Of each label the ``rows`` ids with the smallest hash are taken, outside the
    held-out fold; only these ids (``2 * rows`` at most) are broadcast to the
    documents.  ``curve`` marks a quarter of each label's, for the calibration: those
    with the smallest other hash, one at least where a label has two.  A document with several labels counts with its greatest; of an id repeated in
    the documents the least text is taken, so the sample stays within the bound.
    """
    crc = crc_column()
    known = (
        labels.select(F.col("doc_id").cast("bigint"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(crc % folds != held_out)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    counts = {0: 0, 1: 0} | {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    at = F.xxhash64("doc_id")
    chosen = [known.filter(F.col("label") == k).orderBy(at, "doc_id").limit(rows) for k in (0, 1)]
    sample = (
        documents(docs)
        .join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
        .groupBy("doc_id", "label").agg(F.min("text").alias("text"))
        .select("text", "label", F.xxhash64("doc_id", F.lit("curve")).alias("at"))
    )
    sample = stored(sample, scratch(docs.sparkSession), f"sample_{label}")
    hashes = sample.select("label", "at").toArrow()  # 2 * rows at most
    curve = F.lit(False)
    for k in (0, 1):
        there = np.sort(hashes.column("at").to_numpy()[hashes.column("label").to_numpy() == k])
        if len(there) > 1:
            last = int(there[max(1, len(there) // 4) - 1])
            curve |= (F.col("label") == k) & (F.col("at") <= last)
    return sample.select("text", "label", curve.alias("curve")), counts


def logistic_fit(features, labels, counts: dict[int, int], ridge: float = 1e-4,
                 steps: int = 50) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression by Newton's method.

    Features are scaled to unit deviation for the ridge, those without any left as they are.  ``counts`` are the
    labels' numbers in the whole corpus; the intercept is moved from the shares
    in the sample to theirs.  A step that would raise the loss is halved, so that
    labels which a feature nearly separates cannot throw the weights away.
    """
    features = np.asarray(features, float)
    scale = features.std(axis=0) + 1e-12
    scale[scale < 2e-12] = 1  # equal on all texts
    x = np.column_stack([features / scale, np.ones(len(features))])
    y = np.asarray(labels, float)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(1, len(y)))
    penalty[-1] = 1e-6

    def loss(w):
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(penalty * w * w))

    at = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        while (after := loss(w - step)) > at + 1e-9 * abs(at) and np.abs(step).max() > 1e-9:
            step /= 2
        w -= step
        at = after
        if np.abs(step).max() < 1e-9:
            break
    w[:-1] /= scale
    w[-1] += prior(counts) - np.log((y.sum() + 1) / ((1 - y).sum() + 1))
    return w


def prior(counts: dict[int, int]) -> float:
    """Log odds of label 1."""
    return float(np.log((counts[1] + 1) / (counts[0] + 1)))


def logistic(features, weights: np.ndarray) -> np.ndarray:
    z = np.asarray(features, float) @ weights[:-1] + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
