"""The corpus pipeline: each stage reads what the one before it kept.

Cases: a document with a null or empty text is judged like any other by the models'
curves, has the zero fingerprint and so one component with its like, holds no benchmark
window and encodes to no token.  A null id is carried along; of repeated rows, and of
rows that are near copies, one stays, the one with the smallest id (null last).  Texts
of any length are read whole.  Where labels are lacking, so that a model cannot be
trained, its stage keeps every document; without a benchmark nothing is contaminated;
an empty table of documents gives an empty result.  Extra columns are carried through
all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from deskgauge.llm import (
    byte_bpe, common, compression_quality, decontamination, near_duplicates, toxicity,
)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = compression_quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return compression_quality.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_documents(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digest_documents(
        docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

# Trained models decide in two stages; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    folder = common.scratch(spark)
    docs = common.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return result
        docs = common.stored(result, folder, f"stage{number}")
