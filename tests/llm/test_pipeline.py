"""The pipeline against its stages written plainly, and its registration."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from checks import compare
from conftest import SMALL
from deskgauge.llm import byte_bpe, common, compression_quality, decontamination, queries, toxicity
from llm import samples
from llm.test_near_duplicates import linked, plain_components, plain_fingerprint
from llm.test_text_operators import plain_report


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {n[:n.index("_") + 1] for n in names if n[:2] == "op"}
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
    assert set(queries.ORACLE) <= names


def test_pipeline(spark):
    sf = SMALL
    docs = common.table(spark, sf, "documents")
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}

    labels = common.table(spark, sf, "labels")
    calm = toxicity.score(docs, toxicity.fit(docs, labels)).filter("predicted = 0")
    docs = docs.join(calm.select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    good = compression_quality.score(docs, compression_quality.fit(docs, labels)).filter("predicted = 1")
    rows = docs.join(good.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text").collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    root = plain_components(prints.values(), linked)
    first = {}
    for i in sorted(prints):
        first.setdefault(root[prints[i]], i)
    rows = [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] in first.values()]
    items = [(r["item_id"], r["text"]) for r in common.table(spark, sf, "benchmark").collect()]
    clean = [r[0] for r in plain_report(rows, items) if not r[-1]]
    assert sorted(found) == sorted(clean) and len(clean) > 50

    vocab = byte_bpe.load(queries.RANKS, queries.public_tokenizers.PATTERN)
    texts = dict(rows)
    for i, ids in zip(clean, byte_bpe.Encoder(vocab).encode([texts[i] for i in clean])):
        assert found[i]["n_tokens"] == len(ids) // 4


def written(folder, **frames):
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_awkward_tables(spark, tmp_path):
    """Without labels and benchmark only copies go."""
    long = "word " * 40_000
    rows = [(1, None), (2, ""), (None, ""), (3, "some text of its own"), (3, "some text of its own"),
            (None, "some text of its own"), (None, "another one"), (5, long), (6, long)]
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id string, text string")
    sf = written(tmp_path / "a", documents=samples.documents(spark, rows), labels=labels,
                 benchmark=benchmark)
    found = samples.rows(corpus_pipeline.run(spark, sf), "doc_id", "n_tokens")
    assert [i for i, _ in found] == [1, 3, 5, None]
    assert dict(found)[1] == 0 and dict(found)[5] > 10_000
    sf = written(tmp_path / "b", documents=samples.empty(spark), labels=labels, benchmark=benchmark)
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_stages_keep_the_columns(spark):
    docs = common.table(spark, SMALL, "documents").withColumn("score", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.dtypes == docs.dtypes, name


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_oracle(spark, key):
    db = compare.connect(SMALL)
    names, theirs = db_rows(db, queries.ORACLE[key])
    frame = queries.QUERIES[key](spark, SMALL)
    ours = compare.rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    assert names == sorted(frame.columns) and ours == theirs


def db_rows(db, sql):
    cursor = db.execute(sql)
    names = [c[0] for c in cursor.description]
    return sorted(names), compare.rows_of(names, cursor.fetchall())


def test_the_split_is_by_id():
    assert common.crc_of_id(12) == zlib.crc32(b"12")
