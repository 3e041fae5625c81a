"""Operators on one text at a time, against plain versions."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from deskgauge.llm import byte_bpe, decontamination, quality_rules
from llm import samples

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SPLIT = r"[^\x20\x09-\x0D]+"


# -------------------------------------------------------------------- quality rules

def plain_measures(text):
    text = text or ""
    words = re.findall(SPLIT, text)
    lines = [x for x in text.split("\n") if re.search(SPLIT, x)]
    windows = list(zip(words, words[1:], words[2:]))
    counts = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered), len(lines),
            max(collections.Counter(words).values(), default=0),
            len(re.findall("[A-Za-z]", text)) if words else 0,
            len(re.findall("[A-Z]", text)) if words else 0)


def test_measures(spark):
    docs = samples.documents(spark)
    found = samples.rows(quality_rules.measure(docs))
    wanted = sorted(((i, *plain_measures(t)) for i, t in samples.rows(docs, "doc_id", "text")),
                    key=repr)
    assert found == wanted
    assert quality_rules.ledger(samples.empty(spark)).count() == 0


@given(st.text(alphabet="ab c\n|A \x1c\u0085é", max_size=60))
@settings(max_examples=300, deadline=None)
def test_measures_of_any_text(text):
    assert quality_rules.measure_text(text.encode()) == plain_measures(text)


def test_policies_and_ablations(spark):
    ledger = spark.createDataFrame([(b,) for b in (0, 0, 1, 1, 2, 3, 4, 5, 8)], "failed bigint")
    policy = quality_rules.Policy("x", ("few_words", "repeated_windows", "symbols"))
    assert policy.mask == 7
    assert samples.rows(quality_rules.ablations(ledger, policy), "rule", "n_failed", "n_only") == [
        ("few_words", 4, 2), ("repeated_windows", 2, 1), ("symbols", 2, 1)]
    kept = quality_rules.verdicts(ledger, policy).filter("kept").count()
    assert kept == 3
    none = quality_rules.ablations(ledger.limit(0), quality_rules.BASE)
    assert samples.rows(none, "n_failed", "n_only") == [(0, 0), (0, 0)]


# ------------------------------------------------------------------------- byte BPE

@pytest.fixture(scope="module")
def reference():
    vocab = byte_bpe.load(PATH, public_tokenizers.PATTERN)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=vocab.ranks, special_tokens={})


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_encoding_and_decoding(spark, reference):
    docs = samples.documents(spark)
    wanted = []
    for doc_id, text in samples.rows(docs, "doc_id", "text"):
        ids = reference.encode_ordinary(text or "")
        raw = np.array(ids, "<u4").tobytes()
        wanted.append((doc_id, len(ids), digest(raw), digest((text or "").encode())))
    found = byte_bpe.digest_documents(docs, PATH, public_tokenizers.PATTERN)
    assert samples.rows(found) == sorted(wanted, key=repr)
    encoded = byte_bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN)
    back = byte_bpe.decode_ids(encoded, PATH, public_tokenizers.PATTERN)
    assert samples.rows(back) == sorted(
        ((i, t or "") for i, t in samples.rows(docs, "doc_id", "text")), key=repr)
    assert byte_bpe.digest_documents(
        samples.empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_odd_pieces(reference):
    vocab = byte_bpe.load(PATH, public_tokenizers.PATTERN)
    rnd = random.Random(3)
    odd = ["a" * 5000, "!" * 700, "é" * 300, "😀" * 50, "\x0b\x1c\x85 　x", "", "٣ⅷ²", "ab" * 200]
    odd += ["".join(rnd.choice("ab é\x1c\x85!?1²\n\t'sß漢​﻿") for _ in range(rnd.randint(1, 80)))
            for _ in range(500)]
    for text, raw in zip(odd, byte_bpe.Encoder(vocab, remembered=100).encode(odd)):
        assert np.frombuffer(raw, "<u4").tolist() == reference.encode_ordinary(text)
        assert byte_bpe.decode(raw, vocab) == text.encode()


def test_one_tree_and_many_agree():
    vocab = byte_bpe.load(PATH, public_tokenizers.PATTERN)
    rnd = random.Random(5)
    pieces = {bytes(rnd.choice(b"abthe on\xc3\xa9") for _ in range(rnd.randint(9, 16))) for _ in range(300)}
    pieces = [p for p in pieces if p not in vocab.ranks]
    rows = byte_bpe.merge_rows(pieces, 16, vocab)
    assert [np.frombuffer(r, "<u4").tolist() for r in rows] == [
        byte_bpe.merge_one(p, vocab) for p in pieces]


# ------------------------------------------------------------------ decontamination

def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_report(docs, items):
    out = []
    for doc_id, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for item, passage in items:
            grams = plain_words(passage)
            n = min(13, len(grams))
            windows = {tuple(grams[i:i + n]) for i in range(len(grams) - n + 1)} if n else set()
            for i in range(len(words) - n + 1 if n else 0):
                if tuple(words[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add("" if item is None else str(item))
        sha = digest(",".join(sorted(found)).encode())
        out.append((doc_id, len(words), len(hit), len(found), sha,
                    len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


def ascii_upper(text):
    return "".join(chr(ord(c) - 32) if "a" <= c <= "z" else c for c in text)


@pytest.fixture(scope="module")
def contaminated(spark):
    rnd = random.Random(9)
    items = [(i, samples.sentence(rnd, 20 + i)) for i in range(12)]
    items += [(3, samples.sentence(rnd, 15)), (None, samples.sentence(rnd, 14)), (20, "Only Three words"),
              (21, ""), (22, None), (23, "."), (2, items[2][1])]
    rows = [(i, samples.sentence(rnd, 200)) for i in range(6)]
    rows += [(10, items[0][1]), (11, samples.sentence(rnd, 30) + " " + ascii_upper(items[1][1]) + "!"),
             (12, samples.sentence(rnd, 2000) + " " + items[4][1]), (13, "so: ONLY-three  words."),
             (14, None), (15, ""), (16, "..."), (10, items[0][1]), (None, items[13][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return samples.documents(spark, rows), bench, rows, items


@pytest.mark.parametrize("limit", [10_000, 40])
def test_contamination_report(contaminated, limit):
    docs, bench, rows, items = contaminated
    assert samples.rows(decontamination.report(docs, bench, limit)) == plain_report(rows, items)


@pytest.mark.parametrize("limit", [10_000, 40])
def test_contaminated_documents_and_spans_go(contaminated, limit):
    docs, bench, rows, items = contaminated
    bad = [r[0] for r in plain_report(rows, items) if r[-1]]
    kept = decontamination.without_documents(docs, bench, limit)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    wanted = collections.Counter(i for i, _ in rows) - collections.Counter(bad)
    assert collections.Counter(r[0] for r in kept.select("doc_id").collect()) == wanted
    texts = dict(samples.rows(decontamination.without_spans(docs, bench, limit)))
    assert plain_words(texts[13]) == ["so"] and plain_words(texts[10]) == []
    assert len(plain_words(texts[11])) == 30 and texts[0] == rows[0][1]


def test_no_benchmark_and_no_documents(spark, contaminated):
    docs, bench, rows, _ = contaminated
    assert samples.rows(decontamination.report(docs, bench.limit(0))) == plain_report(rows, [])
    assert decontamination.report(samples.empty(spark), bench).count() == 0
    assert decontamination.without_documents(samples.empty(spark), bench).count() == 0


def test_ids_are_checked_alike():
    from deskgauge.llm import common
    assert [common.crc_of_id(i) for i in (0, 17, None)] == [
        zlib.crc32(b"0"), zlib.crc32(b"17"), zlib.crc32(b"")]
