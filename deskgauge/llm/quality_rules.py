"""Quality rules as a bitmask ledger.

Every rule is evaluated once.  The ledger keeps the measurements of a document
and one bit per failed rule; versioned policies are masks over those bits, so a
new policy, or the effect of dropping a rule, needs no second look at a text.

Words are runs of anything but the ASCII space, tab, line feed, vertical tab,
form feed and carriage return.  A null or empty text has no words and fails the
first rule.  Texts are read whole; rows are independent, so repeated rows repeat.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from deskgauge.llm import common

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_top_word", "n_letters", "n_capitals")
SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))


@dataclass(frozen=True)
class Rule:
    """A named SQL condition over the measurements that is true of a failing text."""

    bit: int
    name: str
    fails: str


# Bits are never reused: a ledger stays readable under later rule sets.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "one_word", "100 * n_top_word > 30 * n_words"),
    Rule(5, "capitals", "100 * n_capitals > 50 * n_letters"),
    Rule(6, "short_words", "10 * word_chars < 20 * n_words"),
    Rule(7, "long_words", "word_chars > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of what to reject: a text goes if it fails any of these rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {rule.name: 1 << rule.bit for rule in RULES}
        return sum(bits[name] for name in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("2", tuple(rule.name for rule in RULES))


def _count(text: bytes, members: bytes) -> int:
    return len(text) - len(text.translate(None, members))


def measure_text(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, _count(text, SYMBOLS), 0, 0, 0, 0, 0, 0)
    points = len(text) - len(text.translate(None, bytes(range(0x80, 0xC0))))
    word_chars = len(text) - points - _count(text, _SPACES)
    lines = [line for line in text.split(b"\n") if line.strip()]
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeated = 0
    if n >= 4:
        window = _windows(at, len(ids))
        _, first, counts = np.unique(window, return_inverse=True, return_counts=True)
        twice = counts[first] >= 2
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift:n - 2 + shift] |= twice
        repeated = int(covered.sum())
    return (n, word_chars, _count(text, SYMBOLS), len(lines) - len(set(lines)), repeated,
            len(lines), int(np.bincount(at).max()),
            _count(text, _LETTERS), _count(text, _CAPITALS))


def _windows(at: np.ndarray, size: int) -> np.ndarray:
    """One number per 3-word window, equal for equal windows."""
    if size < 2_000_000:
        return (at[:-2] * size + at[1:-1]) * size + at[2:]
    _, pair = np.unique(at[:-1] * size + at[1:], return_inverse=True)
    return pair[:-1] * size + at[2:]


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measurements of every text."""
    schema = "doc_id bigint, " + ", ".join(f"{name} bigint" for name in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure_text(text) for text in common.utf8(batch.column(1))]
            columns = np.array(rows, np.int64).reshape(len(rows), len(MEASURES)).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in columns)], ["doc_id", *MEASURES])

    return common.documents(docs).mapInArrow(run, schema)


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failed``: a bit for every rule a text fails."""
    bits = [F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint")
            for rule in RULES]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measure(docs).withColumn("failed", failed)


def fails(policy: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) != 0


def verdicts(rows: DataFrame, policy: Policy) -> DataFrame:
    """Ledger rows with the policy's version and whether it keeps the text."""
    return rows.withColumns({"policy": F.lit(policy.version), "kept": ~fails(policy)})


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For every rule of a policy: texts that fail it, and texts it alone rejects.

    Rows of equal bits are counted first, on the map side too, so what is
    shuffled and joined with the rules has one row per pattern of failures.
    An empty ledger gives zero for every rule.
    """
    spark = rows.sparkSession
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).count()
    rules = [r for r in RULES if r.name in policy.rules]
    sums = []
    for rule in rules:
        bit = F.lit(1 << rule.bit)
        hit = F.col("bits").bitwiseAND(bit) != 0
        sums += [F.sum(F.when(hit, F.col("count"))).alias(f"f{rule.bit}"),
                 F.sum(F.when(F.col("bits") == bit, F.col("count"))).alias(f"o{rule.bit}")]
    totals = patterns.agg(F.sum("count").alias("n"), *sums)
    per_rule = F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"),
                 F.col(f"o{r.bit}").alias("n_only")) for r in rules])
    return totals.select(F.inline(per_rule)).select(
        F.lit(policy.version).alias("policy"), "rule",
        F.coalesce("n_failed", F.lit(0)).alias("n_failed"),
        F.coalesce("n_only", F.lit(0)).alias("n_only")) if rules else spark.createDataFrame(
            [], "policy string, rule string, n_failed bigint, n_only bigint")
