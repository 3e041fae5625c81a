"""Small document tables with every awkward case."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and theory onion strange quick lively über été ñandú river stone cloud".split()


def sentence(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) + rnd.choice(("", "", "ing", "ed", ",")) for _ in range(n))


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    rnd = random.Random(seed)
    out: list[str | None] = [sentence(rnd, rnd.randint(1, 120)) for _ in range(n)]
    base = sentence(rnd, 300)
    words = base.split()
    words[150] = "changed"
    out += [base, base, " ".join(words), None, "", " ", "\n\n", "x", "x y", "A b\x1cc",
            "Ä" * 50, "a " * 300, "line one\nline one\nline one\nother", sentence(rnd, 30_000)]
    return out


def documents(spark, rows=None):
    """Rows, some repeated, one without id; columns that operators also use."""
    if rows is None:
        rows = list(enumerate(texts()))
        rows += [rows[0], rows[3], (None, "no id here"), (None, None)]
    frame = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], DOCS)
    return frame.withColumns({
        "score": F.lit("a"), "fp": F.lit(1), "failed": F.lit(2), "held_out": F.lit(None).cast("int"),
        "row": F.lit(0), "host": F.lit("h"), "component_id": F.lit("c"), "range": F.lit(7),
    }).repartition(3)


def empty(spark):
    return documents(spark).limit(0)


def rows(frame, *names):
    names = names or frame.columns
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)
