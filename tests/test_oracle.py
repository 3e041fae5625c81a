"""Every query against its oracle SQL, and the driver contract."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_point
from checks import compare
from checks.queries import ORACLE, QUERIES
from conftest import SMALL

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def db():
    return compare.connect(SMALL)


@pytest.mark.parametrize("key", QUERIES)
def test_query(spark, db, key):
    assert compare.difference(spark, db, key, SMALL) is None


def test_contract(spark):
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(ORACLE) == set(QUERIES)
    assert entry_point.entry(spark).columns == ["tech_name", "total_tickets", "score"]


@pytest.mark.parametrize("lacking", ["xxhash", "zstandard", "public_tokenizers", "corpus_pipeline"])
def test_the_entry_lives_without_what_the_operators_need(lacking):
    code = (f"import sys; sys.modules[{lacking!r}] = None; import __spark_entry__ as e; "
            "names = e.queries(); assert len(names) > 150 and set(e.oracle_sql()) <= set(names); "
            "assert not any(n.startswith('op') or n == 'pipeline' for n in names)")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
