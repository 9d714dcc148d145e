"""Every registered query against its DuckDB oracle at the test scale factor
(row count, column names, order-insensitive values). The text operators,
whose package may be absent, have their own tests."""

import pytest
from conftest import SF

import __spark_entry__ as entry
from kolekta.plans.registry import QUERIES
from oracle_compare import compare, duck

KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_key_is_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.oracle_sql())


def test_entry_without_the_text_operators(monkeypatch):
    """The driver may take the text package and the pipeline away."""
    import importlib.util
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("kolekta.llm", "corpus")) else find(name, *a))
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 1 and "total_ar_m" in df.columns


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, SF, key, entry.queries()[key], entry.oracle_sql().get(key))
    assert r["status"] == "ok", r
    assert r["rows"] > 0, r
