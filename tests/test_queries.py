"""Every registered query against its SQL check on the smallest tables."""

import pytest

from check_oracle import compare, oracle
from gapline.suite import all_queries

QUERIES = all_queries()


@pytest.fixture(scope="module")
def database(small_dir):
    return oracle(small_dir)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_matches_sql(spark, database, small_dir, name):
    ok, note = compare(spark, database, QUERIES[name], small_dir)
    assert ok, note


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_an_optional_dependency(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as entry

    real = builtins.__import__

    def hidden(name, *args, **kwargs):
        if name.startswith("gapline.llm") or name == "corpus_pipeline":
            raise ImportError(name)
        return real(name, *args, **kwargs)

    for name in [m for m in sys.modules if m.startswith("gapline.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", hidden)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == {n for n, q in QUERIES.items() if q.sql}
