"""Registered queries: against their SQL, and on tables with nulls, repeats, clashing columns and no rows."""

import os

import pytest

import __spark_entry__ as entry
from gapline.llm import queries as registered
from tests.llm import tables
from tests.llm.run_query import compare

SQL = sorted(registered.SQL)
ALL = sorted([*registered.QUERIES, "pipeline"])


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    edge, empty = tmp_path_factory.mktemp("edge"), tmp_path_factory.mktemp("empty")
    return {"edge": tables.write(spark, edge), "empty": tables.write(spark, empty, True)}


@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(spark, small_dir, name):
    ok, note = compare(spark, name, small_dir)
    assert ok, note


@pytest.mark.parametrize("name", ALL)
def test_empty_tables(spark, folders, name):
    rows = entry.queries()[name](spark, folders["empty"]).collect()
    assert [r.conv_id for r in rows] == ([-7] if name.startswith("op8") else [])


@pytest.mark.parametrize("name", [n for n in ALL if n != "pipeline" and not n.startswith(("op8", "op11"))])
def test_every_document_has_its_row(spark, folders, name):
    """Repeated rows, null ids and null texts included."""
    rows = entry.queries()[name](spark, folders["edge"]).collect()
    key = lambda i: (i is None, i or 0)
    want = [d[0] for d in tables.documents()]
    assert sorted([r.doc_id for r in rows], key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", ["op12_merkle_manifest"])
def test_edge_tables_match_sql(spark, folders, name):
    """Nulls in every column, very long texts, repeated rows, equal ids with other texts (the SQL of op11 and op13 copies long texts)."""
    ok, note = compare(spark, name, folders["edge"])
    assert ok, note


def test_pipeline_on_edge_tables(spark, folders):
    rows = entry.queries()["pipeline"](spark, folders["edge"])
    assert all(c in rows.columns for c in ("doc_id", "text", "lang", "source", *tables.CLASHING))
    assert {r.doc_id for r in rows.collect()} <= {d[0] for d in tables.documents()}


def test_all_operators_are_registered():
    numbers = {int(n[2:].split("_")[0]) for n in registered.QUERIES}
    assert numbers == set(range(1, 14))
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "corpus_pipeline.py"))
