"""Every registered query against its SQL, on the smallest tables (bench-size runs use compare.py)."""

import pytest

import __spark_entry__ as entry
from captionloom.plans import tokens
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
#: Queries that learn a vocabulary: here a smaller one, in the query and in its SQL; compare.py runs them as registered.
LEARNING = {"bpe_train", "bpe_encode", "bpe_decode", "vocab_usage", "token_report", "vocab_files", "stream_ingest"}
SMALLER = 250


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, monkeypatch, name):
    sql = SQL.get(name)
    if name in LEARNING:
        size = f"t.step < {tokens.VOCAB_SIZE} - 5"
        assert size in sql
        sql = sql.replace(size, f"t.step < {SMALLER} - 5")
        monkeypatch.setattr(tokens, "VOCAB_SIZE", SMALLER)
    message, _, ok = compare(spark, duck, name, QUERIES[name], sql, SF_DIR)
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).columns == ["reason", "n"]
