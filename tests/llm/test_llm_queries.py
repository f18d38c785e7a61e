"""Queries with SQL against it, and that the others give their columns."""

import pytest
from conftest import compared

import __spark_entry__
from wordloom.llm.queries import ORACLE, QUERIES

COLUMNS = {
    "p1_found": "w", "p2_found": "corpus_id idx_a idx_b", "p3_found": "w mark", "p4_found": "idx_a idx_b", "p5_found": "corpus_id w_idx c_idx",
    "p7_found": "idx_a idx_b", "p8_packed": "spec_id container doc_id piece n_tokens", "p9_found": "item_id doc_id", "p10_found": "doc_id lang",
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    ours, theirs = compared(spark, sf_dir, QUERIES[name], ORACLE[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert set(df.columns) == set(COLUMNS[name].split())
    assert df.count() > 0


def test_entry_names_them():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql())
