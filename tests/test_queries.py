"""Every core query against its SQL on the smallest tables."""

import pytest
from conftest import compared

from wordloom.plans.queries import ORACLE, QUERIES

WITHOUT_SQL = {"train_im", "train_em"}


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    ours, theirs = compared(spark, sf_dir, QUERIES[name], ORACLE[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_training_loss_falls(spark, sf_dir, name):
    losses = [r.half_sq_loss for r in QUERIES[name](spark, sf_dir).orderBy("iteration").collect()]
    assert len(losses) == 2 and losses[1] < losses[0]
