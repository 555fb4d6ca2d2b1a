"""Every mining query that has SQL agrees with it."""

import pytest

from millrace.plans import registry
from tests.oracle import assert_same

# dense at the smallest scale: nearly all customers share parts
HEAVY = {"edge_betweenness", "components", "lsh_jaccard", "user_pearson", "user_cf_predict"}


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - HEAVY))
def test_agrees_with_sql(spark, data_dir, name):
    assert_same(spark, data_dir, registry.queries()[name], registry.oracle_sql()[name])


def test_every_statement_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
