"""Every core query against its SQL on the smallest tables."""

import pytest
from oracle import compare

from lectern.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(spark, registry.QUERIES[name], registry.ORACLE[name], DIR) == ""


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE.keys()))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, DIR).limit(1).count() == 1
