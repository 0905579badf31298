import pytest
from oracle import compare

from lectern.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(spark, registry.QUERIES[name], registry.ORACLE[name], "/root/testdata/sf0.001") == ""
