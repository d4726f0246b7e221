import pytest

from tests.oracle import oracle, result
from tidemark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert result(registry.QUERIES[name](spark, sf)) == oracle(sf, registry.ORACLE_SQL[name])
