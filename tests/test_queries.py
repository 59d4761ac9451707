import pytest

from geoweft.plans import registry
from oracle import same


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_equals_sql(spark, name):
    assert same(spark, registry.QUERIES[name], registry.ORACLES[name]) > 0
