import pytest
from compare import differences, type_differences

from tarnlake import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_its_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        assert type_differences(df, registry.ORACLES[name], SF) == []
        assert differences(df, registry.ORACLES[name], SF) == []
    else:
        assert df.count() > 0
