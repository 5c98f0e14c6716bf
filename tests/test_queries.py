import pytest

from codexlake import registry
from conftest import DATA


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, same, name):
    same(registry.QUERIES[name](spark, DATA), registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
