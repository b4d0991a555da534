import pytest

from pagelake.plans import catalog
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)[:3] == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "book_id", "rank", "page", "score", "mode", "snippet"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
