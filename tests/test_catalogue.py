import pytest

from engram.plans import catalogue
from tests.compare import check


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_agrees_with_sql(spark, small, name):
    check(spark, small, catalogue.queries()[name], catalogue.oracle_sql().get(name))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:2] == ["qid", "key"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
