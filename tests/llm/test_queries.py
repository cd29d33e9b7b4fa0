import pytest

from engram.llm import oracles, queries
from tests.compare import check

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, small, name):
    got = check(spark, small, queries.queries()[name], SQL.get(name))
    if name.endswith("_found"):
        assert not got.duplicated().any()


def test_columns(spark, small):
    q = queries.queries()
    want = {"p1": "field term mark", "p2": "field rec_id kind mention", "p3": "entity_a entity_b", "p4": "key_a key_b", "p5": "hash_a hash_b", "p7": "doc_id item_id", "p8": "doc_id kind"}
    for p, columns in want.items():
        assert q[f"{p}_found"](spark, small).columns == columns.split()
