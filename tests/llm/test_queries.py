import pytest

from corpuslens.llm.queries import QUERIES, SQL
from tests.test_entry import DATA, HAS, against_sql


@HAS
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    against_sql(spark, name, QUERIES[name], SQL[name], DATA)


@HAS
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0
