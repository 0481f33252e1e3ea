import pytest

from barloom.llm import queries
from tests import duck


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_twin(spark, sf_dir, name):
    assert duck.differing(spark, sf_dir, duck.connect(sf_dir), queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
