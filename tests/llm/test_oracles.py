import pytest

from tests.oracle import connect, differences
from tokentide.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, small, con, name):
    assert differences(spark, con, name, QUERIES[name], ORACLES[name], small) is None
