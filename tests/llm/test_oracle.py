import pytest

from tests.oracle_check import compare, connect
from vitrine.llm import oracle


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_sql(spark, name, folder):
    at = f"/root/testdata/{folder}"
    assert compare(spark, connect(at), at, name) is None
