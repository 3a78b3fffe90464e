import pytest

from credline.llm.queries import ORACLE, QUERIES
from tests.conftest import SF001, SF01
from tests.oracle_compare import compare, duck


@pytest.mark.parametrize("sf", [SF001, SF01])
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name, sf):
    r = compare(spark, duck(sf), name, QUERIES[name], ORACLE[name], sf)
    assert r["ok"], r


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
