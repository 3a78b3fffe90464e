"""Every registered query against its DuckDB oracle on the sf0.01 tables (the
correctness gate), plus the driver entry points."""

import importlib.util
import os

import pytest

from credline.plans.queries import ORACLE, QUERIES
from tests.conftest import SF001, SF01
from tests.oracle_compare import compare, duck

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF01)
    if ORACLE.get(name) is None:
        assert r["rows"] > 0
    else:
        assert r["ok"], r


def test_driver_entry(spark):
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.columns == ["row_id", "guid", "time_point", "scene_label", "cleaned_text"]
    assert df.count() > 0
    assert set(mod.oracle_sql()) <= set(mod.queries())
    assert SF001
