"""A sample of registered queries against SQL on DuckDB; `python -m checks.compare` runs all."""

import pytest

import __spark_entry__ as driver
from checks.compare import compare, duck
from checks.oracle import half_up

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["gold_health", "gold_cost", "mtbf_by_asset", "consecutive_over", "search_manuals", "pm_combine",
          "sink_insert_disruption", "stream_rolling5", "asset_dossier"]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("key", SAMPLE)
def test_query_equals_sql(spark, con, key):
    assert compare(driver.queries()[key](spark, FOLDER), con, driver.oracle_sql()[key]) is None


def test_every_query_has_sql():
    own = {key for key in driver.CORE_QUERIES}
    assert own == set(driver.oracle_sql()) & own


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_half_up_breaks_ties_upward(con):
    assert con.execute(half_up("SELECT round(1.005e0, 2), round(round(2.5e0, 0), 0)")).fetchall() == [(1.01, 3.0)]
