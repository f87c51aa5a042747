from __future__ import annotations

import pytest

import __spark_entry__ as driver
import compare
from workload import queries as workload_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


NAMES = list(workload_queries.queries())


def test_every_query_has_its_sql():
    assert set(NAMES) <= set(driver.queries()) and set(NAMES) <= set(driver.oracle_sql())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    equal, note = compare.compare(spark, con, FOLDER, name)
    assert equal, note


def test_entry(spark):
    """The pairs stated with the test data."""
    got = {r.prompt_id: (r.chosen_idx, r.rejected_idx) for r in driver.entry(spark).collect()}
    assert got == {
        0: (190, 233), 1: (25, 26), 2: (109, 63), 3: (62, 134), 4: (21, 95),
        5: (44, 307), 6: (151, 174), 7: (9, 275), 8: (143, 384), 9: (78, 65),
    }
