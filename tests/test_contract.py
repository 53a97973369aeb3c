"""Every registered query against its SQL check on the smallest data."""

import os

import check
import pytest

import __spark_entry__ as contract
from casemill.plans import QUERIES, SURVEY_IDS

SF_DIR = "/root/testdata/sf0.001"
NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_check(spark, duck, name):
    status, count, note = check.compare(spark, duck, name, SF_DIR)
    assert status in ("ok", "rows only"), note
    assert "types" not in note
    assert count > 0


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["fiscal_year", "state_name"]


def test_checks_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert all(SURVEY_IDS[name] for name in NAMES)
