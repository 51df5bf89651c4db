"""Every registered question against its SQL twin."""

import pytest
from compare_sql import compare, driver

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_question(spark, name):
    assert compare(spark, FOLDER, name).startswith(("ok", "rows only"))


def test_entry(spark):
    df = driver.entry(spark)
    assert set(df.columns) == {"variant", "split", "nll_per_event", "session_macro_nll", "evaluated_events"}
    assert df.count() == 8


def test_twins_belong_to_questions():
    assert set(driver.oracle_sql()) <= set(driver.queries())
