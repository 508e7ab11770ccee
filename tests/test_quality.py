"""V7 gate: blocking checks raise only when a check has violations."""

import datetime as dt

import pytest

from roadstats.operators import quality as qa
from roadstats.sources import standins as sp
from tests.conftest import SF_SMALL

COLS = ("st_case long, year int, state string, crash_date date, total_fatalities int, "
        "motorist_fatalities int, pedestrian_fatalities int, cyclist_fatalities int, "
        "other_fatalities int")


def test_gate_passes_clean_table(spark):
    rows = [(1, 2020, "06", dt.date(2020, 1, 2), 2, 1, 1, 0, 0),
            (2, 2020, "06", None, 0, 0, 0, 0, None)]       # null subtype: not flagged (V5)
    checks = qa.blocking_checks(spark.createDataFrame(rows, COLS))
    out = qa.enforce(checks)
    assert all(r["passed"] for r in out.collect())


@pytest.mark.parametrize("row, check", [
    ((1, 2020, "06", dt.date(1980, 1, 1), 1, 1, 0, 0, 0), "date_out_of_range"),
    ((1, 2020, None, None, 1, 1, 0, 0, 0), "missing_required_fields"),
    ((1, 2020, "06", None, -1, -1, 0, 0, 0), "negative_fatalities"),
    ((1, 2020, "06", None, 3, 1, 1, 0, 0), "fatality_sum_mismatch"),
    ((1, 2020, "06", None, 31, 31, 0, 0, 0), "implausible_fatalities"),
])
def test_gate_raises(spark, row, check):
    checks = qa.blocking_checks(spark.createDataFrame([row], COLS))
    bad = {r["check"] for r in checks.collect() if not r["passed"]}
    assert bad == {check}
    with pytest.raises(qa.BlockingCheckFailed):
        qa.enforce(checks)


def test_gate_duplicate_keys(spark):
    rows = [(1, 2020, "06", None, 1, 1, 0, 0, 0)] * 2
    with pytest.raises(qa.BlockingCheckFailed):
        qa.enforce(qa.blocking_checks(spark.createDataFrame(rows, COLS)))


def test_stand_in_crash_table_fails_the_gate(spark):
    # unrecognised person code 88 counts in the total but in no subtype (V5)
    checks = qa.blocking_checks(sp.loaded_crashes(spark, SF_SMALL))
    with pytest.raises(qa.BlockingCheckFailed):
        qa.enforce(checks)
