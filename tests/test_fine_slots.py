"""The queries of fine slots read all events."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from workload import QUERIES

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", ["t11_expected", "t12_complete"])
def test_every_report_counts(spark, name):
    counts = QUERIES[name](spark, SF_DIR)
    slots = QUERIES["t08_reporting"](spark, SF_DIR)
    hours = counts.filter("reporting > 0").select("inst_id", (F.col("slot") - F.col("slot") % 3600).alias("slot")).distinct()
    assert hours.count() == slots.count()
    assert counts.filter("reporting = 0").count() > 0


def test_zero_fill_holds_all_values(spark):
    total = lambda name: QUERIES[name](spark, SF_DIR).agg(F.sum("value")).first()[0]
    assert total("t07_zero_fill") == pytest.approx(total("t04_interval_scope"))


def test_window_of_several_slots(spark):
    """Every slot of five seconds is in the sums, and some expect more than what the slot before had."""
    rows = QUERIES["t11_expected_window"](spark, SF_DIR).collect()
    low, high = min(r.first_slot for r in rows), max(r.last_slot for r in rows)
    assert sum(r.slots for r in rows) == (high - low) // 5 + 1
    reported = sum(r.slots for r in rows if r.reporting)
    assert reported and sum(r.slots for r in rows if r.expected) > 1.5 * reported


def test_window_gives_every_slot(spark):
    """The slot 10 s after a report expects it, and so does the one after 15 s; no slot is summed up with others."""
    rows = QUERIES["t11_expected_window"](spark, SF_DIR).collect()
    by_slot = {r.slot: r for r in rows}
    assert sorted(by_slot) == list(range(min(by_slot), max(by_slot) + 1, 5)) and len(rows) == len(by_slot)
    told = [k for k, r in by_slot.items() if r.reporting and k + 15 in by_slot]
    assert told and all(by_slot[k + d].expected >= by_slot[k].reporting for k in told for d in (10, 15))
