from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tests.helpers import reports
from tickloom.operators import heatmap as h
from tickloom.operators import slots as s
from tickloom.operators.aggregate import over_keys


@pytest.fixture(scope="module")
def wide(spark):
    rows = reports(spark, [("source", 12345, [[[1, 100], 100000]])])
    return s.interval_scope(rows).select("slot", "lo", "hi", "value")


def test_average_and_percentiles(wide):
    conf = h.Heatmap()
    assert h.auto_ymax(wide).collect()[0]["ymax"] == 102
    assert h.column_average(wide, conf).collect()[0]["average"] == pytest.approx(51, abs=0.01)
    for p, want in ((0, 0), (0.5, 51), (0.95, 96), (1, 102)):
        got = h.column_percentile(wide, conf, p).collect()
        assert len(got) == 1 and got[0]["percentile"] == pytest.approx(want, abs=0.01)
    with pytest.raises(ValueError):
        h.column_percentile(wide, conf, 1.5)


@pytest.mark.parametrize("ymin", [0, 7.5])
@pytest.mark.parametrize("nbuckets", [1, 10, 100])
def test_grid_keeps_the_count(spark, ymin, nbuckets):
    """All of a range inside the scale ends up in the cells, by overlap."""
    dist = spark.createDataFrame(
        [(1, 0.0, 9.0, 10.0), (1, 95.0, 104.0, 20.0), (1, 50.0, 50.0, 3.0), (1, 200.0, 300.0, 7.0), (2, 10.0, 10.9, 5.0)],
        "slot bigint, lo double, hi double, value double",
    )
    cells = h.grid(dist, h.Heatmap(ymin, 100, nbuckets)).collect()
    inside = lambda lo, hi, n: n * max(0, min(hi + 1, 100) - max(lo, ymin)) / (hi + 1 - lo)
    want = inside(0, 9, 10) + inside(95, 104, 20) + inside(50, 50, 3)
    assert sum(c["value"] for c in cells if c["slot"] == 1) == pytest.approx(want)
    assert sum(c["value"] for c in cells if c["slot"] == 2) == pytest.approx(inside(10, 10.9, 5))
    assert all(0 <= c["bucket"] < nbuckets for c in cells)


REPORTED = {
    910: {"east": [[[20, 29], 40], [[60, 64], 2]]},
    912: {"east": [[[0, 4], 6], [[10, 14], 8]], "west": [[[10, 19], 50], [[15, 24], 30]]},
}


def both(spark):
    rows = reports(spark, [("source", t, value) for t, value in REPORTED.items()])
    return s.interval_scope(rows).select("slot", "key", "lo", "hi", "value")


def share(slot, low, high):
    """What each key has between low and high, spread evenly over its ranges."""
    out = {}
    for key, dist in REPORTED.get(slot, {}).items():
        n = sum(v * max(0, min(hi + 1, high) - max(lo, low)) / (hi + 1 - lo) for (lo, hi), v in dist)
        if n:
            out[key] = max(1, int(n + 0.5))
    return out


@pytest.mark.parametrize("row", range(10))
@pytest.mark.parametrize("column", [0, 1, 2])
def test_cell_details(spark, row, column):
    """Three columns of a second and ten buckets of ten, each drawn 20 by 20 pixels."""
    conf = h.Heatmap(0, 100, 10, width=60, height=200)
    click = spark.createDataFrame([(1, 20 * column + 7, 199 - 20 * row - 3)], "cell_id int, x int, y int")
    at = h.cell_at(F.col("x"), F.col("y"), F.lit(910), 3, conf, 1)
    cells = click.select("cell_id", *(c.alias(n) for n, c in at.items()))
    cell = cells.collect()[0]
    assert (cell["bucket_time"], cell["bucket_ymin"], cell["bucket_ymax"]) == (910 + column, 10 * row, 10 * row + 10)
    present = share(910 + column, 10 * row, 10 * row + 10)
    details = h.cell_details(both(spark), cells)
    assert {r["key"]: r["value"] for r in details.collect()} == present
    assert h.detail_totals(details, cells).collect()[0]["total"] == sum(present.values())
    unkeyed = h.cell_details(over_keys(both(spark)), cells)
    assert h.detail_totals(unkeyed, cells).collect()[0]["total"] == sum(present.values())


def test_small_shares_show(spark):
    """A share that rounds to nothing still counts 1."""
    dist = spark.createDataFrame([(5, 0.0, 99.0, 2.0)], "slot bigint, lo double, hi double, value double")
    cells = spark.createDataFrame([(1, 5, 10.0, 11.0), (2, 6, 10.0, 11.0)], "cell_id int, bucket_time bigint, bucket_ymin double, bucket_ymax double")
    details = h.cell_details(dist, cells)
    totals = {r["cell_id"]: r["total"] for r in h.detail_totals(details, cells).collect()}
    assert totals == {1: 1, 2: 0}


@pytest.mark.parametrize(
    "settings",
    [{"isolate": True, "exclude": True}, {"isolate": True, "decompose_all": True}, {"ymin": 5, "ymax": 5}, {"width": 9},
     {"height": 1001}, {"nbuckets": 0}, {"nbuckets": 101}, {"ymin": -1}, {"ymax": 1e13}, {"hues": [360]}, {"hues": []},
     {"hues": [1], "selected": ["a"]}, {"weights": "weights"}, {"coloring": "x"}],
)
def test_limits(settings):
    with pytest.raises(ValueError):
        h.Heatmap(**settings)


@pytest.mark.parametrize(("x", "y", "ymax"), [(150, 0, 100), (0, 180, 100), (0, 0, None)])
def test_pixel_limits(x, y, ymax):
    with pytest.raises(ValueError):
        h.check_pixel(x, y, h.Heatmap(0, ymax, 10, width=150, height=180))


def test_hues(spark):
    assert [len(h.hues(*x)) for x in ((5, True), (5, False), (0, False), (0, True))] == [5, 6, 1, 0]
    assert h.hues(4) == [21, 112, 203, 294, 25] and h.hues(2, True) == [112, 203]
    names = spark.createDataFrame([(n,) for n in ("zoe", "ann", "annabel", "annabella", "Bob", "Ann", "ann")], "series string")
    got = {r["series"]: r["hue"] for r in h.series_hues(names, h.Heatmap(0, 1, decompose_all=True)).collect()}
    ranked = sorted({"zoe", "ann", "annabel", "annabella", "Bob", "Ann"})
    assert got == {n: (21 + 91 * (i + 1)) % 360 for i, n in enumerate(ranked)}


def test_series_add_up(spark):
    """Background plus selected series are the total; each mode keeps its part."""
    dist = both(spark)
    value = lambda df: {(r["series"]): r["n"] for r in df.groupBy("series").agg(F.sum("value").alias("n")).collect()}
    east, west = (sum(n for v in REPORTED.values() for _, n in v.get(k, [])) for k in ("east", "west"))
    pick = {"selected": ("west",), "ymax": 100}
    assert value(h.select_series(dist, h.Heatmap(**pick))) == {"west": west, h.TOTAL: east}
    assert value(h.select_series(dist, h.Heatmap(**pick, isolate=True))) == {"west": west}
    assert value(h.select_series(dist, h.Heatmap(**pick, exclude=True))) == {h.TOTAL: east}
    assert value(h.select_series(dist, h.Heatmap(ymax=100, decompose_all=True))) == {"west": west, "east": east}
    assert value(h.total_and_selected(dist, ["west"])) == {"west": west, h.TOTAL: east + west}


def test_normalize(spark):
    cells = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 2.0, 40.0, 1000.0])], "bucket int, value double")
    rank = [r["saturation"] for r in h.normalize_rank(cells).orderBy("bucket").collect()]
    assert rank == pytest.approx([0.225, 0.45, 0.45, 0.675, 0.9])
    linear = [r["saturation"] for r in h.normalize_linear(cells).orderBy("bucket").collect()]
    assert linear == pytest.approx([0.0009, 0.0018, 0.0018, 0.036, 0.9])


def test_ranks_are_exact(spark):
    """Neighbouring doubles, tiny and huge values each have their rank; names with a long common start too."""
    import random

    rng = random.Random(2)
    values = [1.0, math.nextafter(1.0, 2), 5e-324, 1e300, 3.0, 3.0] + [rng.choice([rng.random(), rng.randint(1, 30)]) * 1.0 for _ in range(500)]
    cells = spark.createDataFrame([(i, v) for i, v in enumerate([*values, 0.0])], "bucket int, value double").repartition(7)
    order = {v: n for n, v in enumerate(sorted(set(values)), 1)}
    for r in h.normalize_rank(cells).collect():
        assert r["saturation"] == pytest.approx(0.9 * order.get(r["value"], 0) / len(order), rel=1e-12)
    assert h.normalize_rank(cells.filter("value = 0")).collect()[0]["saturation"] == 0
    names = [f"a common start {n}" for n in range(300)] + ["a", "z", ""]
    series = spark.createDataFrame([(n,) for n in names * 2], "series string")
    hues = {r["series"]: r["hue"] for r in h.series_hues(series, h.Heatmap(0, 1, 1, decompose_all=True)).collect()}
    assert hues == {n: (21 + 91 * k) % 360 for k, n in enumerate(sorted(names), 1)}


def test_image(spark):
    cells = h.image(both(spark), h.Heatmap(0, 100, 10, selected=("west",)))
    got = {(r["series"], r["hue"]) for r in cells.collect()}
    assert got == {("west", 112), (h.TOTAL, 21)}
    empty = h.image(both(spark), h.Heatmap(0, 100, 10, isolate=True))
    assert empty.count() == 0
