from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.helpers import flat, nested, reports
from tickloom.operators import slots as s
from tickloom.plans.spec import Instrumentation, SpecError, value_arity
from tickloom.sources import snapshots as snap


def drawn(seed, kind, n=60, sources=4, span=40, start=5_003):
    """Updates of one value shape, at random times by random sources."""
    rand = random.Random(seed)
    number = lambda: rand.randint(0, 99)
    ranges = [(lo, lo + 8) for lo in range(0, 64, 8)]
    make = {
        "scalar": number,
        "keyed": lambda: {k: number() for k in rand.sample(["ka", "kb", "kc", "kd"], rand.randint(0, 3))},
        "ranged": lambda: [(r, number()) for r in sorted(rand.sample(ranges, rand.randint(0, 4)))],
        "both": lambda: {k: [(r, number()) for r in sorted(rand.sample(ranges, 2))] for k in rand.sample(["ka", "kb"], 1)},
    }[kind]
    times = sorted(rand.randint(start, start + span) for _ in range(n))
    return [(f"s{rand.randint(1, sources)}", t, make()) for t in times]


def cells(updates):
    """Counter of (key, lo, hi) over the given updates."""
    total = Counter()
    for _, _, value in updates:
        for key, lo, hi, n in flat(value):
            if n is not None:
                total[key, lo, hi] += n
    return {k: n for k, n in total.items() if n}


def held(df):
    out = {}
    for r in (row.asDict() for row in df.collect()):
        if r["value"]:
            out[r.get("key"), r.get("lo"), r.get("hi")] = r["value"]
    return out


@pytest.mark.parametrize("kind", ["scalar", "keyed", "ranged", "both"])
@pytest.mark.parametrize("g", [1, 7])
def test_slots_sum_all_reports(spark, kind, g):
    updates = drawn(len(kind) * g, kind)
    rows = reports(spark, updates, g)
    slots = s.interval_scope(rows)
    low = 5_003 - 5_003 % g
    for start, width in ((low, g), (low, 3 * g), (low + 2 * g, 5 * g), (low + 900 * g, g)):
        inside = [u for u in updates if start <= u[1] < start + width]
        assert held(s.rollup(slots, start, width)) == cells(inside)
    counts = {r["slot"]: r["reporting"] for r in s.reporting(rows).collect()}
    own = defaultdict(set)
    for source, t, _ in updates:
        own[t - t % g].add(source)
    assert counts == {slot: len(sources) for slot, sources in own.items()}


@pytest.mark.parametrize("kind", ["scalar", "keyed", "both"])
def test_first_reports_count(spark, kind):
    """Gauges: all rows of a source's first report in a slot, none of the later ones."""
    updates = drawn(31, kind)
    slots = s.point_scope(reports(spark, updates, 10))
    first = {}
    for u in updates:
        first.setdefault((u[0], u[1] - u[1] % 10), u)
    for slot in {slot for _, slot in first}:
        mine = [u for (_, at), u in first.items() if at == slot]
        assert held(slots.filter(F.col("slot") == slot)) == cells(mine)
        assert held(s.rollup(slots, slot, 30, "point")) == cells(mine)


@pytest.mark.parametrize("seed", range(6))
def test_normalize(spark, seed):
    """Down to the slot it starts in, and as many whole slots as the length needs."""
    rand = random.Random(seed)
    start, duration, g = rand.randint(0, 9_999), rand.randint(1, 300), rand.choice([1, 7, 60])
    lo, width = s.normalize(F.lit(start), F.lit(duration), g)
    assert tuple(spark.range(1).select(lo, width).collect()[0]) == (start - start % g, -(-duration // g) * g)


@pytest.mark.parametrize("seed", range(3))
def test_reporting_ranges(spark, seed):
    g, rows = 5, drawn(seed, "scalar", n=25, sources=6, span=90)
    own = defaultdict(set)
    for source, t, _ in rows:
        own[t - t % g].add(source)
    counts = s.reporting(reports(spark, rows, g))
    now = max(own)
    for kept, table in ((own, counts), ({k: v for k, v in own.items() if k >= now - 30}, s.retain(counts, now, 30))):
        for width in (5, 20):
            got = {r["period"]: (r["min_reporting"], r["max_reporting"]) for r in s.reporting_range(table, width, g).collect()}
            want = {}
            for period in {k - k % width for k in kept}:
                sizes = [len(kept.get(period + d, ())) for d in range(0, width, g)]
                want[period] = (min(sizes), max(sizes))
            assert got == want


def test_expected_over_chunks(spark):
    """The settled window is the same wherever the series is cut."""
    n = 60
    rows = [(t, 1 + (t * 7) % 11) for t in range(1000, 1000 + n) if t % 4]
    counts = spark.createDataFrame(rows, "slot bigint, reporting bigint")
    held = dict(rows)
    for chunk in (1, 16, 20, 4096):
        for g in (1,):
            got = {r["slot"]: (r["reporting"], r["expected"]) for r in s.expected(counts, g, chunk).collect()}
            slots = range(min(held), max(held) + 1)  # silent ones included
            want = {t: (held.get(t, 0), max([held.get(u, 0) for u in range(t - 15, t - 5)])) for t in slots}
            assert got == want


def test_guards(spark):
    rows = reports(spark, [("a", t, 1) for t in (100, 110, 111, 115)])
    assert sorted(r["t"] for r in s.not_from_future(rows, 100).collect()) == [100, 110]
    assert sorted(r["t"] for r in s.on_sampling_grid(rows, 60).collect()) == [100, 110, 115]
    assert s.retain(rows, 120, 0).count() == 4


def test_spec_limits():
    arities = {"d1": "discrete", "d2": "discrete", "n1": "numeric", "n2": "numeric"}
    good = Instrumentation("m", "s", decomposition=("n1", "d1"), granularity=10, retention=600)
    good.validate(arities)
    assert value_arity(good, arities) == ("numeric-decomposition", 3)
    assert value_arity(Instrumentation("m", "s"), arities) == ("scalar", 1)
    assert value_arity(Instrumentation("m", "s", decomposition=("d1",)), arities) == ("discrete-decomposition", 2)
    for bad in (
        {"granularity": 0}, {"granularity": 3}, {"granularity": -5}, {"retention": 3601}, {"retention": -1},
        {"decomposition": ("d1", "d2")}, {"decomposition": ("n1", "n2")}, {"decomposition": ("junk",)},
    ):
        with pytest.raises(SpecError):
            Instrumentation("m", "s", **bad).validate(arities)


def test_snapshot_round_trip(spark, tmp_path):
    rows = reports(spark, [("a", 12340, {"x": 5}), ("b", 12345, {"x": 7, "y": 1})]).withColumn("inst_id", F.lit("007"))
    slots = s.interval_scope(rows)
    saved = snap.capture(rows, slots, 1)
    snap.save(saved, str(tmp_path / "s"))
    back = snap.load(spark, str(tmp_path / "s"), 1)
    assert sorted(map(tuple, back.slots.select(*slots.columns).collect())) == sorted(map(tuple, slots.collect()))
    assert back.meta.collect()[0]["inst_id"] == "007"
    twice = snap.merged(back, saved)
    assert nested(s.rollup(twice.slots, 12340, 10)) == {"x": 24, "y": 2}
    assert twice.reporting.count() == 2
    with pytest.raises(snap.SnapshotError):
        snap.load(spark, str(tmp_path / "s"), 5)
    for column, fails in (("vers_major", True), ("vers_minor", False)):
        other = snap.Snapshot(saved.slots, saved.reporting, saved.meta.withColumn(column, F.col(column) + 1))
        path = str(tmp_path / column)
        snap.save(other, path)
        if fails:
            with pytest.raises(snap.SnapshotError):
                snap.load(spark, path, 1)
        else:
            assert snap.load(spark, path, 1).meta.count() == 1
