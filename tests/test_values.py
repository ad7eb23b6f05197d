from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.helpers import flat, nested, reports
from tickloom.operators import aggregate as a
from tickloom.operators import series as l
from tickloom.operators import slots as s
from tickloom.operators import transforms as u
from tickloom.operators import values as v

REQUEST = "request_id bigint, inst_id string, start_time bigint, duration bigint, end_time bigint, ndatapoints bigint"
NOW = 1_700_000_003


def by_rule(start, duration, end, default, g):
    """Two of the three times fix the third; without both ends the newest full interval is meant."""
    if duration is not None and duration < 1:
        return "positive"
    if start is None and end is None:
        length = default if duration is None else duration
        return NOW - length - g, length
    if start is None:
        length = default if duration is None else duration
        return "exceed" if length > end else (end - length, length)
    if end is None:
        return start, default if duration is None else duration
    if duration is None:
        return (start, end - start) if end > start else "later"
    return (start, duration) if start + duration == end else "equal"


def test_intervals(spark):
    times = [None, 8, 500, 530]
    cases = list(itertools.product(times, [None, 0, 8, 22, 30], times, [(1, 1), (60, 10)]))
    for default, g in {c[3] for c in cases}:
        mine = [c for c in cases if c[3] == (default, g)]
        req = spark.createDataFrame([(i, "i", a_, d, e, None) for i, (a_, d, e, _) in enumerate(mine)], REQUEST)
        for row in v.infer_interval(req, NOW, default, g).collect():
            start, duration, end, _ = mine[row["request_id"]]
            want = by_rule(start, duration, end, default, g)
            if isinstance(want, str):
                assert row["error"] is not None and row["start_time"] is None, mine[row["request_id"]]
            else:
                assert row["error"] is None and (row["start_time"], row["duration"]) == want


def asked(spark, *requests, g=1):
    req = spark.createDataFrame([(i, "i", *r) for i, r in enumerate(requests)], REQUEST)
    return v.data_points(v.infer_interval(req, NOW, 1, g), g)


def test_data_points_check_a_request_once(spark):
    """No condition is pushed below the layout of the points, where all checks would be written out in it again and again."""
    rows = [(i, i % 3 and i, i % 4 and 1 + i % 9, i % 5 and 40 + i, i % 3) for i in range(1, 60)]
    rows = [tuple(x or None for x in r[:4]) + (r[4] or None,) for r in rows]
    asked = spark.createDataFrame(rows, "request_id long, start_time long, duration long, end_time long, ndatapoints long")
    points = v.data_points(v.checked(asked.withColumn("inst_id", F.lit("a")), NOW, 1, 5), 5)
    joined = v.intervals(points).join(points, list(v.INTERVAL))
    assert joined.count() == points.count() > 0 == points.filter("start is null or width is null").count()
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "CASE" in line for line in plan.splitlines())


def test_unaligned_data_points(spark):
    rows = reports(spark, [("a", 12340, 5), ("a", 12350, 7)], g=10)
    points = asked(spark, (12331, 10, None, 3), (12351, 8, None, None), g=10)
    out = v.answer(points, s.interval_scope(rows), s.reporting(rows), 10).orderBy("request_id", "point").collect()
    three, one = out[:3], out[3]
    assert [r["start_time"] for r in three] == [12330, 12340, 12350]
    assert [r["requested_start_time"] for r in three] == [12331, 12341, 12351]
    assert [r["minreporting"] for r in three] == [0, 1, 1]
    assert [r["value"] for r in three] == [None, 5, 7]
    assert (one["start_time"], one["end_time"], one["requested_end_time"]) == (12350, 12360, 12359)


def random_value(rnd, keyed, ranged):
    dist = lambda: [[[k, k + 9], rnd.randrange(1, 9)] for k in sorted(rnd.sample(range(0, 50, 10), 2))]
    one = dist if ranged else lambda: rnd.randrange(1, 9)
    return {k: one() for k in rnd.sample(["ore", "tin", "zinc"], 2)} if keyed else one()


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("ranged", [False, True])
def test_raw_values(spark, keyed, ranged):
    """The sum of what was reported inside each interval."""
    rnd = random.Random(10 * keyed + ranged)
    told = [(t, random_value(rnd, keyed, ranged)) for t in rnd.sample(range(800, 830), 12)]
    slots = s.interval_scope(reports(spark, [("source", t, value) for t, value in told]))
    asked_for = [(start, d) for start in (795, 800, 811, 840) for d in (1, 4, 40)]
    points = asked(spark, *((start, d, None, None) for start, d in asked_for))
    found = {}
    for r in v.values(points, slots, 1).collect():
        place = (r.asDict().get("key"), r.asDict().get("lo"), r.asDict().get("hi"))
        found.setdefault(r["request_id"], {})[place] = r["value"]
    for i, (start, d) in enumerate(asked_for):
        want = Counter()
        for t, value in told:
            if start <= t < start + d:
                want.update({row[:3]: row[3] for row in flat(value)})
        assert found.get(i, {}) == want


def test_request_limits(spark):
    rows = [(1, 1, None, None), (1, 3600, None, 1), (1, 0, None, None), (1, 3601, None, None), (1, 1, None, 0), (-1, 1, None, None),
            (NOW - 10, 10, None, None), (NOW + 1, 10, None, None)]
    req = spark.createDataFrame([(i, "i", *r) for i, r in enumerate(rows)], REQUEST)
    errors = [r["error"] for r in v.limit_errors(req, NOW).orderBy("request_id").collect()]
    assert [e is None for e in errors] == [True, True, False, False, False, False, True, False]


def keyed_slots(spark, values):
    rows = [("i", t, *r) for t, value in values.items() for r in flat(value)]
    return spark.createDataFrame(rows, "inst_id string, slot bigint, key string, lo double, hi double, value double").drop("lo", "hi", "inst_id")


def test_series(spark):
    slots = keyed_slots(spark, {100: {"a": 5, "b": 1}, 102: {"a": 1, "c": 9}, 103: {"d": 1}})
    got = {(r["key"], r["slot"]): r["value"] for r in l.with_gaps(slots, (100, 104), 1).collect()}
    assert got[("a", 100)] == 5 and got[("a", 101)] is None and got[("a", 103)] == 0 and got[("c", 100)] == 0
    assert len(got) == 16
    assert [r["key"] for r in l.ranked_keys(slots).collect()] == ["c", "a", "b", "d"]
    assert [r["key"] for r in l.top_keys(slots, 3).collect()] == ["c", "a", "b"]
    top = {(r["slot"], r["key"]): r["value"] for r in l.top_and_others(slots, 2).collect()}
    assert top == {(100, "a"): 5, (100, "<other>"): 1, (102, "a"): 1, (102, "c"): 9, (103, "<other>"): 1}
    assert l.top_and_others(slots, 9).filter("key = '<other>'").count() == 0


def test_zero_fill(spark):
    values = spark.createDataFrame([(100, 4.0), (103, 5.0)], "slot bigint, value double")
    spans = spark.createDataFrame([(99, 105)], "start bigint, end bigint")
    got = {r["slot"]: r["value"] for r in s.zero_fill(values, spans, 1).collect()}
    assert got == {99: 0, 100: 4, 101: 0, 102: 0, 103: 5, 104: 0}


def test_transformations(spark):
    nets = spark.createDataFrame(
        [(0x08080000, 0x0808FFFF, "US"), (0x0A000000, 0x0AFFFFFF, "private"), (0x51000000, 0x5102FFFF, "DE")],
        "start_ip bigint, end_ip bigint, country string",
    )
    names = spark.createDataFrame([("8.8.8.8", ["dns"]), ("81.1.2.3", None)], "ip string, names array<string>")
    r = u.Registry()
    r.register("geolocate", "place", ["raddr"], u.geolocate(nets))
    r.register("names", "names", ["raddr"], u.reverse_names(names))
    r.register("broken", "fails", ["raddr"], lambda keys: keys.select("nosuch"))
    with pytest.raises(ValueError):
        r.register("names", "again", [], None)
    r.check(["geolocate"], ["raddr", "latency"])
    for bad in (["geolocate"], ["nosuch"]):
        with pytest.raises(ValueError):
            r.check(bad, ["latency"])
    keys = ["8.8.8.8", "8.8.8.8", "81.2.255.255", "81.3.0.0", "10.1.2.3", "8.8.8", "8.8.8.256", "host"]
    values = spark.createDataFrame([(k, 1.0) for k in keys], "key string, value double")
    places = {x["key"]: x["value"]["country"] for x in u.apply(values, r["geolocate"]).collect()}
    assert places == {"8.8.8.8": "US", "81.2.255.255": "DE"}
    assert [(x["key"], x["value"]) for x in u.apply(values, r["names"]).collect()] == [("8.8.8.8", ["dns"])]
    assert u.apply(values, r["broken"]).count() == 0
    assert u.apply(values.drop("key"), r["names"]).count() == 0


def test_applicable_transformations_within_the_row(spark, capsys):
    """What applies is decided row by row, without a shuffle that holds all specs."""
    r = u.Registry()
    rows = [(1, ["a", "b"]), (2, ["c"]), (3, ["b", None]), (4, [None]), (5, []), (6, None), (None, ["a", "a"]), (7, ["x"])]
    specs = spark.createDataFrame(rows, "spec_id long, fields array<string>")
    assert r.applicable_to(specs).collect() == []
    for name, fields in (("one", ["a", "b"]), ("two", ["b", "c"]), ("none", [])):
        r.register(name, name, fields, None)
    got = sorted(map(str, (tuple(x) for x in r.applicable_to(specs).collect())))
    assert got == sorted(map(str, [(i, n) for i, f in rows for n in r.applicable([x for x in f or [] if x])]))
    r.applicable_to(specs).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_failing_at_run_time_gives_nothing(spark):
    from pyspark.sql import functions as F

    values = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "key string, value double")
    late = u.Transformation("late", "fails while it runs", [], lambda keys: keys.select("key", F.raise_error(F.lit("no")).cast("string").alias("value")))
    assert u.apply(values, late).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_blocks_make_up_their_range(spark, seed):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(seed)
    ranges = [(0, 2**32 - 1), (5, 5), (1, 2), (3, 2), (2**32 - 1, 2**32 - 1), (1, 2**32 - 2)]
    for _ in range(200):
        low = rng.randint(0, 2**32 - 1)
        ranges.append((low, min(low + rng.randint(0, 2 ** rng.randint(0, 32)), 2**32 - 1)))
    df = spark.createDataFrame(ranges, "s bigint, e bigint").withColumn("blocks", u.blocks_of(F.col("s"), F.col("e")))
    for r in df.collect():
        if r.s > r.e:
            assert r.blocks is None
            continue
        spans = sorted((b.prefix << b.level, (b.prefix + 1 << b.level) - 1) for b in r.blocks)
        assert spans[0][0] == r.s and spans[-1][1] == r.e and len(spans) <= 64
        assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:], strict=False))
        # none of them could be larger: no two make up an aligned one
        assert not any(a.level == b.level and a.prefix ^ 1 == b.prefix for a in r.blocks for b in r.blocks)


def test_nested_networks_and_many_in_one_prefix(spark):
    base = 81 << 24
    rows = [(base, base + 65_535, "all"), (base + 256, base + 511, "part"), (base + 300, base + 300, "one"), (base + 70_000, base + 69_999, "none")]
    rows += [(base + (1 << 16) + n, base + (1 << 16) + n, f"n{n}") for n in range(0, 65_536, 16)]
    nets = spark.createDataFrame(rows, "start_ip bigint, end_ip bigint, name string")
    ip = lambda n: ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    asked = [base, base + 255, base + 256, base + 300, base + 511, base + 512, base + 65_535, base + 65_536, base + 65_537, base + 131_056]
    values = spark.createDataFrame([(ip(n), 1.0) for n in asked], "key string, value double")
    located = u.geolocate(nets)(values.select("key"))
    assert {r["key"]: r["value"]["name"] for r in located.collect()} == {
        ip(base): "all", ip(base + 255): "all", ip(base + 256): "part", ip(base + 300): "one", ip(base + 511): "part",
        ip(base + 512): "all", ip(base + 65_535): "all", ip(base + 65_536): "n0", ip(base + 131_056): "n65520",
    }
    plan = located._jdf.queryExecution().toString()
    assert " >= start_ip" not in plan and " <= end_ip" not in plan
    assert u.geolocate(nets.filter("false"))(values.select("key")).count() == 0


def test_pack_orders_keys_and_ranges(spark):
    slots = s.interval_scope(reports(spark, [("s", 1, {"b": [[[10, 20], 1], [[0, 9], 2]], "a": [[[5, 6], 3]]})]))
    value = a.pack(slots, ["slot"]).collect()[0]["value"]
    assert list(value) == ["a", "b"] and [e["lo"] for e in value["b"]] == [0, 10]
