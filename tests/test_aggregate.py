from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.helpers import nested, reports
from tickloom.functions import buckets as b
from tickloom.operators import aggregate as a
from tickloom.operators import predicates as p
from tickloom.operators import slots as s
from tickloom.sources import wire


def drawn(n, seed):
    """Points of an invented metric: queue, shift, length of the wait and weight."""
    rnd = random.Random(seed)
    return [
        (rnd.choice(["desk", "gate", "ramp"]), rnd.choice(["early", "late"]), float(rnd.randrange(400)), float(rnd.randrange(1, 50)))
        for _ in range(n)
    ]


def tens(wait):
    low = wait - wait % 10
    return low, low + 9


def summed(rows, dims):
    out = Counter()
    for row in rows:
        out[dims(row)] += row[3]
    return out


def as_nested(sums):
    """Counter of (key, range) as the nested value."""
    out = {}
    for (key, rng), n in sorted(sums.items(), key=lambda x: x[0][1]):
        out.setdefault(key, []).append([list(rng), n])
    return out


def test_decompositions(spark):
    rows = drawn(120, 1)
    df = spark.createDataFrame(rows, "queue string, shift string, wait double, value double")
    rng = b.linear(10)(F.col("wait"))
    assert nested(a.total(df)) == sum(r[3] for r in rows)
    assert nested(a.decompose(df, key=F.col("queue"))) == summed(rows, lambda r: r[0])
    whole = as_nested(summed(rows, lambda r: (None, tens(r[2]))))[None]
    assert nested(a.decompose(df, rng=rng)) == whole
    assert nested(a.decompose(df, key=F.col("shift"), rng=rng)) == as_nested(summed(rows, lambda r: (r[1], tens(r[2]))))
    late = p.apply(df, {"eq": ["shift", "late"]})
    assert nested(a.total(late)) == sum(r[3] for r in rows if r[1] == "late")
    assert nested(a.total(df.filter("false"))) == 0


LOG_LINEAR = {
    905: (900, 909), 902: (900, 909), 985: (980, 989), 1112: (1100, 1190), 1012: (1000, 1090), 1: (1, 1.09),
    10: (10, 10.9), 100: (100, 109), 1000: (1000, 1090), 0.5: (0, 1), 1095: (1000, 1090), 10**6: (10**6, 1.09 * 10**6),
}


def test_log_linear(spark):
    df = spark.createDataFrame([(float(v),) for v in LOG_LINEAR], "v double")
    rng = b.log_linear(10, 0, 11, 100)(F.col("v"))
    got = {r["v"]: (r["lo"], r["hi"]) for r in df.select("v", rng.lo.alias("lo")).withColumn("hi", rng.hi_of(F.col("lo"))).collect()}
    for v, (lo, hi) in LOG_LINEAR.items():
        assert got[v] == (lo, pytest.approx(hi, rel=1e-15)), v


def test_powers_are_exact(spark):
    """Every exactly representable power starts its own bucket, also past the expected range."""
    for base in (2, 10):
        powers = [float(base) ** e for e in range(23 if base == 10 else 200)]
        df = spark.createDataFrame([(x,) for x in powers], "v double")
        lo = b.log_linear(base, 0, 11, 4 * base)(F.col("v")).lo
        got = df.select(b.log_floor(F.col("v"), base).alias("k"), lo.alias("lo"), "v").collect()
        assert [int(r["k"]) for r in got] == list(range(len(powers)))
        assert all(r["lo"] == r["v"] for r in got)


def test_values_past_the_expected_range(spark):
    """The ladder and the general rule agree."""
    rows = [(float(v),) for v in (5, 99, 100, 12_345, 999_999, 7.5e8, 3.3e11, 9.99e14)]
    df = spark.createDataFrame(rows, "v double")
    short, long = (b.log_linear(10, 0, high, 100)(F.col("v")) for high in (1, 16))
    got = df.select(short.lo.alias("a"), long.lo.alias("b")).withColumns({"c": short.hi_of(F.col("a")), "d": long.hi_of(F.col("b"))})
    for r in got.collect():
        assert r["a"] == r["b"] and r["c"] == pytest.approx(r["d"], rel=1e-15)


def test_event_quantizers(spark):
    df = spark.createDataFrame([(v,) for v in (53_210, 819_999, 25_000_001, 999, 10**12, 1_000)], "v bigint")
    rng = b.event_log_linear(10, 3, 11, 100)(F.col("v"))
    got = [(r["lo"], r["hi"]) for r in df.select(rng.lo.alias("lo")).withColumn("hi", rng.hi_of(F.col("lo"))).collect()]
    assert got == [
        (53_000, 53_999), (810_000, 819_999), (25_000_000, 25_999_999), (0, 999), (10**12, b.HIGHEST), (1_000, 1_099)
    ]
    lin = b.event_linear(0, 1000, 10)(F.col("v"))
    df = spark.createDataFrame([(v,) for v in (-1, 0, 235, 999, 1000)], "v bigint")
    got = [(r["lo"], r["hi"]) for r in df.select(lin.lo.alias("lo")).withColumn("hi", lin.hi_of(F.col("lo"))).collect()]
    assert got == [(b.LOWEST, -1), (0, 9), (230, 239), (990, 999), (1000, b.HIGHEST)]


def random_distribution(rnd, widths=(3, 9)):
    """Some of the ranges of ten, or narrower ones; empty now and then."""
    ranges = [(float(k), float(k + rnd.choice(widths))) for k in range(0, 60, 10)]
    return {r: float(rnd.randrange(1, 20)) for r in rnd.sample(ranges, rnd.randrange(5))}


def test_add_distributions(spark):
    rnd = random.Random(2)
    pairs = [(random_distribution(rnd), random_distribution(rnd)) for _ in range(40)]
    structs = lambda d: [(*r, n) for r, n in sorted(d.items())]
    schema = "id int, a array<struct<lo: double, hi: double, value: double>>, b array<struct<lo: double, hi: double, value: double>>"
    rows = [(i, structs(x), structs(y)) for i, (x, y) in enumerate(pairs)]
    rows += [(40, structs(pairs[0][0]), None), (41, None, structs(pairs[1][1])), (42, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = df.select(
        a.add_distributions(F.col("a"), F.col("b")).alias("ab"), a.add_distributions(F.col("b"), F.col("a")).alias("ba")
    ).collect()
    for row, (x, y) in zip(got, [*pairs, (pairs[0][0], {}), ({}, pairs[1][1])]):
        assert [tuple(e) for e in row["ab"]] == [tuple(e) for e in row["ba"]] == structs(Counter(x) + Counter(y))
    assert got[42]["ab"] is None


def test_add_keyed(spark):
    rnd = random.Random(3)
    some = lambda: {k: float(rnd.randrange(1, 9)) for k in rnd.sample("uvwxyz", rnd.randrange(5))}
    pairs = [(some(), some()) for _ in range(30)]
    rows = [*pairs, (pairs[0][0], None), (None, pairs[1][1]), (None, None)]
    df = spark.createDataFrame(rows, "a map<string, double>, b map<string, double>")
    got = [r["c"] for r in df.select(a.add_keyed(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [*(Counter(x) + Counter(y) for x, y in pairs), pairs[0][0], pairs[1][1], None]


def random_reports(rnd, sources):
    """A keyed distribution from each source."""
    return {f"src{i}": {k: random_distribution(rnd, (9,)) for k in rnd.sample(["red", "green", "blue"], 2)} for i in range(sources)}


def test_keyed_distributions(spark):
    told = random_reports(random.Random(4), 3)
    values = {src: {k: [[list(r), n] for r, n in d.items()] for k, d in value.items() if d} for src, value in told.items()}
    rows = reports(spark, [(src, 700, value) for src, value in values.items()])
    slots = s.interval_scope(rows)
    sums = Counter()
    for value in told.values():
        for key, d in value.items():
            sums.update({(key, r): n for r, n in d.items()})
    assert nested(slots.drop("slot")) == as_nested(sums)
    over = Counter()
    for (_, r), n in sums.items():
        over[None, r] += n
    assert nested(a.over_keys(slots)) == as_nested(over)[None]
    keys = {k for k, _ in sums}
    assert {r["key"] for r in a.keys_present(slots, 700, 1).collect()} == keys
    assert a.keys_present(slots, 701, 5).count() == 0
    one = min(keys)
    assert nested(a.for_key(slots, one)) == as_nested(sums)[one]
    packed = a.pack(slots, ["inst_id", "slot"])
    assert sorted(map(tuple, a.unpack(packed).select(*slots.columns).collect())) == sorted(map(tuple, slots.collect()))


@pytest.mark.parametrize(
    ("shape", "text"),
    [
        (wire.SCALAR, "12"), (wire.KEYED, '{"a \\"b\\"":12,"c":0.5}'), (wire.DISTRIBUTION, "[[[0,9],12],[[10,10.9],3]]"),
        (wire.KEYED_DISTRIBUTION, '{"x":[[[0,9],12]],"y":[[[5,6],1],[[7,8],2]]}'),
    ],
)
def test_wire_round_trip(spark, shape, text):
    messages = spark.createDataFrame([("s", text), ("t", None)], "source string, value string")
    rows = wire.decode(messages, shape)
    assert rows.filter("source = 't'").select("value").collect()[0][0] is None
    mine = rows.filter("source = 's'")
    again = wire.encode(a.pack(mine, ["source"]), shape)
    assert again.collect()[0]["value"] == text


def test_conflicting_ranges(spark):
    df = spark.createDataFrame([(0.0, 9.0, 1.0), (0.0, 8.0, 1.0), (10.0, 19.0, 1.0)], "lo double, hi double, value double")
    assert [r["lo"] for r in a.conflicting_ranges(df).collect()] == [0.0]


@pytest.mark.parametrize("sources", [1, 7])
def test_sources_add_up(spark, sources):
    rnd = random.Random(sources)
    scalars = [(f"src{i}", 100, rnd.randrange(50)) for i in range(sources)]
    rows = reports(spark, scalars)
    assert nested(s.interval_scope(rows)) == sum(v for _, _, v in scalars)
    assert s.reporting(rows).collect()[0]["reporting"] == sources
    keyed = [(f"src{i}", 100, {k: rnd.randrange(1, 50) for k in rnd.sample("klmn", 2)}) for i in range(sources)]
    total = Counter()
    for _, _, value in keyed:
        total.update(value)
    assert nested(s.interval_scope(reports(spark, keyed))) == total
    silent = reports(spark, [(f"src{i}", 100, None) for i in range(sources)])
    assert nested(s.interval_scope(silent)) is None
    assert s.reporting(silent).collect()[0]["reporting"] == sources
