"""A01-A15, Q01, Q02 and the flagship instrumentation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tickloom.functions.buckets import linear, log_linear
from tickloom.operators import aggregate as a
from tickloom.operators.catalog import merge_names
from tickloom.operators.slots import down
from tickloom.sources import wire
from tickloom.plans.spec import FieldDef, Instrumentation, Metric, instrument

from .base import G, LL_HI, LL_LO, query, with_p
from .predicates import ownership

LATENCY = log_linear(10, 0, 11, 100)


def slot():
    return down(F.col("t"), G).alias("slot")


def event_points(source, names):
    return source.select("t", "source", *[n for n in names if n != "source"], "value")


EVENTS = Metric(
    "app",
    "events",
    {
        "source": FieldDef(), "zonename": FieldDef(), "optype": FieldDef(),
        "latency": FieldDef(LATENCY), "k": FieldDef(linear(10)),
    },
    event_points,
)
FLAGSHIP = Instrumentation(
    "app", "events", {"and": [{"ge": ["latency", 5]}, {"ne": ["optype", "error"]}]},
    ("latency", "optype"), granularity=G, retention=0,
)


def by_source_key(t):
    """Values of each source: what the hosts report per slot and key."""
    return a.decompose(t.points, key=F.col("optype"), by=["source", slot()])


def by_source_range(t):
    return a.decompose(t.points, rng=LATENCY(F.col("latency")), by=["source", slot()])


def by_source_both(t):
    return a.decompose(t.points, key=F.col("optype"), rng=LATENCY(F.col("latency")), by=["source", slot()])


def slots_both(t):
    return a.decompose(t.points, key=F.col("optype"), rng=LATENCY(F.col("latency")), by=[slot()])


@query("a01_scalar_sum", with_p("SELECT round(coalesce(sum(latency), 0), 2) AS value FROM p"))
def a01(t):
    return a.total(t.points, "latency").select(F.round("value", 2).alias("value"))


@query("a01_scalar_sum_empty", with_p("SELECT CAST(coalesce(sum(latency), 0) AS DOUBLE) AS value FROM p WHERE latency < 0"))
def a01_empty(t):
    return a.total(t.points.filter(F.col("latency") < 0), "latency").select(F.col("value").cast("double").alias("value"))


@query("a02_discrete", with_p("SELECT optype AS key, round(sum(latency), 2) AS value FROM p GROUP BY 1"))
def a02(t):
    return a.decompose(t.points, key=F.col("optype"), value="latency").withColumn("value", F.round("value", 2))


@query("a03_numeric", with_p(f"SELECT {LL_LO} AS lo, max({LL_HI}) AS hi, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY 1"))
def a03(t):
    return a.decompose(t.points, rng=LATENCY(F.col("latency")))


@query("a04_discrete_numeric", with_p(
    f"SELECT optype AS key, {LL_LO} AS lo, max({LL_HI}) AS hi, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY 1, 2"))
def a04(t):
    return a.decompose(t.points, key=F.col("optype"), rng=LATENCY(F.col("latency")))


@query("a04_lineitem", """
SELECT l_returnflag || l_linestatus AS key, floor(l_quantity / 10) * 10 AS lo, max(floor(l_quantity / 10) * 10 + 9) AS hi,
       round(sum(l_extendedprice), 2) AS value
FROM lineitem GROUP BY 1, 2""")
def a04_lineitem(t):
    key = F.concat("l_returnflag", "l_linestatus")
    out = a.decompose(t.lineitem, key=key, rng=linear(10)(F.col("l_quantity")), value="l_extendedprice")
    return out.withColumn("value", F.round("value", 2))


@query("a05_merge_scalars", with_p("SELECT slot, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY 1"))
def a05(t):
    return a.merge(a.decompose(t.points, by=["source", slot()]), ["slot"])


@query("a06_merge_decompositions", with_p(
    "SELECT slot, optype AS key, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY 1, 2"))
def a06(t):
    return a.merge(by_source_key(t), ["slot", "key"])


@query("a06_merge_packed", with_p(
    "SELECT slot, optype AS key, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY 1, 2"))
def a06_packed(t):
    """The packed form: the maps of two halves of the sources added as maps, slots of one half only included."""
    return a.unpack(halves_added(a.pack(halved(by_source_key(t), "key"), ["half", "slot"]), a.add_keyed))


def halved(values, *dims):
    """What even and odd sources report."""
    half = (F.substring("source", 5, 10).cast("int") % 2).alias("half")
    return a.merge(values.withColumn("half", half), ["half", "slot", *dims])


def halves_added(packed, add):
    even, odd = (packed.filter(F.col("half") == h).select("slot", F.col("value").alias(f"v{h}")) for h in (0, 1))
    return even.join(odd, "slot", "full").select("slot", add(F.col("v0"), F.col("v1")).alias("value"))


@query("a07_merge_distributions", with_p(
    f"SELECT slot, {LL_LO} AS lo, max({LL_HI}) AS hi, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY 1, 2"))
def a07(t):
    return a.merge(by_source_range(t), ["slot", "lo", "hi"])


@query("a07_merge_packed", with_p(
    f"SELECT slot, {LL_LO} AS lo, max({LL_HI}) AS hi, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY 1, 2"))
def a07_packed(t):
    return a.unpack(halves_added(a.pack(halved(by_source_range(t), "lo", "hi"), ["half", "slot"]), a.add_distributions))


@query("a07_range_conflicts", with_p("SELECT lo, min(hi) AS min_hi, max(hi) AS max_hi FROM (" + f"SELECT {LL_LO} AS lo, {LL_HI} AS hi FROM p" + ") GROUP BY 1 HAVING min(hi) <> max(hi)"))
def a07_conflicts(t):
    return a.conflicting_ranges(by_source_range(t))


@query("a08_merge_keyed_distributions", with_p(
    f"SELECT slot, optype AS key, {LL_LO} AS lo, max({LL_HI}) AS hi, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY 1, 2, 3"))
def a08(t):
    return a.merge(by_source_both(t), ["slot", "key", "lo", "hi"])


@query("a09_total_over_keys", with_p(
    f"SELECT slot, {LL_LO} AS lo, max({LL_HI}) AS hi, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY 1, 2"))
def a09(t):
    return a.over_keys(slots_both(t))


START, SPAN = 1704153600, 7 * 86400


@query("a10_keys_present", with_p(f"SELECT DISTINCT zonename AS key FROM p WHERE slot >= {START} AND slot < {START + SPAN}"))
def a10(t):
    slots = a.decompose(t.points, key=F.col("zonename"), by=[slot()])
    return a.keys_present(slots, START, SPAN)


@query("a11_data_for_key", with_p(
    f"SELECT slot, {LL_LO} AS lo, max({LL_HI}) AS hi, CAST(count(*) AS DOUBLE) AS value FROM p WHERE optype = 'purchase' GROUP BY 1, 2"))
def a11(t):
    return a.for_key(slots_both(t), "purchase")


@query("a12_sources_total", "SELECT count(DISTINCT 'host' || (user_id % 10)) AS nsources FROM events")
def a12(t):
    return a.sources_total(t.points.withColumnRenamed("source", "hostname"))


@query("a12_sources_of_owner", """
SELECT c_mktsegment AS owner_uuid, count(DISTINCT n_name) AS nsources
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0 GROUP BY 1""")
def a12_owner(t):
    from tickloom.operators.catalog import zones_by_host

    return zones_by_host(*ownership(t)).groupBy("owner_uuid").agg(F.count_distinct("hostname").alias("nsources"))


@query("a13_last_seen", with_p("SELECT source, max(t) AS last_seen FROM p GROUP BY 1"))
def a13(t):
    return a.last_seen(t.points)


@query("a14_pack", with_p(f"""
SELECT slot, string_agg(item, ';' ORDER BY key) AS packed FROM (
  SELECT slot, key, key || '=' || string_agg(CAST(CAST(lo * 10 AS BIGINT) AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY lo) AS item
  FROM (SELECT slot, optype AS key, {LL_LO} AS lo, count(*) AS n FROM p GROUP BY 1, 2, 3) GROUP BY slot, key)
GROUP BY slot""", ))
def a14(t):
    """Nested values, printed so that the order of keys and ranges shows."""
    packed = a.pack(slots_both(t), ["slot"])
    cells = lambda d: F.array_join(
        F.transform(
            d,
            lambda e: F.concat(
                F.round(e["lo"] * 10).cast("bigint").cast("string"), F.lit(":"), e["value"].cast("bigint").cast("string")
            ),
        ),
        ",",
    )
    items = F.transform(F.map_entries("value"), lambda e: F.concat(e["key"], F.lit("="), cells(e["value"])))
    return packed.select("slot", F.array_join(items, ";").alias("packed"))


@query("a14_unpack", with_p(
    f"SELECT slot, optype AS key, {LL_LO} AS lo, max({LL_HI}) AS hi, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY 1, 2, 3"))
def a14_unpack(t):
    return a.unpack(a.pack(slots_both(t), ["slot"]))


@query("a14_wire_round_trip", with_p(
    f"SELECT slot, optype AS key, {LL_LO} AS lo, max({LL_HI}) AS hi, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY 1, 2, 3"))
def a14_wire(t):
    """Values written as message text and read back."""
    text = wire.encode(a.pack(slots_both(t), ["slot"]), wire.KEYED_DISTRIBUTION)
    return wire.decode(text, wire.KEYED_DISTRIBUTION)


@query("a14_wire_text", with_p("""
SELECT slot, '{' || string_agg('"' || key || '":' || n, ',' ORDER BY key) || '}' AS value
FROM (SELECT slot, optype AS key, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1"""))
def a14_wire_text(t):
    slots = a.decompose(t.points, key=F.col("optype"), by=[slot()])
    return wire.encode(a.pack(slots, ["slot"]), wire.KEYED)


FLAGSHIP_SQL = with_p(f"""
SELECT slot, optype AS key, {LL_LO} AS lo, max({LL_HI}) AS hi, CAST(count(*) AS DOUBLE) AS value
FROM p WHERE latency >= 5 AND optype <> 'error' GROUP BY 1, 2, 3""")


@query("a15_instrument", FLAGSHIP_SQL)
def a15(t):
    return instrument(t.points, EVENTS, FLAGSHIP)


NOW = 1705276800  # mid January


@query("a15_instrument_live", with_p(f"""
SELECT slot, optype AS key, {LL_LO} AS lo, max({LL_HI}) AS hi, CAST(count(*) AS DOUBLE) AS value
FROM p WHERE latency >= 5 AND optype <> 'error' AND t - 10 <= {NOW} AND slot >= {NOW} - 432000 AND t % 5 = 0 GROUP BY 1, 2, 3"""))
def a15_live(t):
    """The same as of a moment: nothing from ahead of it, five days kept, on the seconds of collection."""
    return instrument(t.points, EVENTS, replace(FLAGSHIP, retention=432_000), now=NOW, on_grid=True)


@query("a15_instrument_zones", with_p("""
SELECT slot, source AS key, CAST(count(*) AS DOUBLE) AS value FROM p
WHERE zonename IN ('zone3', 'zone14') AND k >= 30 GROUP BY 1, 2"""))
def a15_zones(t):
    spec = Instrumentation(
        "app", "events", {"ge": ["k", 30]}, ("source",), granularity=G, retention=0, zones=["zone3", "zone14"]
    )
    return instrument(t.points, EVENTS, spec)


GAUGE_METRIC = Metric(
    "app", "load", {"hostname": FieldDef(), "optype": FieldDef(), "latency": FieldDef(LATENCY)},
    lambda source, names: source.select("t", *names, F.col("k").cast("double").alias("value")), scope="point",
)
# Each host reads its gauge every quarter of an hour: four reports an hour, the first of them counts.
READINGS = "r AS (SELECT t - t % 900 AS t, source AS hostname, optype, latency, slot, CAST(k AS DOUBLE) AS value FROM p)"
FIRST = "f AS (SELECT * FROM (SELECT *, min(t) OVER (PARTITION BY slot, hostname) AS first_t FROM r) WHERE t = first_t)"


def readings(t):
    return t.points.withColumns({"t": F.col("t") - F.col("t") % 900, "hostname": F.col("source")})


@query("a15_instrument_point", with_p("SELECT slot, sum(value) AS value FROM f GROUP BY 1", READINGS, FIRST))
def a15_point(t):
    """A reading is not added up over time: the first report of each host and slot counts."""
    return instrument(readings(t), GAUGE_METRIC, Instrumentation("app", "load", granularity=G, retention=0))


@query("a15_instrument_point_keyed", with_p(
    f"SELECT slot, optype AS key, {LL_LO} AS lo, max({LL_HI}) AS hi, sum(value) AS value FROM f GROUP BY 1, 2, 3",
    READINGS, FIRST))
def a15_point_keyed(t):
    spec = Instrumentation("app", "load", decomposition=("optype", "latency"), granularity=G, retention=0)
    return instrument(readings(t), GAUGE_METRIC, spec)


@query("q01_union_sources", """
WITH u AS (
  SELECT 'order' AS origin, CAST(o_orderstatus AS VARCHAR) AS key FROM orders
  UNION ALL SELECT 'item', l_linestatus FROM lineitem)
SELECT key, CAST(count(*) AS DOUBLE) AS value FROM u GROUP BY 1""")
def q01(t):
    """One metric from two sources."""
    orders = a.decompose(t.orders, key=F.col("o_orderstatus"), value=F.lit(1.0))
    items = a.decompose(t.lineitem, key=F.col("l_linestatus"), value=F.lit(1.0))
    return a.merge(a.union_sources(orders, items), ["key"])


@query("q02_merge_names", with_p(
    """SELECT user_id, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS names
FROM per""",
    """per AS (
  SELECT user_id, coalesce(list(DISTINCT optype ORDER BY optype) FILTER (WHERE latency < 20), []) AS a,
         coalesce(list(DISTINCT optype ORDER BY optype) FILTER (WHERE latency >= 20), []) AS b
  FROM p GROUP BY 1)"""))
def q02(t):
    pick = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("optype"))))
    per = t.points.groupBy("user_id").agg(
        pick(F.col("latency") < 20).alias("a"), pick(F.col("latency") >= 20).alias("b")
    )
    return per.select("user_id", F.array_join(merge_names("a", "b"), ",").alias("names"))
