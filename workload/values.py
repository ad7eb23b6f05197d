"""V01-V07, L01-L04."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import aggregate as a
from tickloom.operators import series as l
from tickloom.operators import slots as s
from tickloom.operators import values as v

from .aggregation import LATENCY, slots_both
from .base import G, LL_HI, LL_LO, query, with_p

NOW = 1706659200  # end of the data

# Orders as value requests: which times are given depends on the order.
REQUESTS = f"""req AS (
  SELECT o_orderkey AS request_id, ['view', 'click', 'purchase', 'signup', 'error'][1 + o_custkey % 5] AS inst_id,
         CASE WHEN o_orderkey % 4 IN (0, 1) THEN 1704067200 + (o_custkey * 7919) % 2592000 END AS start_time,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 3700 END AS duration,
         CASE WHEN o_orderkey % 4 IN (1, 2) THEN 1704067200 + (o_custkey * 7919) % 2592000 + o_custkey % 3700
              + CASE WHEN o_orderkey % 11 = 0 THEN -4000 ELSE 0 END END AS end_time,
         o_orderkey % 4 AS ndatapoints
  FROM orders)"""


def requests(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    base = F.lit(1704067200) + (cust * 7919) % 2592000
    kinds = F.array(*(F.lit(c) for c in ("view", "click", "purchase", "signup", "error")))
    return t.orders.select(
        key.alias("request_id"),
        F.get(kinds, (cust % 5).cast("int")).alias("inst_id"),
        F.when((key % 4).isin(0, 1), base).alias("start_time"),
        F.when(key % 3 != 0, cust % 3700).alias("duration"),
        F.when((key % 4).isin(1, 2), base + cust % 3700 + F.when(key % 11 == 0, -4000).otherwise(0)).alias("end_time"),
        (key % 4).alias("ndatapoints"),
    )


LIMITED = f"""limited AS (
  SELECT request_id, CASE WHEN duration < 1 OR duration > 3600 THEN 'duration out of range'
    WHEN ndatapoints < 1 THEN 'ndatapoints must be positive'
    WHEN start_time < 0 OR end_time < 0 THEN 'times must not be negative'
    WHEN (s - s % 3600) + (d + 3599) // 3600 * 3600 * ndatapoints > {NOW} + 5 THEN 'request ends in the future' END AS error
  FROM (SELECT *, coalesce(start_time, end_time - d) AS s FROM (
    SELECT *, coalesce(duration, end_time - start_time, 1) AS d FROM req)))"""

INFERRED = LIMITED + f""", inferred AS (
  SELECT request_id, inst_id, ndatapoints, CASE WHEN error IS NULL THEN s END AS start_time, CASE WHEN error IS NULL THEN d END AS duration, error
  FROM (
    SELECT * EXCLUDE (early), CASE WHEN early IS NOT NULL THEN early
        WHEN start_time IS NULL AND end_time IS NOT NULL AND d > end_time THEN '"duration" cannot exceed "end_time"'
        WHEN start_time IS NOT NULL AND end_time IS NOT NULL AND duration IS NULL AND end_time <= start_time THEN '"end_time" must be later than "start_time"'
        WHEN start_time IS NOT NULL AND end_time IS NOT NULL AND duration IS NOT NULL AND start_time + duration <> end_time THEN '"start_time" + "duration" must equal "end_time"'
        WHEN d < 1 THEN '"duration" must be positive' END AS error
    FROM (
      SELECT req_d.*, limited.error AS early, CASE WHEN start_time IS NOT NULL THEN start_time WHEN end_time IS NOT NULL THEN end_time - d
                     ELSE {NOW} - d - 3600 END AS s
      FROM (SELECT *, CASE WHEN duration IS NOT NULL THEN duration
                           WHEN start_time IS NOT NULL AND end_time IS NOT NULL THEN end_time - start_time ELSE 60 END AS d FROM req) req_d
      JOIN limited USING (request_id))))"""

POINTS = """pts AS (
  SELECT request_id, inst_id, point, start_time - start_time % 3600 + point * w AS start, w AS width,
         start_time + point * duration AS requested_start, duration AS requested_duration,
         start_time + (point + 1) * duration AS requested_end
  FROM (SELECT *, (duration + 3599) // 3600 * 3600 AS w, unnest(range(ndatapoints)) AS point
        FROM inferred WHERE start_time IS NOT NULL))"""


def valid(t):
    return v.checked(requests(t), NOW, 60, G)


@query("v01_infer_interval", "WITH " + REQUESTS + "," + INFERRED + "SELECT * FROM inferred")
def v01(t):
    return valid(t)


@query("v02_data_points", "WITH " + REQUESTS + "," + INFERRED + "," + POINTS + "SELECT * FROM pts")
def v02(t):
    return v.data_points(valid(t), G).withColumn("point", F.col("point").cast("bigint"))


TYPE_SLOTS = f"""dist AS (
  SELECT optype AS inst_id, slot, {LL_LO} AS lo, max({LL_HI}) AS hi, count(*) AS n FROM p GROUP BY 1, 2, 3)"""


def type_slots(t):
    return a.decompose(
        t.points, rng=LATENCY(F.col("latency")), by=[F.col("optype").alias("inst_id"), s.down(F.col("t"), G).alias("slot")]
    )


def printed(value):
    """A packed distribution as text, to compare nested values."""
    item = lambda e: F.concat(
        F.round(e["lo"] * 10).cast("bigint").cast("string"), F.lit(":"), e["value"].cast("bigint").cast("string")
    )
    return F.array_join(F.transform(value, item), ",")


@query("v03_raw_value", with_p(
    """SELECT request_id, point, string_agg(CAST(CAST(round(lo * 10) AS BIGINT) AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY lo) AS value
FROM (SELECT request_id, point, lo, CAST(sum(n) AS BIGINT) AS n FROM pts
      JOIN dist d ON d.inst_id = pts.inst_id AND d.slot >= pts.start AND d.slot < pts.start + pts.width GROUP BY 1, 2, 3)
GROUP BY 1, 2""", TYPE_SLOTS, REQUESTS, INFERRED, POINTS))
def v03(t):
    return as_bigint(v.packed_values(v.data_points(valid(t), G), type_slots(t), G, render=printed), "point")


ENVELOPE = """env AS (
  SELECT request_id, point, start AS start_time, width AS duration, start + width AS end_time,
         requested_start AS requested_start_time, requested_duration, requested_end AS requested_end_time,
         (SELECT count(DISTINCT source) FROM p WHERE p.optype = pts.inst_id) AS nsources,
         CASE WHEN (SELECT count(*) FROM counts c WHERE c.inst_id = pts.inst_id AND c.slot >= start AND c.slot < start + width) < width // 3600
              THEN 0 ELSE (SELECT min(reporting) FROM counts c WHERE c.inst_id = pts.inst_id AND c.slot >= start AND c.slot < start + width) END AS minreporting
  FROM pts)"""
COUNTS = """counts AS (SELECT optype AS inst_id, slot, count(DISTINCT source) AS reporting FROM p GROUP BY 1, 2)"""


def sources_per_type(t):
    return t.points.groupBy(F.col("optype").alias("inst_id")).agg(F.count_distinct("source").alias("nsources"))


def as_bigint(df, *names):
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


@query("v03_raw_rows", with_p(
    """SELECT request_id, point, lo, max(hi) AS hi, CAST(sum(n) AS DOUBLE) AS value
FROM pts JOIN dist d ON d.inst_id = pts.inst_id AND d.slot >= pts.start AND d.slot < pts.start + pts.width GROUP BY 1, 2, 3""",
    TYPE_SLOTS, REQUESTS, INFERRED, POINTS))
def v03_rows(t):
    return as_bigint(v.values(v.data_points(valid(t), G), type_slots(t), G), "point")


@query("v04_envelope", with_p("SELECT * FROM env", COUNTS, REQUESTS, INFERRED, POINTS, ENVELOPE))
def v04(t):
    out = v.envelope(v.data_points(valid(t), G), s.reporting(t.reports), G, sources_per_type(t))
    return as_bigint(out, "point")


@query("v05_batch", with_p(
    """SELECT i.request_id, env.point, env.start_time, env.end_time, minreporting, value, error
FROM inferred i LEFT JOIN env ON env.request_id = i.request_id LEFT JOIN (
  SELECT request_id, point, round(sum(latency), 2) AS value
  FROM pts JOIN p ON p.optype = pts.inst_id AND p.t >= pts.start AND p.t < pts.start + pts.width GROUP BY 1, 2) x
ON x.request_id = env.request_id AND x.point = env.point""", COUNTS, REQUESTS, INFERRED, POINTS, ENVELOPE))
def v05(t):
    """Every request of the batch with its envelope and its scalar value, or why it was refused."""
    asked = valid(t)
    out = v.answer(v.data_points(asked, G), s.interval_scope(t.reports), s.reporting(t.reports), G)
    return asked.select("request_id", "error").join(as_bigint(out, "point"), "request_id", "left").select(
        "request_id", "point", "start_time", "end_time", "minreporting", F.round("value", 2).alias("value"), "error"
    )


@query("v06_limits", "WITH " + REQUESTS + "," + LIMITED + "SELECT request_id, error FROM limited")
def v06(t):
    return v.limit_errors(requests(t), NOW, g=G).select("request_id", "error")


WINDOW = (1704153600, 1704153600 + 14 * 86400)


@query("v07_series_with_gaps", with_p(f"""
SELECT k.key, g.slot, CASE WHEN g.slot IN (SELECT slot FROM rare) THEN coalesce(v.n, 0)::DOUBLE END AS value
FROM (SELECT DISTINCT key FROM rare) k CROSS JOIN (SELECT unnest(range({WINDOW[0]}, {WINDOW[1]}, 3600)) AS slot) g
LEFT JOIN (SELECT key, slot, count(*) AS n FROM rare GROUP BY 1, 2) v ON v.key = k.key AND v.slot = g.slot""",
    "rare AS (SELECT slot, zonename AS key FROM p)"))
def v07(t):
    slots = a.decompose(t.points, key=F.col("zonename"), by=[s.down(F.col("t"), G).alias("slot")])
    return l.with_gaps(slots, WINDOW, G)


def zone_slots(t):
    """Keyed slots of whole cents, so that equal totals are exactly equal."""
    cents = F.round(F.col("latency") * 100)
    return a.decompose(t.points, key=F.col("zonename"), by=[s.down(F.col("t"), G).alias("slot")], value=cents)


CENTS = "round(latency * 100)"


@query("l01_ranked_keys", with_p(f"SELECT zonename AS key, sum({CENTS}) AS total FROM p GROUP BY 1 ORDER BY 2 DESC, 1"))
def l01(t):
    return l.ranked_keys(zone_slots(t))


@query("l02_top_keys", with_p(f"SELECT zonename AS key, sum({CENTS}) AS total FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"))
def l02(t):
    return l.top_keys(zone_slots(t), 8)


TOP = f"top AS (SELECT zonename FROM p GROUP BY 1 ORDER BY sum({CENTS}) DESC, 1 LIMIT 8)"


@query("l02_top_series", with_p(f"SELECT zonename AS key, slot, sum({CENTS}) AS value FROM p WHERE zonename IN (SELECT * FROM top) GROUP BY 1, 2", TOP))
def l02_series(t):
    return l.top_series(zone_slots(t), 8)


@query("l03_others", with_p(f"""
SELECT CASE WHEN zonename IN (SELECT * FROM top) THEN zonename ELSE '<other>' END AS key, slot, sum({CENTS}) AS value
FROM p GROUP BY 1, 2""", TOP))
def l03(t):
    return l.top_and_others(zone_slots(t), 8)


@query("l04_sorted_output", with_p(f"""
SELECT optype AS key, slot, {LL_LO} AS lo, max({LL_HI}) AS hi, CAST(count(*) AS DOUBLE) AS value
FROM p GROUP BY 1, 2, 3 ORDER BY 1, 2, 3"""))
def l04(t):
    return slots_both(t).orderBy("key", "slot", "lo")
