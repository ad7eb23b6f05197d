"""T01-T15."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import aggregate as a
from tickloom.operators import slots as s


from .base import DAY, G, query, with_p

G7 = 25  # a granularity that does not divide the hour


@query("t01_slot_down", with_p("SELECT event_id, t - t % 25 AS slot FROM p"))
def t01(t):
    return t.points.select("event_id", s.down(F.col("t"), G7).alias("slot"))


@query("t02_slot_up", with_p("SELECT event_id, CASE WHEN t % 25 = 0 THEN t ELSE t - t % 25 + 25 END AS slot FROM p"))
def t02(t):
    return t.points.select("event_id", s.up(F.col("t"), G7).alias("slot"))


@query("t03_normalize", with_p("""
SELECT event_id, t - t % 25 AS start, CASE WHEN k % 25 = 0 THEN k ELSE k - k % 25 + 25 END AS width FROM p"""))
def t03(t):
    start, width = s.normalize(F.col("t"), F.col("k"), G7)
    return t.points.select("event_id", start.alias("start"), width.alias("width"))


def rounded(df):
    return df.withColumn("value", F.round("value", 2))


@query("t04_interval_scope", with_p("SELECT optype AS inst_id, slot, round(sum(latency), 2) AS value FROM p GROUP BY 1, 2"))
def t04(t):
    return rounded(s.accumulate(t.reports, "interval"))


FIRST = """firsts AS (
  SELECT optype AS inst_id, slot, source, latency FROM (
    SELECT *, row_number() OVER (PARTITION BY optype, slot, source ORDER BY t, event_id) AS rn FROM p) WHERE rn = 1)"""


@query("t05_point_scope", with_p("SELECT inst_id, slot, round(sum(latency), 2) AS value FROM firsts GROUP BY 1, 2", FIRST))
def t05(t):
    return rounded(s.accumulate(t.reports, "point"))


@query("t05_point_scope_keyed", with_p("""
SELECT slot, key, CAST(sum(n) AS DOUBLE) AS value FROM (
  SELECT slot, source, us // 300000000 AS report, optype AS key, count(*) AS n FROM p GROUP BY ALL)
JOIN (SELECT slot, source, min(us // 300000000) AS report FROM p GROUP BY 1, 2) USING (slot, source, report)
GROUP BY 1, 2"""))
def t05_keyed(t):
    """Reports every 300 s with several keys: all rows of the first one stay."""
    reports = a.decompose(
        t.points,
        key=F.col("optype"),
        by=["source", (F.col("t") - F.col("t") % G).alias("slot"), F.floor(F.col("us") / 300_000_000).alias("report")],
    )
    return s.point_scope(reports, order=("report",))


@query("t06_rollup_interval", with_p("SELECT optype AS inst_id, t - t % 86400 AS period, round(sum(latency), 2) AS value FROM p GROUP BY 1, 2"))
def t06(t):
    return rounded(s.rollup_by(s.interval_scope(t.reports), DAY))


@query("t06_rollup_point", with_p("""
SELECT inst_id, slot AS period, round(sum(latency), 2) AS value FROM firsts WHERE slot % 86400 = 0 GROUP BY 1, 2""", FIRST))
def t06_point(t):
    """A gauge over a day is its first hour."""
    return rounded(s.rollup_by(s.point_scope(t.reports), DAY, "point"))


FINE_VALUES = """v AS (SELECT optype AS inst_id, t - t % 60 AS slot, sum(latency) AS value FROM p GROUP BY 1, 2)"""


@query("t07_zero_fill", with_p("""
SELECT g.inst_id, g.slot, round(coalesce(v.value, 0), 2) AS value
FROM (SELECT inst_id, unnest(range(min(slot), max(slot) + 1, 60)) AS slot FROM v GROUP BY 1) g
LEFT JOIN v ON v.inst_id = g.inst_id AND v.slot = g.slot""", FINE_VALUES))
def t07(t):
    """All events in slots of a minute, most of them empty."""
    values = s.interval_scope(t.reports.withColumn("slot", s.down(F.col("t"), 60)))
    spans = values.groupBy("inst_id").agg(F.min("slot").alias("start"), (F.max("slot") + 60).alias("end"))
    return rounded(s.zero_fill(values, spans, 60, ["inst_id"]))


COUNTS = """counts AS (SELECT optype AS inst_id, slot, count(DISTINCT source) AS reporting FROM p GROUP BY 1, 2)"""
ALL_COUNTS = """counts AS (SELECT slot, count(DISTINCT source) AS reporting FROM p GROUP BY 1)"""


@query("t08_reporting", with_p("SELECT inst_id, slot, reporting FROM counts", COUNTS))
def t08(t):
    return s.reporting(t.reports)


MIN_MAX = """
SELECT inst_id, slot - slot % 86400 AS period, CASE WHEN count(*) < 24 THEN 0 ELSE min(reporting) END AS min_reporting,
       max(reporting) AS max_reporting
FROM counts GROUP BY 1, 2"""


@query("t09_min_reporting", with_p(f"SELECT inst_id, period, min_reporting FROM ({MIN_MAX})", COUNTS))
def t09(t):
    return s.reporting_range(s.reporting(t.reports), DAY, G).select("inst_id", "period", "min_reporting")


@query("t10_max_reporting", with_p(f"SELECT inst_id, period, max_reporting FROM ({MIN_MAX})", COUNTS))
def t10(t):
    return s.reporting_range(s.reporting(t.reports), DAY, G).select("inst_id", "period", "max_reporting")


DENSE = """counts AS (
  SELECT g.inst_id, g.slot, coalesce(n.reporting, 0) AS reporting FROM (
    SELECT inst_id, unnest(range(min(slot), max(slot) + 1, 60)) AS slot FROM told GROUP BY inst_id) g
  LEFT JOIN told n ON n.inst_id = g.inst_id AND n.slot = g.slot)"""
TOLD = """told AS (SELECT optype AS inst_id, t - t % 60 AS slot, count(DISTINCT source) AS reporting FROM p GROUP BY 1, 2)"""

EXPECTED = """
SELECT c.inst_id, c.slot, c.reporting, coalesce(max(o.reporting), 0) AS expected
FROM counts c LEFT JOIN counts o ON o.inst_id = c.inst_id AND o.slot = c.slot - 60 GROUP BY 1, 2, 3"""


def minutes(t):
    """All reports in slots of a minute; in most of them no source reports."""
    return t.points.select(F.col("optype").alias("inst_id"), "source", (F.col("t") - F.col("t") % 60).alias("slot"))


@query("t11_expected", with_p(EXPECTED, TOLD, DENSE))
def t11(t):
    """At slots of a minute the settled window is the slot before."""
    return s.expected(s.reporting(minutes(t)), 60)


FINE = """told AS (SELECT t - t % 60 AS slot, count(DISTINCT source) AS reporting FROM p GROUP BY 1),
counts AS (
  SELECT g.slot, coalesce(n.reporting, 0) AS reporting
  FROM (SELECT unnest(range(min(slot), max(slot) + 1, 60)) AS slot FROM told) g LEFT JOIN told n ON n.slot = g.slot)"""


@query("t11_expected_fine", with_p("""
SELECT c.slot, c.reporting, coalesce(max(o.reporting), 0) AS expected
FROM counts c LEFT JOIN counts o ON o.slot = c.slot - 60 GROUP BY 1, 2""", FINE))
def t11_fine(t):
    """Slots of a minute, most of them silent: the settled window is the minute before."""
    counts = s.reporting(t.points.select((F.col("t") - F.col("t") % 60).alias("slot"), "source"))
    return s.expected(counts, 60)


@query("t12_complete", with_p(f"SELECT *, reporting >= expected AS complete FROM ({EXPECTED})", TOLD, DENSE))
def t12(t):
    return s.complete(s.reporting(minutes(t)), 60)


WINDOWED = """told AS (SELECT t - t % 5 AS slot, count(DISTINCT source) AS reporting FROM p GROUP BY 1),
counts AS (
  SELECT g.slot, coalesce(n.reporting, 0) AS reporting
  FROM (SELECT unnest(range(min(slot), max(slot) + 1, 5)) AS slot FROM told) g LEFT JOIN told n ON n.slot = g.slot)"""


@query("t11_expected_window", with_p("""
SELECT c.slot, c.reporting, greatest(coalesce(a.reporting, 0), coalesce(b.reporting, 0)) AS expected,
  c.slot - c.slot % 86400 AS day, CAST(1 AS BIGINT) AS slots, c.slot AS first_slot, c.slot AS last_slot
FROM counts c LEFT JOIN counts a ON a.slot = c.slot - 15 LEFT JOIN counts b ON b.slot = c.slot - 10""", WINDOWED))
def t11_window(t):
    """All events in slots of five seconds: the settled window holds two slots. A row per slot, with its day and the slots it stands for."""
    counts = s.reporting(t.points.select((F.col("t") - F.col("t") % 5).alias("slot"), "source"))
    slot = F.col("slot")
    return s.expected(counts, 5).select(
        slot, "reporting", "expected", (slot - slot % DAY).alias("day"), F.lit(1).cast("bigint").alias("slots"),
        slot.alias("first_slot"), slot.alias("last_slot"),
    )


NOW = 1705276800  # mid January


@query("t13_future_guard", with_p(f"SELECT source, count(*) AS reports FROM p WHERE t - 10 <= {NOW} GROUP BY 1"))
def t13(t):
    return s.not_from_future(t.reports, NOW).groupBy("source").agg(F.count("*").alias("reports"))


@query("t14_retention", with_p(f"""
SELECT optype AS inst_id, slot, round(sum(latency), 2) AS value FROM p WHERE slot >= {NOW} - 864000 GROUP BY 1, 2"""))
def t14(t):
    return rounded(s.interval_scope(s.retain(t.reports, NOW, 864_000)))


@query("t15_sampling_grid", with_p("SELECT source, count(*) AS reports FROM p WHERE t % 5 = 0 GROUP BY 1"))
def t15(t):
    """Reports on the grid of a 5 s collection."""
    return s.on_sampling_grid(t.reports, 60).groupBy("source").agg(F.count("*").alias("reports"))
