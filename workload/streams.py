"""ST01-ST08: streams over the test tables, run to the end and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import slots as s
from tickloom.sources.snapshots import load
from tickloom.sources.workdir import new_dir, written
from tickloom.streaming import sinks
from tickloom.streaming import slots as st
from tickloom.streaming.stateful import delta_stream, emitted, pair_stream

from .base import G, query, with_p

MONTH = 31 * 86400
ONCE = {"availableNow": True}


def event_stream(t):
    """``events`` as a file stream (a glob, so that it may be a file or a folder)."""
    spark = t.spark
    schema = spark.read.parquet(f"{t.dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{t.dir}/events.parque[t]")


FILES = 4


def landed(t, df, name, keys, *steps):
    """``df`` written in steps, one after the other, and streamed in that order.

    A step is dealt over files by its keys, so that a key's rows of a step lie
    in one file and its rows of different steps come in order.
    """
    path = new_dir(t.spark, name)
    if len(steps) > 1:  # worked out once for all steps
        df = written(df, f"{name}-rows")
    for step in steps:
        df.filter(step).repartition(FILES, *keys).write.mode("append").parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(path)


def report_stream(t, name, *steps):
    reports = t.points.select(
        F.col("optype").alias("inst_id"), "source", F.floor(F.col("us") / 1000).alias("ts_ms"), "t",
        F.col("event_id").alias("seq"), "k", (F.col("t") - F.col("t") % G).alias("slot"),
        F.round(F.col("latency") * 100).alias("value"),
    )
    return st.with_event_time(landed(t, reports, name, ["inst_id", "source"], *steps))





def revising():
    """Each step has reports of every slot, so later steps revise the slots."""
    return F.col("k") < 33, F.col("k").between(33, 65), F.col("k") > 65


def late():
    """The second half of the month arrives first."""
    middle = 1705363200
    return F.col("t") >= middle, F.col("t") < middle


CENTS = "sum(round(latency * 100))"


def run_revised(t, stream, name, keys):
    path = new_dir(t.spark, name)
    sinks.revised_table(stream, path, ONCE, keys, parts=2).awaitTermination()
    return sinks.latest(t.spark, path, keys)


def run_append(t, stream, name):
    path = new_dir(t.spark, name)
    sinks.append_table(stream, path, ONCE).awaitTermination()
    return t.spark.read.parquet(f"{path}/data")


@query("st01_tumbling", with_p(f"SELECT optype AS inst_id, slot, {CENTS} AS value FROM p GROUP BY 1, 2"))
def st01(t):
    """Slots revised by each of three micro-batches."""
    return run_revised(t, st.tumbling(report_stream(t, "st01-in", *revising()), G, MONTH), "st01", ["inst_id", "slot"])


@query("st02_late_data", with_p(f"SELECT optype AS inst_id, slot, {CENTS} AS value FROM p GROUP BY 1, 2"))
def st02(t):
    """Two weeks late, but inside the retention."""
    return run_revised(t, st.tumbling(report_stream(t, "st02-in", *late()), G, MONTH), "st02", ["inst_id", "slot"])


COMPLETE = """told AS (SELECT optype AS inst_id, slot, count(DISTINCT source) AS reporting FROM p GROUP BY 1, 2),
counts AS (
  SELECT g.inst_id, g.slot, coalesce(n.reporting, 0) AS reporting FROM (
    SELECT inst_id, unnest(range(min(slot), max(slot) + 1, 3600)) AS slot FROM told GROUP BY inst_id) g
  LEFT JOIN told n ON n.inst_id = g.inst_id AND n.slot = g.slot)"""


@query("st03_complete", with_p("""
SELECT *, reporting >= expected AS complete FROM (
  SELECT c.inst_id, c.slot, c.reporting, coalesce(max(o.reporting), 0) AS expected
  FROM counts c LEFT JOIN counts o ON o.inst_id = c.inst_id AND o.slot = c.slot - 3600 GROUP BY 1, 2, 3)""", COMPLETE))
def st03(t):
    """Arrivals as a stream, completeness from their table at any time."""
    arrived = run_append(t, st.arrivals(report_stream(t, "st03-in", *revising()), G, MONTH), "st03")
    return s.complete(s.reporting(arrived), G)


@query("st03_settled", with_p(f"""
SELECT optype AS inst_id, slot, {CENTS} AS value FROM p
WHERE (slot + 3600) * 1000 <= (SELECT max(us) // 1000 FROM p) - 5000 GROUP BY 1, 2"""))
def st03_settled(t):
    """Slots that come out once, five seconds after their end."""
    return run_append(t, st.settled(report_stream(t, "st03b-in", F.lit(True)), G), "st03b")


@query("st04_point_scope", with_p(f"""
SELECT inst_id, slot, sum(round(latency * 100)) AS value FROM (
  SELECT optype AS inst_id, slot, latency, row_number() OVER (PARTITION BY optype, slot, source ORDER BY us // 1000, event_id) AS rn FROM p)
WHERE rn = 1 AND (slot + 3600) * 1000 <= (SELECT max(us) // 1000 FROM p) - 3600000 GROUP BY 1, 2"""))
def st04(t):
    """First report of each source and slot, then summed over the sources."""
    return run_append(t, st.first_reports(report_stream(t, "st04-in", F.lit(True)), G, G), "st04")


EMITTED = """r AS (
  SELECT optype AS inst_id, slot, source, round(latency * 100) AS cents, t, k = 7 AND t < 1704931200 AS later FROM p),
told AS (
  SELECT inst_id, slot, count(DISTINCT source) AS reporting, sum(cents) AS value FROM r WHERE NOT later GROUP BY 1, 2),
lone AS (
  SELECT inst_id, slot, count(DISTINCT source) AS reporting, sum(cents) AS value FROM r
  WHERE later AND (inst_id, slot) NOT IN (SELECT (inst_id, slot) FROM told) GROUP BY 1, 2),
both_ AS (SELECT * FROM told UNION ALL SELECT * FROM lone),
judged AS (
  SELECT c.*, coalesce(o.reporting, 0) AS expected FROM told c LEFT JOIN told o ON o.inst_id = c.inst_id AND o.slot = c.slot - 3600
  UNION ALL
  SELECT c.*, coalesce(o.reporting, 0) FROM lone c LEFT JOIN both_ o ON o.inst_id = c.inst_id AND o.slot = c.slot - 3600),
out_ AS (
  SELECT *, reporting >= expected AS complete FROM judged
  WHERE reporting >= expected OR slot + 3605 <= (SELECT max(t) FROM r WHERE r.inst_id = judged.inst_id))"""


@query("st03_emitted", with_p("""
SELECT inst_id, slot, value, reporting, expected, complete, CASE WHEN complete THEN 'complete' ELSE 'timeout' END AS reason FROM out_
UNION ALL
SELECT inst_id, slot, sum(cents), count(*), NULL, NULL, 'late' FROM r
WHERE later AND (inst_id, slot) IN (SELECT (inst_id, slot) FROM told) GROUP BY 1, 2""", EMITTED))
def st03_emitted(t):
    """Slots come out once, in three micro-batches; a part of the reports of the first comes with the last."""
    first, second = F.col("t") < 1704931200, F.col("t") < 1705795200  # eleven and twenty-one days in
    behind = first & (F.col("k") == 7)
    stream = report_stream(t, "st03c-in", first & ~behind, ~first & second, ~second | behind)
    return run_append(t, emitted(stream, G, MONTH), "st03c")


SHUFFLED = """SELECT * FROM (
  SELECT source, k % 4 AS request, us * 1000 AS ts_ns, us * 500 AS vts_ns, optype,
         lag(optype) OVER w AS before, lag(us * 1000) OVER w AS start_ts, lag(us * 500) OVER w AS start_vts
  FROM p WHERE optype IN ('view', 'purchase') WINDOW w AS (PARTITION BY source, k % 4 ORDER BY us, event_id))
WHERE optype = 'purchase' AND before = 'view'"""


def requests(t):
    return t.points.filter(F.col("optype").isin("view", "purchase")).select(
        "source", (F.col("k") % 4).alias("request"),
        F.when(F.col("optype") == "view", "start").otherwise("done").alias("kind"),
        (F.col("us") * 1000).alias("ts_ns"), (F.col("us") * 500).alias("vts_ns"), F.col("event_id").alias("seq"),
    )


@query("st05_stateful_pairing", with_p(f"""
SELECT source, request, ts_ns, ts_ns - start_ts AS latency, vts_ns - start_vts AS cputime FROM ({SHUFFLED})
WHERE ts_ns // 1000000 < (SELECT max(us) // 1000 FROM p WHERE optype IN ('view', 'purchase')) - 691200000"""))
def st05(t):
    """Requests per host in four micro-batches that each hold rows of two weeks; eight days late is in time.

    Rows of the last eight days are still waiting at the end.
    """
    week = F.floor((F.col("ts_ns") / 1_000_000_000 - 1704067200) / (7 * 86400))
    odd = F.col("seq") % 2 == 1  # every other row comes a week later
    arrives = F.least(week + odd.cast("int"), F.lit(5))
    stream = landed(t, requests(t), "st05-in", ["source", "request"], *[arrives == n for n in range(6)])
    return run_append(t, pair_stream(stream, ["source", "request"], "8 days"), "st05")


@query("st05_orphans", with_p(f"""
SELECT source, request, ts_ns, ts_ns - start_ts AS latency, vts_ns - start_vts AS cputime FROM ({SHUFFLED})
WHERE ts_ns - start_ts <= 3600000000000
  AND ts_ns // 1000000 < (SELECT max(us) // 1000 FROM p WHERE optype IN ('view', 'purchase')) - 10000"""))
def st05_orphans(t):
    """Starts are forgotten after an hour, without waiting for it."""
    stream = landed(t, requests(t), "st05b-in", ["source", "request"], F.lit(True))
    return run_append(t, pair_stream(stream, ["source", "request"], orphan_ms=3_600_000), "st05b")


def _counter_sql():
    from .counters import sql

    return sql("SELECT user_id, read_no, interval, d_cents, d_events FROM pairs")


@query("st06_stateful_delta", _counter_sql())
def st06(t):
    """Counter growth on a stream of reads; the last read is kept per record."""
    from .counters import daily

    reads = daily(t).select("user_id", "read_no", (F.col("us") * 1000).alias("snaptime"), "cents", "events")
    first = 19723
    stream = landed(t, reads, "st06-in", ["user_id"], F.col("read_no") < first + 10, F.col("read_no").between(first + 10, first + 19), F.col("read_no") > first + 19)
    return run_append(t, delta_stream(stream, ["user_id"], "user_id long", ["cents", "events"]), "st06")


@query("st07_stream_to_snapshot", with_p(f"""
SELECT optype AS inst_id, slot, {CENTS} AS value, count(DISTINCT source) AS reporting FROM p GROUP BY 1, 2"""))
def st07(t):
    """A snapshot kept up to date by a stream, summed up on the way, and loaded afterwards."""
    path = new_dir(t.spark, "st07")
    stream = report_stream(t, "st07-in", *revising()).select("inst_id", "slot", "source", "t", "value")
    sinks.save_snapshots(stream, path, G, trigger=ONCE, parts=2).awaitTermination()
    saved = load(t.spark, path, G)
    return saved.slots.join(s.reporting(saved.reporting), ["inst_id", "slot"])


SLIDING = with_p(f"""
SELECT inst_id, slot, sum(cents) AS value FROM (
  SELECT optype AS inst_id, unnest(range(slot - 10800, slot + 1, 3600)) AS slot, round(latency * 100) AS cents FROM p)
GROUP BY 1, 2""")


@query("st08_sliding", SLIDING)
def st08(t):
    """Four-hour windows that move by an hour, on the stream."""
    stream = st.sliding(report_stream(t, "st08-in", *revising()), 4 * G, G, MONTH)
    return run_revised(t, stream, "st08", ["inst_id", "slot"])


@query("st08_sliding_read", SLIDING)
def st08_read(t):
    """The same read from the finished slots."""
    reports = t.reports.withColumn("value", F.round(F.col("value") * 100))
    return st.sliding_from_slots(s.interval_scope(reports), 4 * G, G)
