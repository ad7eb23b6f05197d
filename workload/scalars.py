"""X01-X18."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import buckets as b
from tickloom.functions import scalars as s
from tickloom.plans.spec import Instrumentation, ordered_decomposition, value_arities

from .base import _num, query, sql_event_log_linear, sql_log_linear, with_p


def ranged(df, rng, *by):
    counted = df.groupBy(*by, rng.lo.alias("lo")).agg(F.count("*").alias("n"))
    return counted.withColumn("hi", rng.hi_of(F.col("lo")))


@query("x01_linear", "SELECT floor(l_quantity / 7) * 7 AS lo, max(floor(l_quantity / 7) * 7 + 6) AS hi, count(*) AS n FROM lineitem GROUP BY 1")
def x01(t):
    return ranged(t.lineitem, b.linear(7)(F.col("l_quantity")))


@query("x02_log_linear", f"""
SELECT {sql_log_linear('l_extendedprice', 2)} AS lo, max({sql_log_linear('l_extendedprice', 2, hi=True)}) AS hi, count(*) AS n
FROM lineitem GROUP BY 1""")
def x02(t):
    return ranged(t.lineitem, b.log_linear(10, 2, 11, 100)(F.col("l_extendedprice")))


@query("x02_log_linear_base2", f"""
SELECT {sql_log_linear('l_quantity', 0, 2, 32, 10)} AS lo, max({sql_log_linear('l_quantity', 0, 2, 32, 10, hi=True)}) AS hi, count(*) AS n
FROM lineitem GROUP BY 1""")
def x02_base2(t):
    return ranged(t.lineitem, b.log_linear(2, 0, 25, 32)(F.col("l_quantity")))


@query("x03_log_floor", """
SELECT CAST(CASE WHEN v < 10 THEN 0 WHEN v < 100 THEN 1 WHEN v < 1000 THEN 2 WHEN v < 10000 THEN 3
       WHEN v < 100000 THEN 4 ELSE 5 END AS DOUBLE) AS k, count(*) AS n
FROM (SELECT o_orderkey + 1 AS v FROM orders) GROUP BY 1""")
def x03(t):
    return t.orders.groupBy(b.log_floor(F.col("o_orderkey") + 1, 10).alias("k")).agg(F.count("*").alias("n"))


NS = "CAST(round(l_extendedprice * 1000) AS BIGINT)"


@query("x04_event_log_linear", f"""
SELECT {sql_event_log_linear('v', 5, 6)} AS lo, max({sql_event_log_linear('v', 5, 6, hi=True)}) AS hi, count(*) AS n
FROM (SELECT {NS} AS v FROM lineitem) GROUP BY 1""")
def x04(t):
    v = F.round(F.col("l_extendedprice") * 1000).cast("bigint")
    return ranged(t.lineitem, b.event_log_linear(10, 5, 6, 100)(v))


@query("x05_event_linear", f"""
SELECT CASE WHEN q < 10 THEN {_num(b.LOWEST)} WHEN q >= 40 THEN 40 ELSE 10 + floor((q - 10) / 4) * 4 END AS lo,
       max(CASE WHEN q < 10 THEN 9 WHEN q >= 40 THEN {_num(b.HIGHEST)} ELSE 10 + floor((q - 10) / 4) * 4 + 3 END) AS hi,
       count(*) AS n
FROM (SELECT l_quantity AS q FROM lineitem) GROUP BY 1""")
def x05(t):
    return ranged(t.lineitem, b.event_linear(10, 40, 4)(F.col("l_quantity")))


@query("x06_subsecond", with_p("""
SELECT CAST((us % 1000000) // 1000 // 10 * 10 AS DOUBLE) AS lo, CAST(max((us % 1000000) // 1000 // 10 * 10 + 9) AS DOUBLE) AS hi, count(*) AS n
FROM p GROUP BY 1"""))
def x06(t):
    return ranged(t.points, b.subsecond_range(F.col("us") * 1000))


@query("x07_url_path", "SELECT page_id, split_part(url, '?', 1) AS path FROM pages")
def x07(t):
    return t.pages.select("page_id", s.url_path(F.col("url")).alias("path"))


@query("x08_request_origin", """
SELECT page_id, CASE WHEN f = '' THEN r ELSE split_part(f, ',', 1) END AS origin
FROM (SELECT page_id, CASE WHEN position('?' IN url) > 0 THEN replace(substr(url, position('?' IN url) + 1), '&', ',') ELSE '' END AS f,
             split_part(url, '/', 3) AS r FROM pages)""")
def x08(t):
    forwarded = F.when(F.instr("url", "?") > 0, F.replace(F.expr("substr(url, instr(url, '?') + 1)"), F.lit("&"), F.lit(","))).otherwise("")
    return t.pages.select(
        "page_id", s.request_origin(forwarded, F.split_part("url", F.lit("/"), F.lit(3))).alias("origin")
    )


@query("x09_query_prefix", "SELECT substr(text, 1, 6) || '...' AS prefix, count(*) AS n FROM documents GROUP BY 1")
def x09(t):
    return t.documents.groupBy(s.query_prefix(F.col("text")).alias("prefix")).agg(F.count("*").alias("n"))


PROBE = "CASE WHEN k % 3 = 0 THEN 'multi-' || optype || '-done' WHEN k % 3 = 1 THEN optype || '-done' ELSE 'server-' || optype || '-start' END"


def probes(t):
    k, name = F.col("k"), F.col("optype")
    return t.points.select(
        "*",
        F.when(k % 3 == 0, F.concat(F.lit("multi-"), name, F.lit("-done")))
        .when(k % 3 == 1, F.concat(name, F.lit("-done")))
        .otherwise(F.concat(F.lit("server-"), name, F.lit("-start"))).alias("probe"),
    )


@query("x10_probe_names", with_p(f"""
SELECT regexp_replace(probe, '-[^-]*$', '') AS statement,
       split_part(substr(probe, 8), '-', 1) AS operation,
       regexp_replace(probe, '^server-', '') AS stripped, count(*) AS n
FROM (SELECT {PROBE} AS probe FROM p) GROUP BY 1, 2, 3"""))
def x10(t):
    probe = F.col("probe")
    return probes(t).groupBy(
        s.before_last_dash(probe).alias("statement"),
        s.after_prefix(probe, "server-").alias("operation"),
        s.strip_prefix(probe, "server-").alias("stripped"),
    ).agg(F.count("*").alias("n"))


@query("x11_status", with_p("SELECT CASE WHEN k % 4 = 0 THEN 'success' ELSE 'fail' END AS status, count(*) AS n FROM p GROUP BY 1"))
def x11(t):
    return t.points.groupBy(s.status_label(F.col("k") % 4).alias("status")).agg(F.count("*").alias("n"))


@query("x12_labels", with_p("""
SELECT CASE code WHEN 'SRUN' THEN 'runnable' WHEN 'SZOMB' THEN 'exited' WHEN 'SSTOP' THEN 'stopped'
            WHEN 'SIDL' THEN 'in proc creation' WHEN 'SONPROC' THEN 'on-cpu' WHEN 'SWAIT' THEN 'waiting to be runnable'
            WHEN 'SSLEEP' THEN 'sleeping' ELSE 'unknown' END AS leavereason,
       CASE gc WHEN 1 THEN 'scavenge' WHEN 2 THEN 'mark and sweep' ELSE 'scavenge and mark and sweep.' END AS gctype,
       count(*) AS n
FROM (SELECT ['SRUN','SZOMB','SSTOP','SIDL','SONPROC','SWAIT','SSLEEP','SNEW'][1 + k % 8] AS code, k % 4 AS gc FROM p) GROUP BY 1, 2"""))
def x12(t):
    codes = F.array(*(F.lit(c) for c in [*s.RUN_STATES, "SNEW"]))
    code = F.get(codes, (F.col("k") % 8).cast("int"))
    return t.points.groupBy(
        s.label(code, s.RUN_STATES, s.RUN_STATE_UNKNOWN).alias("leavereason"),
        s.label(F.col("k") % 4, s.GC_TYPES, s.GC_TYPE_BOTH).alias("gctype"),
    ).agg(F.count("*").alias("n"))


@query("x13_conditional_measure", with_p("""
SELECT probe, CAST(sum(CASE WHEN probe IN ('update-done', 'multi-update-done') THEN k ELSE 0 END) AS BIGINT) AS changed
FROM (SELECT k, CASE optype WHEN 'click' THEN 'update-done' WHEN 'view' THEN 'multi-update-done' ELSE optype || '-done' END AS probe FROM p)
GROUP BY 1"""))
def x13(t):
    probe = F.when(F.col("optype") == "click", "update-done").when(
        F.col("optype") == "view", "multi-update-done"
    ).otherwise(F.concat("optype", F.lit("-done")))
    rows = t.points.select(probe.alias("probe"), "k")
    return rows.groupBy("probe").agg(F.sum(s.rows_changed(F.col("probe"), F.col("k"))).alias("changed"))


@query("x14_ids", "SELECT CAST(user_id AS VARCHAR) AS pid, lower(printf('%x', event_id % 256)) AS vector, count(*) AS n FROM events GROUP BY 1, 2")
def x14(t):
    return t.events.groupBy(
        s.decimal_id(F.col("user_id")).alias("pid"), s.hex_id(F.col("event_id").bitwiseAND(255)).alias("vector")
    ).agg(F.count("*").alias("n"))


@query("x15_unit_scale", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN v < 1000 THEN 1 WHEN v < 1e6 THEN 1e3 WHEN v < 1e9 THEN 1e6 WHEN v < 1e12 THEN 1e9 ELSE 1e12 END::DOUBLE AS time_divisor,
  CASE WHEN v < 1000 THEN 'ns' WHEN v < 1e6 THEN 'us' WHEN v < 1e9 THEN 'ms' WHEN v < 1e12 THEN 's' ELSE 'Ks' END AS time_label,
  CASE WHEN v < 1024 THEN 1 WHEN v < 1048576 THEN 1024 WHEN v < 1073741824 THEN 1048576 ELSE 1073741824 END::DOUBLE AS size_divisor,
  CASE WHEN v < 1024 THEN 'B' WHEN v < 1048576 THEN 'KB' WHEN v < 1073741824 THEN 'MB' ELSE 'GB' END AS size_label
FROM (SELECT *, l_extendedprice * l_extendedprice * (l_linenumber - 1) AS v FROM lineitem)""")
def x15(t):
    v = F.col("l_extendedprice") * F.col("l_extendedprice") * (F.col("l_linenumber") - 1)
    time = s.unit_scale(v, 10, -9, "seconds", "s")
    size = s.unit_scale(v, 2, None, "bytes", "B")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        time["divisor"].alias("time_divisor"), time["label"].alias("time_label"),
        size["divisor"].alias("size_divisor"), size["label"].alias("size_label"),
    )


@query("x16_ceil2", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ceil(l_extendedprice / 7 * 100) / 100 AS rounded FROM lineitem")
def x16(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s.ceil2(F.col("l_extendedprice") / 7).alias("rounded")
    )


@query("x17_spec_arity", """
SELECT o_orderkey AS spec_id, CASE WHEN len(fields) = 0 THEN 'scalar'
    WHEN list_has_any(fields, ['latency', 'k']) THEN 'numeric-decomposition' ELSE 'discrete-decomposition' END AS value_arity,
  CAST(len(fields) + 1 AS INTEGER) AS dimension
FROM (
  SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 3 > 0 THEN ['source', 'zonename', 'optype'][1 + o_custkey % 3] END,
    CASE WHEN o_orderkey % 5 > 1 THEN ['latency', 'k'][1 + o_custkey % 2] END], lambda f: f IS NOT NULL) AS fields FROM orders)""")
def x17(t):
    """Kind and dimension of the values of specs, one an order."""
    from .aggregation import EVENTS

    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (cust % len(names)).cast("int"))
    discrete = F.when(key % 3 > 0, pick(["source", "zonename", "optype"]))
    numeric = F.when(key % 5 > 1, pick(["latency", "k"]))
    kind, dimension = value_arities(F.array_compact(F.array(discrete, numeric)), EVENTS.arities)
    return t.orders.select(key.alias("spec_id"), kind.alias("value_arity"), dimension.alias("dimension"))


@query("x18_decomposition_order", with_p(f"""
SELECT zonename AS key, {sql_log_linear('latency')} AS lo, count(*) AS n FROM p GROUP BY 1, 2"""))
def x18(t):
    """A spec that lists its numeric field first still groups by key, then range."""
    from .aggregation import EVENTS

    spec = Instrumentation("app", "events", decomposition=("latency", "zonename"), granularity=5, retention=0)
    discrete, numeric = ordered_decomposition(spec, EVENTS.arities)
    rng = EVENTS.fields[numeric].bucket(F.col(numeric))
    return t.points.groupBy(F.col(discrete).alias("key"), rng.lo.alias("lo")).agg(F.count("*").alias("n"))
