"""E01-E09 and the event metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import pairing as e
from tickloom.operators.aggregate import decompose
from tickloom.operators.nesting import outermost_by_depth
from tickloom.plans.event_metrics import EVENT_METRICS, FILESYSTEMS
from tickloom.plans.spec import Instrumentation, instrument
from tickloom.sources.workdir import new_dir
from tickloom.streaming.sinks import append_table
from tickloom.streaming.stateful import pair_stream

from .base import DAY, query, sql_event_log_linear, with_p



def probe_rows(t):
    """Events with nanosecond clocks; a user is a thread."""
    return t.points.select(
        "event_id", "source", "user_id", "k", "optype", "latency", "t",
        (F.col("us") * 1000).alias("ts_ns"), (F.col("us") * 500 + F.col("k")).alias("vts_ns"),
        F.col("event_id").alias("seq"),
    )


def kind(name):
    return F.col("optype") == name


CLOCKS = {"start_ts": lambda: F.col("ts_ns"), "start_vts": lambda: F.col("vts_ns")}


def clocks():
    return {n: c() for n, c in CLOCKS.items()}


EV = "ev AS (SELECT *, us * 1000 AS ts_ns, us * 500 + k AS vts_ns FROM p)"


def pairs_sql(key: str = "user_id", start: str = "optype = 'view'", done: str = "optype = 'purchase'", extra: str = "") -> str:
    """Done rows directly after a start row of the same key."""
    return f"""prs AS (
  SELECT * FROM (
    SELECT *, {start} AS is_start, lag({start}) OVER w AS after_start, lag(ts_ns) OVER w AS start_ts, lag(vts_ns) OVER w AS start_vts{extra}
    FROM ev WHERE ({start}) OR ({done}) WINDOW w AS (PARTITION BY {key} ORDER BY ts_ns, event_id))
  WHERE NOT is_start AND after_start)"""


@query("e01_single_event", with_p("SELECT source AS key, CAST(count(*) AS DOUBLE) AS value FROM p WHERE optype = 'error' GROUP BY 1"))
def e01(t):
    return decompose(t.points.filter(kind("error")), key=F.col("source"))


def thread():
    return e.timeline(["user_id"])


@query("e02_pair_by_thread", with_p("SELECT event_id, user_id, start_ts FROM prs", EV, pairs_sql()))
def e02(t):
    rows = e.pair(probe_rows(t), thread(), kind("view"), kind("purchase"), {"start_ts": F.col("ts_ns")})
    return rows.select("event_id", "user_id", "start_ts")


@query("e02_plain_count", with_p("SELECT source AS key, CAST(count(*) AS DOUBLE) AS value FROM p WHERE optype = 'purchase' GROUP BY 1"))
def e02_plain(t):
    """Without a gathered field every done counts."""
    rows = e.pair(probe_rows(t), thread(), kind("view"), kind("purchase"), {})
    return decompose(rows, key=F.col("source"), value=F.lit(1.0))


@query("e03_pair_by_tuple", with_p("SELECT event_id, source, k % 4 AS request, start_ts FROM prs", EV, pairs_sql("source, k % 4")))
def e03(t):
    """Keyed by host and request: few keys with many interleaved rows each."""
    rows = probe_rows(t).withColumn("request", F.col("k") % 4)
    out = e.pair(rows, e.timeline(["source", "request"]), kind("view"), kind("purchase"), {"start_ts": F.col("ts_ns")})
    return out.select("event_id", "source", "request", "start_ts")


@query("e04_latency", with_p("SELECT event_id, ts_ns - start_ts AS latency, vts_ns - start_vts AS cputime FROM prs", EV, pairs_sql()))
def e04(t):
    rows = e.pair(probe_rows(t), thread(), kind("view"), kind("purchase"), clocks())
    return rows.select("event_id", e.latency().alias("latency"), e.cpu_time().alias("cputime"))


@query("e05_streaming_pairs", with_p("""
SELECT user_id, ts_ns, ts_ns - start_ts AS latency, vts_ns - start_vts AS cputime FROM prs
WHERE ts_ns // 1000000 < (SELECT max(us) // 1000 FROM p WHERE optype IN ('view', 'purchase')) - 10000""", EV, pairs_sql()))
def e05(t):
    """The same pairing on a stream; the rows of the last ten seconds wait for what may still come."""
    from .streams import event_stream

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = event_stream(t).filter(F.col("event_type").isin("view", "purchase")).select(
        "user_id",
        F.when(F.col("event_type") == "view", "start").otherwise("done").alias("kind"),
        (us * 1000).alias("ts_ns"),
        (us * 500 + F.get_json_object("props", "$.k").cast("bigint")).alias("vts_ns"),
        F.col("event_id").alias("seq"),
    )
    path = new_dir(t.spark, "e05")
    append_table(pair_stream(rows, ["user_id"]), path, {"availableNow": True}).awaitTermination()
    return t.spark.read.parquet(f"{path}/data")


DEPTH = """steps AS (
  SELECT *, CASE WHEN optype IN ('view', 'signup') THEN 1 ELSE -1 END AS step FROM ev WHERE optype IN ('view', 'signup', 'purchase', 'error')),
sums AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ts_ns, event_id) AS s FROM steps),
deep AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts_ns, event_id)) AS depth FROM sums),
edges AS (
  SELECT *, lag(step) OVER w AS prev_step, lag(ts_ns) OVER w AS start_ts FROM deep
  WHERE (step = 1 AND depth = 1) OR (step = -1 AND depth = 0) WINDOW w AS (PARTITION BY user_id ORDER BY ts_ns, event_id))"""


def chain_sql(enters: str, leaves: str, depth: str, more: str = "") -> str:
    """Outermost calls one after the other: an enter, the first leave at its depth, the first enter behind that."""
    return f"""steps AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, event_id) AS n, {enters} AS enters, {depth} AS depth
  FROM ev WHERE ({enters}) OR ({leaves})),
ends AS (
  SELECT e.user_id, e.n, min(l.n) AS done FROM steps e JOIN steps l
  ON l.user_id = e.user_id AND l.depth = e.depth AND NOT l.enters AND l.n > e.n WHERE e.enters GROUP BY 1, 2),
follow AS (
  SELECT l.user_id, l.n AS done, min(e.n) AS n FROM steps l JOIN steps e ON e.user_id = l.user_id AND e.enters AND e.n > l.n
  WHERE NOT l.enters GROUP BY 1, 2),
calls AS (
  SELECT user_id, min(n) AS n FROM steps WHERE enters GROUP BY 1
  UNION ALL SELECT c.user_id, f.n FROM calls c JOIN ends USING (user_id, n)
  JOIN follow f ON f.user_id = c.user_id AND f.done = ends.done),
outermost AS (
  SELECT d.*, s.ts_ns AS start_ts, s.k AS start_k FROM calls c JOIN ends USING (user_id, n)
  JOIN steps s ON s.user_id = c.user_id AND s.n = c.n JOIN steps d ON d.user_id = c.user_id AND d.n = ends.done)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("e06_outermost", recursive(with_p("SELECT event_id, user_id, ts_ns - start_ts AS latency FROM outermost", EV,
    chain_sql("optype IN ('view', 'signup')", "optype IN ('purchase', 'error')", "k % 3"))))
def e06(t):
    """Calls at one of three stack depths: most leaves belong to no call that goes on, and many are missing."""
    enter, leave = F.col("optype").isin("view", "signup"), F.col("optype").isin("purchase", "error")
    rows = outermost_by_depth(probe_rows(t), thread(), enter, leave, F.col("k") % 3, {"start_ts": F.col("ts_ns")})
    return rows.select("event_id", "user_id", e.latency().alias("latency"))


@query("e06_outermost_counted", with_p("SELECT event_id, user_id, ts_ns - start_ts AS latency FROM edges WHERE step = -1 AND prev_step = 1", EV, DEPTH))
def e06_counted(t):
    """Events without stack depths."""
    enter, leave = F.col("optype").isin("view", "signup"), F.col("optype").isin("purchase", "error")
    rows = e.outermost(probe_rows(t), thread(), enter, leave, {"start_ts": F.col("ts_ns")})
    return rows.select("event_id", "user_id", e.latency().alias("latency"))


@query("e06_depth", with_p("SELECT event_id, CAST(depth AS BIGINT) AS depth FROM deep", EV, DEPTH))
def e06_depth(t):
    enter, leave = F.col("optype").isin("view", "signup"), F.col("optype").isin("purchase", "error")
    return e.nesting_depth(probe_rows(t), thread(), enter, leave).select("event_id", "depth")


@query("e07_phases", with_p("""
SELECT user_id, max(event_id) FILTER (WHERE optype = 'purchase') AS event_id,
       CAST(max(CASE WHEN optype = 'view' THEN 1 ELSE 0 END)
         + max(CASE WHEN optype = 'click' THEN 2 ELSE 0 END) AS INTEGER) AS mask,
       max(ts_ns) FILTER (WHERE optype <> 'purchase') AS start_ts
FROM (SELECT *, count(*) FILTER (WHERE optype = 'purchase') OVER (PARTITION BY user_id ORDER BY ts_ns, event_id)
             - CASE WHEN optype = 'purchase' THEN 1 ELSE 0 END AS op
      FROM ev WHERE optype IN ('view', 'click', 'purchase'))
GROUP BY user_id, op HAVING count(*) FILTER (WHERE optype = 'purchase') > 0 AND count(*) > 1""", EV))
def e07(t):
    rows = e.classify_phases(
        probe_rows(t), thread(), {1: kind("view"), 2: kind("click")}, kind("purchase"), {"event_id": F.col("event_id")}
    )
    return rows.select("user_id", "event_id", "mask", "start_ts")


@query("e08_qualified", with_p("SELECT event_id FROM prs WHERE k % 3 = 0", EV, pairs_sql()))
def e08(t):
    """An unqualified done still ends its start."""
    rows = e.pair(probe_rows(t), thread(), kind("view"), kind("purchase"), {"start_ts": F.col("ts_ns")})
    return rows.filter(F.col("k") % 3 == 0).select("event_id")


@query("e08_qualified_clean", with_p("SELECT event_id FROM prs", EV, pairs_sql(done="optype = 'purchase' AND k % 3 = 0")))
def e08_clean(t):
    """Here an unqualified done is no done at all."""
    rows = e.pair(
        probe_rows(t), thread(), kind("view"), kind("purchase"), {"start_ts": F.col("ts_ns")}, clears=F.col("k") % 3 == 0
    )
    return rows.filter(F.col("k") % 3 == 0).select("event_id")


@query("e09_sum_valued", with_p("""
SELECT CASE WHEN k % 4 <> 1 THEN 'read' ELSE 'write' END AS key, CAST(sum(CAST(round(latency * 100) AS BIGINT)) AS DOUBLE) AS value
FROM p WHERE optype = 'click' GROUP BY 1"""))
def e09(t):
    rows = t.points.filter(kind("click"))
    key = F.when(F.col("k") % 4 != 1, "read").otherwise("write")
    return decompose(rows, key=key, value=F.round(F.col("latency") * 100))


# --- every event metric ----------------------------------------------------------------

ARGS = [
    "http_method", "http_url", "raddr", "rport", "forwarded_for", "disk", "optype", "ldapbinddn", "ldaprequestdn", "status",
    "ldapfilter", "ldapscope", "errname", "jobid", "table", "query", "command", "user", "client", "database",
    "restify_sname", "restify_rname", "restify_hname", "http_status",
]
NUMBERS = ["size", "offset", "buffered", "matched", "changed", "type", "direction", "vector", "errno", "cr3", "bytes", "code"]


def probe_events(t, metric):
    """The test events as the probes of one metric.

    ``view`` fires a start, ``purchase`` a done (or the only) probe; text
    arguments are named values, numeric ones the event's ``k``.
    """
    k = F.col("k")
    star = lambda probes: F.get(
        F.array(*(F.lit(p.replace("*", "1")) for p in probes)), (k % len(probes)).cast("int")
    )
    starts = [p for s, _ in metric.pairs for p in s] or ["none"]
    dones = [p for _, d in metric.pairs for p in d] or ["none"]
    if len(metric.pairs) == 2:  # the second pairing takes the odd rows
        (s1, d1), (s2, d2) = metric.pairs
        even = k % 2 == 0
        start, done = F.when(even, star(s1)).otherwise(star(s2)), F.when(even, star(d1)).otherwise(star(d2))
    else:
        start, done = star(starts), star(dones)
    probe = F.when(F.col("optype") == "view", start).when(F.col("optype") == "purchase", done).otherwise("other")
    if metric.style == "phases":
        names = {"view": "query-start", "click": "query-exec-start", "purchase": "query-done", "signup": "query-exec-done"}
        probe = F.lit("other")
        for event, name in names.items():
            probe = F.when(F.col("optype") == event, f"mysql1:::{name}").otherwise(probe)
    args = {n: F.concat(F.lit(n), k % 5) for n in ARGS} | {n: k.cast("string") for n in NUMBERS}
    args |= {
        "state": F.when(k % 2 == 0, "SRUN").otherwise("SSLEEP"),
        "pri": (k % 7 - 1).cast("string"),
        "driver": F.when(k % 3 == 0, "sd").when(k % 3 == 1, "cmdk").otherwise("st"),
        "family": F.when(k % 4 == 0, "AF_INET").when(k % 4 == 1, "AF_INET6").otherwise("AF_UNIX"),
        "result": (k % 5 - 1).cast("string"),
        "fstype": F.when(k % 3 == 0, FILESYSTEMS[0]).when(k % 3 == 1, FILESYSTEMS[1]).otherwise("sockfs"),
        "started": (F.col("us") * 1000 - k * 1_000_000_000).cast("string"),
    }
    return t.points.select(
        (F.col("us") * 1000).alias("ts_ns"), (F.col("us") * 500 + k).alias("vts_ns"), F.col("event_id").alias("seq"),
        F.col("source").alias("host"), probe.alias("probe"), F.col("user_id").alias("thread_id"),
        F.col("user_id").alias("pid"), (k % 4).cast("string").alias("req_key"), "zonename", (k % 4).alias("stack_depth"),
        F.when(k % 2 == 0, "qemu-system-x86_").otherwise(F.concat(F.lit("exec"), k % 3)).alias("execname"),
        F.create_map(*(x for n, v in args.items() for x in (F.lit(n), v))).alias("args"),
    )


KEYS = {("host", "thread_id"): "user_id", ("host", "pid", "req_key"): "user_id, k % 4", ("host", "req_key"): "source, k % 4"}
TCP_OK = {"tcp.accepts": "k % 5 - 1 >= 0", "tcp.connects": "k % 5 - 1 = 0"}
PHASES = """q AS (
  SELECT *, max(CASE optype WHEN 'view' THEN ts_ns * 2 + 1 WHEN 'purchase' THEN ts_ns * 2 END)
            OVER (PARTITION BY user_id ORDER BY ts_ns, event_id) AS marker
  FROM ev WHERE optype IN ('view', 'click', 'purchase', 'signup')),
outer_rows AS (SELECT *, optype IN ('purchase', 'signup') AS is_done FROM q WHERE NOT (optype = 'signup' AND coalesce(marker % 2, 0) = 1)),
ops AS (SELECT *, count(*) FILTER (WHERE is_done) OVER (PARTITION BY user_id ORDER BY ts_ns, event_id) - CASE WHEN is_done THEN 1 ELSE 0 END AS op FROM outer_rows),
grouped AS (
  SELECT source, user_id, op, max(ts_ns) FILTER (WHERE is_done) AS ts_ns, max(t) FILTER (WHERE is_done) AS t,
         max(ts_ns) FILTER (WHERE NOT is_done) AS start_ts, max(ts_ns) FILTER (WHERE optype = 'view') AS last_query,
         max(optype) FILTER (WHERE is_done) AS done_type
  FROM ops GROUP BY ALL)"""


def _grouped(rows: str, lo: str, hi: str) -> str:
    return f"""SELECT t - t % 86400 AS slot, source AS key, {lo} AS lo, max({hi}) AS hi, CAST(count(*) AS DOUBLE) AS value
FROM ({rows}) GROUP BY 1, 2, 3"""


def event_metric_sql(metric, numeric: str | None) -> str:
    name = f"{metric.module}.{metric.stat}"
    where = "true"
    if name.startswith("cpu."):
        where = "k % 7 - 1 <> -1"
    elif name == "vm.thread_samples":
        where = "k % 2 = 0"
    if name == "vm.physio_bytes":
        return with_p("SELECT t - t % 86400 AS slot, source AS key, CAST(sum(k) AS DOUBLE) AS value FROM p WHERE optype = 'purchase' GROUP BY 1, 2")
    lo, hi = sql_event_log_linear("v", 3, 11), sql_event_log_linear("v", 3, 11, hi=True)
    if metric.style == "phases":
        rows = "SELECT *, ts_ns - start_ts AS v FROM grouped WHERE start_ts IS NOT NULL AND ts_ns IS NOT NULL AND (last_query IS NOT NULL OR done_type = 'signup')"
        return with_p(_grouped(rows, lo, hi), EV, PHASES)
    if metric.style == "outermost":
        rows = "SELECT *, ts_ns - start_ts AS v FROM outermost WHERE start_k % 3 <> 2"
        return recursive(with_p(_grouped(rows, lo, hi), EV, chain_sql("optype = 'view'", "optype = 'purchase'", "k % 4")))
    if metric.pairs[0][0]:
        key = KEYS[tuple(metric.key)]
        if len(metric.pairs) == 2:
            key += ", k % 2"
        start, done = f"optype = 'view' AND {where}", f"optype = 'purchase' AND {where}"
        qualified = {"disk.physio_ops": "k % 3 <> 2", **{n: f"{c} AND k % 4 < 2" for n, c in TCP_OK.items()}}.get(name, "true")
        ctes = (EV, pairs_sql(key, start, done))
        if numeric is None:
            return with_p(f"SELECT t - t % 86400 AS slot, source AS key, CAST(count(*) AS DOUBLE) AS value FROM prs WHERE {qualified} GROUP BY 1, 2", *ctes)
        return with_p(_grouped(f"SELECT *, ts_ns - start_ts AS v FROM prs WHERE {qualified}", lo, hi), *ctes)
    rows = f"SELECT * FROM p WHERE optype = 'purchase' AND {where}"
    if numeric is None:
        return with_p(f"SELECT t - t % 86400 AS slot, source AS key, CAST(count(*) AS DOUBLE) AS value FROM ({rows}) GROUP BY 1, 2")
    if numeric == "subsecond":
        v = "CAST((us % 1000000) // 1000 // 10 * 10 AS DOUBLE)"
        return with_p(_grouped(rows, v, f"{v} + 9"))
    return with_p(_grouped(f"SELECT *, CAST(k AS DOUBLE) AS v FROM ({rows})", sql_event_log_linear("v", 0, 11), sql_event_log_linear("v", 0, 11, hi=True)))


def _register(metric):
    definition = metric.metric()
    numerics = [n for n, f in definition.fields.items() if f.arity == "numeric"]
    preferred = [n for n in ("latency", "runtime", "subsecond", "size") if n in numerics]
    numeric = preferred[0] if preferred else None
    dims = ("hostname", *([numeric] if numeric else []))

    @query(f"m_{metric.module}_{metric.stat}_events", event_metric_sql(metric, numeric))
    def _(t):
        spec = Instrumentation(metric.module, metric.stat, decomposition=dims, granularity=DAY, retention=0)
        return instrument(probe_events(t, metric), definition, spec)


for _metric in EVENT_METRICS:
    _register(_metric)
