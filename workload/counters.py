"""K01-K13 and the counter, storage, process and collector metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.buckets import linear
from tickloom.functions.scalars import TCP_ERRORS
from tickloom.operators import counters as k
from tickloom.operators.aggregate import decompose
from tickloom.operators.ordered import Timeline, running
from tickloom.plans.counter_metrics import COUNTER_METRICS, VM_EXITS
from tickloom.plans.snapshot_metrics import COLLECTOR_METRICS, PROCESSES, STORAGE_METRICS
from tickloom.plans.spec import Instrumentation, instrument

from .base import DAY, query, sql_log_linear, with_p

# Counters of a user's record: running sums of what its events measure.
BASES = ["cents", "ks", "views", "clicks", "purchases", "signups", "errors", "events"]
COUNTERS = [
    "ipackets64", "opackets64", "rbytes64", "obytes64", "reads", "writes", "nread", "nwritten", "outSegs", "inSegs",
    *TCP_ERRORS, "rss", "swap", "pagedout", "pgpgin", *VM_EXITS.values(), "exits", "hits", "misses", "avenrun_1min",
]
NS_COUNTERS = ["cpu_nsec_kernel", "cpu_nsec_user", "nsec_sys", "nsec_user", "nsec_waitrq", "rtime"]
BASE_OF = {name: BASES[i % len(BASES)] for i, name in enumerate(COUNTERS)}
TYPES = {"views": "view", "clicks": "click", "purchases": "purchase", "signups": "signup", "errors": "error"}


def daily(t):
    """Running sums per user at the end of each day with events."""
    day = F.floor(F.col("t") / DAY).cast("bigint")
    per_day = t.points.groupBy("user_id", day.alias("read_no")).agg(
        F.max("us").alias("us"),
        F.sum(F.round(F.col("latency") * 100).cast("bigint")).alias("cents"),
        F.sum("k").alias("ks"),
        *(F.count_if(F.col("optype") == kind).alias(n) for n, kind in TYPES.items()),
        F.count("*").alias("events"),
    )
    line = Timeline(["user_id"], ["read_no"], 64)
    totals = running(per_day, line, {f"c_{b}": ("sum", F.col(b)) for b in BASES})
    return totals.select("user_id", "read_no", "us", *(F.col(f"c_{b}").alias(b) for b in BASES))


def snapshots(t):
    """The running sums as counter records of a disk-like device."""
    u = F.col("user_id")
    values = {n: F.col(b).cast("double") for n, b in BASE_OF.items()}
    values |= {n: (F.col(BASES[i % 2]) * 1_000_000_000 * (1 + i % 2)).cast("double") for i, n in enumerate(NS_COUNTERS)}
    cap = F.when(u % 3 == 0, 0.0).when(u % 3 == 1, 2.0**64).otherwise(F.col("cents").cast("double"))
    values |= {"physcap": cap, "swapcap": cap}
    return daily(t).select(
        "user_id",
        "read_no",
        F.floor(F.col("us") / 1_000_000).cast("bigint").alias("t"),
        (F.col("us") * 1000).alias("snaptime"),
        F.concat(F.lit("host"), u % 10).alias("hostname"),
        F.when(u % 3 == 0, "sd").when(u % 3 == 1, "cmdk").otherwise("st").alias("module"),
        F.lit("disk").alias("class"),
        u.alias("instance"),
        F.when(u % 4 == 0, F.concat(F.lit("net"), u)).when(u % 4 == 1, "vm").otherwise(F.concat(F.lit("sd"), u)).alias("name"),
        F.when(u % 5 != 0, F.concat(F.lit("zone"), u)).otherwise("global").alias("zonename"),
        F.create_map(*(x for n, v in values.items() for x in (F.lit(n), v))).alias("data"),
    )


SUMS = ", ".join(f"CAST(sum({b}) OVER w AS BIGINT) AS {b}" for b in BASES)
DAILY = f"""daily AS (
  SELECT user_id, read_no, us, {SUMS} FROM (
    SELECT user_id, t // 86400 AS read_no, max(us) AS us, sum(CAST(round(latency * 100) AS BIGINT)) AS cents, sum(k) AS ks,
           {", ".join(f"count(*) FILTER (WHERE optype = '{kind}') AS {n}" for n, kind in TYPES.items())}, count(*) AS events
    FROM p GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY read_no))"""
DELTAS = ", ".join(
    [f"n.{b} - o.{b} AS d_{b}, n.{b} AS {b}" for b in BASES]
)
PAIRS = f"""pairs AS (
  SELECT n.user_id, n.read_no, n.us // 1000000 AS t, n.us * 1000 - o.us * 1000 AS interval, 'host' || (n.user_id % 10) AS hostname,
         CASE n.user_id % 3 WHEN 0 THEN 'sd' WHEN 1 THEN 'cmdk' ELSE 'st' END AS module,
         CASE n.user_id % 4 WHEN 0 THEN 'net' || n.user_id WHEN 1 THEN 'vm' ELSE 'sd' || n.user_id END AS name,
         CASE WHEN n.user_id % 5 <> 0 THEN 'zone' || n.user_id ELSE 'global' END AS zonename, {DELTAS}
  FROM daily n JOIN daily o ON o.user_id = n.user_id AND o.read_no = n.read_no - 1)"""


def paired(t):
    return k.pair_reads(snapshots(t), ["user_id"])


def sql(body: str) -> str:
    return with_p(body, DAILY, PAIRS)


@query("k01_pair_snapshots", sql("SELECT user_id, read_no, interval FROM pairs"))
def k01(t):
    return paired(t).select("user_id", "read_no", k.interval().alias("interval"))


@query("k02_delta", sql("SELECT user_id, read_no, CAST(d_cents AS DOUBLE) AS value FROM pairs"))
def k02(t):
    assert BASE_OF["ipackets64"] == "cents"
    return paired(t).select("user_id", "read_no", k.delta("ipackets64").alias("value"))


RATE = "floor(100 * (d_cents * 1e9::DOUBLE) / interval)"


@query("k03_percent_rate", sql(f"SELECT user_id, read_no, {RATE} AS value FROM pairs"))
def k03(t):
    return paired(t).select("user_id", "read_no", k.percent_rate("cpu_nsec_kernel").alias("value"))


@query("k04_sum_of_counters", sql("SELECT user_id, read_no, CAST(d_cents + d_ks AS DOUBLE) AS value FROM pairs"))
def k04(t):
    return paired(t).select("user_id", "read_no", k.delta("ipackets64", "opackets64").alias("value"))


@query("k05_unpivot", sql("""
SELECT user_id, read_no, 'sent' AS direction, CAST(d_cents AS DOUBLE) AS value FROM pairs
UNION ALL SELECT user_id, read_no, 'received', CAST(d_ks AS DOUBLE) FROM pairs"""))
def k05(t):
    points = k.unpivot(paired(t), "direction", {"sent": k.delta("ipackets64"), "received": k.delta("opackets64")})
    return points.select("user_id", "read_no", "direction", "value")


@query("k06_residual", sql("""
SELECT user_id, read_no, CAST(d_events - d_views - d_clicks - d_purchases AS DOUBLE) AS value FROM pairs"""))
def k06(t):
    other = next(n for n, b in BASE_OF.items() if b == "events")
    parts = [next(n for n, b in BASE_OF.items() if b == want) for want in ("views", "clicks", "purchases")]
    return paired(t).select("user_id", "read_no", k.residual(other, *parts).alias("value"))


@query("k07_resource_count", sql(f"SELECT {RATE} AS lo, max({RATE}) AS hi, CAST(count(*) AS DOUBLE) AS value FROM pairs GROUP BY 1"))
def k07(t):
    """Heatmap of devices: each counts 1 at its utilization."""
    points = k.points(paired(t), F.lit(1), k.percent_rate("cpu_nsec_kernel").alias("utilization"))
    return decompose(points, rng=linear(1)(F.col("utilization")))


@query("k08_gauge", sql("SELECT user_id, read_no, CAST(cents AS DOUBLE) AS value FROM pairs"))
def k08(t):
    return paired(t).select("user_id", "read_no", k.now("ipackets64").alias("value"))


@query("k09_no_limit", sql("SELECT user_id, read_no, CAST(cents AS DOUBLE) AS value FROM pairs WHERE user_id % 3 = 2 AND cents <> 0"))
def k09(t):
    return k.points(paired(t), k.limit("physcap"), "user_id", "read_no")


LOAD_BASE = BASE_OF["avenrun_1min"]


@query("k10_fixed_point", sql(f"SELECT user_id, read_no, {LOAD_BASE} / 256::DOUBLE AS value FROM pairs"))
def k10(t):
    return paired(t).select("user_id", "read_no", k.load_average("avenrun_1min").alias("value"))


# --- storage, processes, collector --------------------------------------------------

STORAGE = """st AS (
  SELECT 'zones/zone' || c_custkey AS name, 'host' || (c_custkey % 10) AS hostname, 1704067200 + c_custkey % 86400 AS t,
         CASE WHEN c_acctbal > 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) ELSE 0 END AS quota,
         c_custkey * 3 AS used, c_custkey AS usedbychildren,
         c_custkey * 2 AS free, c_custkey * 5 AS allocated, c_custkey * 7 AS size FROM customer)"""


def storage(t):
    c = F.col("c_custkey")
    return t.customer.select(
        F.concat(F.lit("zones/zone"), c).alias("name"),
        F.concat(F.lit("host"), c % 10).alias("hostname"),
        (F.lit(1704067200) + c % DAY).alias("t"),
        F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal") * 100).cast("bigint")).otherwise(0).alias("quota"),
        (c * 3).alias("used"), c.alias("usedbychildren"),
        (c * 2).alias("free"), (c * 5).alias("allocated"), (c * 7).alias("size"),
    )


@query("k11_storage", "WITH " + STORAGE + """
SELECT name, 'unused' AS kind, CAST(quota - used AS DOUBLE) AS value FROM st WHERE quota <> 0
UNION ALL SELECT name, 'used', CAST(used - usedbychildren AS DOUBLE) FROM st
UNION ALL SELECT name, 'quota', CAST(quota AS DOUBLE) FROM st WHERE quota <> 0""")
def k11(t):
    kinds = {"unused": k.unused_quota(), "used": k.own_used(), "quota": k.quota()}
    return k.unpivot(storage(t), "kind", kinds).select("name", "kind", "value")


def processes(t):
    """Every customer is a process of its nation's zone."""
    c = F.col("c_custkey")
    text = lambda p, n: F.concat(F.lit(p), n)
    return t.customer.select(
        (F.lit(1704067200) + c % DAY).alias("t"),
        text("host", c % 10).alias("hostname"), text("exec", c % 17).alias("execname"),
        c.cast("string").alias("pid"), (c % 31).cast("string").alias("ppid"), text("c", c % 5).alias("contract"),
        F.col("c_name").alias("psargs"), F.when(c % 2 == 0, "32-bit").otherwise("64-bit").alias("pmodel"),
        text("zone", F.col("c_nationkey")).alias("zonename"), (c * 1024).alias("rss"), (c % 400).alias("nthreads"),
    )


@query("k12_process_points", "SELECT CAST(c_custkey AS VARCHAR) AS pid, 'exec' || (c_custkey % 17) AS execname, c_custkey * 1024 AS rss, CAST(1 AS DOUBLE) AS value FROM customer")
def k12(t):
    return PROCESSES.points(processes(t), ["pid", "execname", "rss"]).drop("t")


@query("k13_event_points", with_p("SELECT event_id, source AS hostname, CAST(1 AS DOUBLE) AS value FROM p"))
def k13(t):
    return k.stamp_source(t.points, F.col("source")).select("event_id", "hostname", "value")


# --- every counter metric over its records --------------------------------------------


def d(counter: str) -> str:
    if counter in NS_COUNTERS:
        i = NS_COUNTERS.index(counter)
        return f"(d_{BASES[i % 2]} * {1e9 * (1 + i % 2)!r}::DOUBLE)"
    return f"d_{BASE_OF[counter]}"


def rate(*counters: str) -> str:
    return f"floor(100 * ({' + '.join(d(c) for c in counters)}) / interval)"


NIC = "regexp_full_match(name, '(e1000g|bnx|igb|ixgbe|net)[0-9]+')"
VNIC = "zonename <> 'global'"
DISK = "module IN ('sd', 'cmdk')"
IO = {"read": d("reads"), "write": d("writes")}
IO_BYTES = {"read": d("nread"), "write": d("nwritten")}
BYTES = {"sent": d("obytes64"), "received": d("rbytes64")}
PACKETS = {"sent": d("opackets64"), "received": d("ipackets64")}
EXITS = {n: d(c) for n, c in VM_EXITS.items()}

# metric -> (dimensions, record filter, {mode: value} or value, numeric expression and its buckets)
METRIC_SQL = {
    "cpu.cpus": (("cpu", "utilization"), "true", "1", (rate("cpu_nsec_kernel", "cpu_nsec_user"), None)),
    "cpu.usage": (("cpumode",), "true", {"kernel": rate("nsec_sys"), "user": rate("nsec_user")}, None),
    "cpu.waittime": (("zonename",), "true", d("nsec_waitrq"), None),
    "cpu.loadavg1": (("zonename",), "true", f"{LOAD_BASE} / 256::DOUBLE", None),
    "nic.nics": (("nic", "bytes"), NIC, "1", (f"({d('rbytes64')} + {d('obytes64')})", 2)),
    "nic.bytes": (("direction",), NIC, BYTES, None),
    "nic.packets": (("direction",), NIC, PACKETS, None),
    "nic.vnic_bytes": (("direction",), VNIC, BYTES, None),
    "nic.vnic_packets": (("direction",), VNIC, PACKETS, None),
    "disk.disks": (("disk", "iops"), DISK, "1", (f"({d('reads')} + {d('writes')})", 0)),
    "disk.physio_ops": (("optype",), DISK, IO, None),
    "disk.physio_bytes": (("optype",), DISK, IO_BYTES, None),
    "tcp.segments": (("direction",), "true", {"sent": d("outSegs"), "received": d("inSegs")}, None),
    "tcp.errors": (("errtype",), "true", {text: d(c) for c, text in TCP_ERRORS.items()}, None),
    "fs.logical_rwops": (("optype",), "true", IO, None),
    "fs.logical_rwbytes": (("optype",), "true", IO_BYTES, None),
    "memory.rss": (("zonename",), "true", BASE_OF["rss"], None),
    "memory.rss_limit": (("zonename",), "user_id % 3 = 2 AND cents <> 0", "cents", None),
    "memory.swap": (("zonename",), "true", BASE_OF["swap"], None),
    "memory.swap_limit": (("zonename",), "user_id % 3 = 2 AND cents <> 0", "cents", None),
    "memory.reclaimed_bytes": (("zonename",), "true", d("pagedout"), None),
    "memory.pageins": (("zonename",), "true", d("pgpgin"), None),
    "vm.exits": (
        ("vleavereason",), "name <> 'vm'",
        {**EXITS, "other": f"({d('exits')} - {' - '.join(EXITS.values())})"}, None,
    ),
    "zfs.arc_ops": (("optype",), "true", {"hit": d("hits"), "miss": d("misses")}, None),
}
KEY_SQL = {"cpu": "'cpu' || user_id", "nic": "name", "disk": "name", "zonename": "zonename"}


def first_reports(rows: str, width: int = DAY) -> str:
    """Of rows with t and hostname those of each host's first second in a slot; no other one counts for a reading."""
    slot = f"t - t % {width}"
    return (
        f"SELECT * FROM (SELECT *, {slot} AS slot, min(t) OVER (PARTITION BY hostname, {slot}) AS first_t FROM ({rows}))"
        " WHERE t = first_t"
    )


def point_metric_sql(dims, where, value, numeric) -> str:
    modes = value if isinstance(value, dict) else {None: value}
    rows = " UNION ALL ".join(
        f"SELECT t, hostname, {repr(mode) if mode else KEY_SQL[dims[0]]} AS key, CAST({v} AS DOUBLE) AS value,"
        f" {f'CAST({numeric[0]} AS DOUBLE)' if numeric else 'NULL'} AS v FROM pairs WHERE {where}"
        for mode, v in modes.items()
    )
    first = first_reports(f"SELECT * FROM ({rows}) WHERE value IS NOT NULL")
    if numeric is None:
        return sql(f"SELECT slot, key, sum(value) AS value FROM ({first}) GROUP BY 1, 2")
    low = numeric[1]
    lo = "floor(v)" if low is None else sql_log_linear("v", low)
    hi = "floor(v)" if low is None else sql_log_linear("v", low, hi=True)
    return sql(f"SELECT slot, key, {lo} AS lo, max({hi}) AS hi, sum(value) AS value FROM ({first}) GROUP BY 1, 2, 3")


def metric_sql(dims, where, value, numeric) -> str:
    modes = value if isinstance(value, dict) else None
    if modes:
        rows = " UNION ALL ".join(
            f"SELECT t, '{mode}' AS key, CAST({v} AS DOUBLE) AS value FROM pairs WHERE {where}" for mode, v in modes.items()
        )
        return sql(f"SELECT t - t % 86400 AS slot, key, sum(value) AS value FROM ({rows}) GROUP BY 1, 2")
    key = KEY_SQL[dims[0]]
    if numeric is None:
        return sql(
            f"SELECT t - t % 86400 AS slot, {key} AS key, sum(CAST({value} AS DOUBLE)) AS value FROM pairs WHERE {where} GROUP BY 1, 2"
        )
    expr, low = numeric
    lo = f"floor({expr})" if low is None else sql_log_linear("v", low)
    hi = f"floor({expr})" if low is None else sql_log_linear("v", low, hi=True)
    return sql(
        f"SELECT t - t % 86400 AS slot, {key} AS key, {lo} AS lo, max({hi}) AS hi, sum(CAST({value} AS DOUBLE)) AS value"
        f" FROM (SELECT *, CAST({expr} AS DOUBLE) AS v FROM pairs WHERE {where}) GROUP BY 1, 2, 3"
    )


def as_records(rows, record):
    """The given snapshots as the records a metric reads."""
    return rows.withColumns({column: F.lit(value) for column, value in record.items()})


def daily_spec(metric, dims):
    return Instrumentation(metric.module, metric.stat, decomposition=dims, granularity=DAY, retention=0)


def _register(definition):
    name = f"{definition.module}.{definition.stat}"
    dims, where, value, numeric = METRIC_SQL[name]

    text = (point_metric_sql if definition.scope == "point" else metric_sql)(dims, where, value, numeric)

    @query("m_" + name.replace(".", "_") + "_counters", text)
    def _(t):
        metric = definition.metric()
        return instrument(as_records(snapshots(t), definition.record), metric, daily_spec(metric, dims))


for _definition in COUNTER_METRICS:
    _register(_definition)

SCOPED = {"and": [{"eq": ["zonename", "zone7"]}, {"ne": ["hostname", "host3"]}]}


@query("m_cpu_waittime_counters_scoped", sql(f"""
SELECT t - t % 86400 AS slot, sum(CAST({d('nsec_waitrq')} AS DOUBLE)) AS value FROM pairs
WHERE zonename = 'zone7' AND hostname <> 'host3' GROUP BY 1"""))
def waittime_scoped(t):
    """Conditions on a record's zone and host are checked before its readings are paired."""
    definition = next(m for m in COUNTER_METRICS if (m.module, m.stat) == ("cpu", "waittime"))
    spec = Instrumentation("cpu", "waittime", SCOPED, granularity=DAY, retention=0)
    return instrument(as_records(snapshots(t), definition.record), definition.metric(), spec)


STORAGE_SQL = {
    "dataset_unused_quota": ("quota - used", "quota <> 0"),
    "dataset_used": ("used - usedbychildren", "true"),
    "dataset_quota": ("quota", "quota <> 0"),
    "pool_free": ("free", "true"),
    "pool_used": ("allocated", "true"),
    "pool_total": ("size", "true"),
}


def _register_storage(metric):
    value, where = STORAGE_SQL[metric.stat]

    rows = f"SELECT t, hostname, CAST({value} AS DOUBLE) AS value FROM st WHERE {where}"

    @query(f"m_zfs_{metric.stat}", "WITH " + STORAGE + f"""
SELECT slot, hostname AS key, sum(value) AS value FROM ({first_reports(rows)}) GROUP BY 1, 2""")
    def _(t):
        return instrument(storage(t), metric, daily_spec(metric, ("hostname",)))


for _metric in STORAGE_METRICS:
    _register_storage(_metric)


@query("m_unix_processes", f"""
SELECT 1704067200 AS slot, 'exec' || (c_custkey % 17) AS key, {sql_log_linear('v', 1, n=1000)} AS lo,
       max({sql_log_linear('v', 1, n=1000, hi=True)}) AS hi, CAST(count(*) AS DOUBLE) AS value
FROM (SELECT c_custkey, CAST(c_custkey % 400 AS DOUBLE) AS v FROM customer) GROUP BY 2, 3""".replace("1704067200 AS", "CAST(1704067200 AS BIGINT) AS"))
def m_processes(t):
    return instrument(processes(t), PROCESSES, daily_spec(PROCESSES, ("execname", "nthreads")))


COLLECTOR_EVENTS = {"instr_tick": "view", "instr_backend_op": "click", "instr_backend_enable": "purchase", "instr_backend_disable": "signup"}


def _register_collector(metric, event):
    @query(f"m_ca_{metric.stat}", with_p(f"""
SELECT t - t % 86400 AS slot, source AS key, {sql_log_linear('latency')} AS lo, max({sql_log_linear('latency', hi=True)}) AS hi,
       CAST(count(*) AS DOUBLE) AS value FROM p WHERE optype = '{COLLECTOR_EVENTS[event]}' GROUP BY 1, 2, 3"""))
    def _(t):
        names = {v: n for n, v in COLLECTOR_EVENTS.items()}
        table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
        rows = t.points.withColumns({"event": table[F.col("optype")], "hostname": F.col("source")})
        return instrument(rows, metric, daily_spec(metric, ("hostname", "latency")))


for _metric, _event in zip(COLLECTOR_METRICS, COLLECTOR_EVENTS):
    _register_collector(_metric, _event)
