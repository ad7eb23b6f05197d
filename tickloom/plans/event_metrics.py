"""Metrics derived from probe events.

Event table: ``ts_ns, vts_ns, seq, host, probe, thread_id, pid, req_key``, the
process context (``zonename, execname, psargs, ppid, pexecname, ppsargs``) and
``args MAP<STRING,STRING>`` with the probe's named arguments.  ``stack_depth``
is needed where calls nest (``fs``): a call ends at the depth it began at.

A :class:`Dim` says how a field is read at the done (or only) event and what
has to be gathered at the start for it.  A spec that names no gathered field
counts every done event without pairing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.buckets import Bucketizer, event_linear, event_log_linear, subsecond_ms
from ..operators import pairing
from ..operators.nesting import outermost_by_depth
from .spec import FieldDef, Metric

Expr = Callable[[], Column]

THREAD = ("host", "thread_id")
REQUEST = ("host", "pid", "req_key")
BUFFER = ("host", "req_key")

PROCESS = ("hostname", "zonename", "pid", "execname", "psargs")
FAMILY = (*PROCESS, "ppid", "pexecname", "ppsargs")
ZONE = ("hostname", "zonename")
HOST = ("hostname",)

# --- fixed values: probe lists and allow lists ------------------------------------
LDAP_OPS = ["add", "bind", "compare", "delete", "exop", "modify", "modifydn", "search", "unbind"]
SQL_STATEMENTS = ["select", "insert", "insert-select", "update", "multi-update", "delete", "multi-delete"]
STORE_OPS = ["delobject", "findobjects", "getobject", "putobject", "update"]
FILE_CALLS = [
    "read", "write", "ioctl", "access", "getattr", "setattr", "lookup", "create", "remove", "link", "rename",
    "mkdir", "rmdir", "readdir", "symlink", "readlink", "fsync", "getpage", "putpage", "map", "open",
]
FILESYSTEMS = ["ufs", "zfs", "dev", "dev fs", "proc", "lofs", "tmpfs", "nfs"]
DISK_DRIVERS = ["sd", "cmdk"]
INET_FAMILIES = ["AF_INET", "AF_INET6"]
GUEST_EXECNAME = "qemu-system-x86_"
IDLE_PRIORITY = -1
# -----------------------------------------------------------------------------------

TIME = event_log_linear(10, 3, 11, 100)
SIZE = event_log_linear(10, 0, 11, 100)
SUBSECOND = event_linear(0, 1000, 10)


@dataclass(frozen=True)
class Dim:
    expr: Expr
    bucket: Bucketizer | None = None
    gather: Mapping[str, Expr] = field(default_factory=dict)
    optional: bool = False


def arg(name: str) -> Column:
    return F.col("args")[name]


def number(name: str) -> Column:
    """NULL for an argument that is no whole number: one bad event must not end the job."""
    return arg(name).try_cast("bigint")


def at_done(*names: str) -> dict[str, Dim]:
    return {n: Dim(lambda n=n: arg(n)) for n in names}


def at_start(*names: str) -> dict[str, Dim]:
    return {n: Dim(lambda n=n: F.col(f"start_{n}"), gather={f"start_{n}": lambda n=n: arg(n)}) for n in names}


def size_at_done(bucket: Bucketizer, *names: str) -> dict[str, Dim]:
    return {n: Dim(lambda n=n: number(n), bucket) for n in names}


def size_at_start(bucket: Bucketizer, name: str) -> dict[str, Dim]:
    return {name: Dim(lambda: F.col(f"start_{name}"), bucket, {f"start_{name}": lambda: number(name)})}


def derived(name: str, expr: Expr) -> dict[str, Dim]:
    return {name: Dim(expr)}


def derived_at_start(name: str, expr: Expr) -> dict[str, Dim]:
    return {name: Dim(lambda: F.col(f"start_{name}"), gather={f"start_{name}": expr})}


START_TS = {"start_ts": lambda: F.col("ts_ns")}
LATENCY = {"latency": Dim(pairing.latency, TIME, START_TS)}
CPUTIME = {"cputime": Dim(pairing.cpu_time, TIME, {"start_vts": lambda: F.col("vts_ns")})}
RUNTIME = {"runtime": Dim(pairing.latency, TIME, START_TS)}
SUBSECOND_NOW = {"subsecond": Dim(lambda: subsecond_ms(F.col("ts_ns")), SUBSECOND)}
SUBSECOND_START = {"subsecond": Dim(lambda: subsecond_ms(F.col("start_ts")), SUBSECOND, START_TS)}
QUERY_PREFIX = lambda name, n: derived_at_start(name, lambda: sc.query_prefix(arg("query"), n))
STATUS = derived("status", lambda: sc.status_label(number("code")))
READ_WRITE = derived("optype", lambda: F.when(number("direction") != 1, "read").otherwise("write"))


def matches(patterns: Sequence[str]) -> Column:
    """Probe name in a list; ``*`` stands for the provider's instance."""
    exact = [p for p in patterns if "*" not in p]
    globs = [p.replace("_", r"\_").replace("*", "%") for p in patterns if "*" in p]
    return reduce(lambda a, b: a | b, [*([F.col("probe").isin(exact)] if exact else []), *map(F.col("probe").like, globs)])


@dataclass(frozen=True)
class EventMetric:
    module: str
    stat: str
    context: Sequence[str]
    pairs: Sequence[tuple[Sequence[str], Sequence[str]]]
    key: Sequence[str] = THREAD
    dims: Mapping[str, Dim] = field(default_factory=dict)
    value: Expr = lambda: F.lit(1.0)
    only: Expr | None = None  # rows that exist at all for this metric
    qualified: Expr | None = None  # dones that count; the others still clear
    always: Mapping[str, Expr] = field(default_factory=dict)
    style: str = "pair"  # "pair" | "outermost" | "phases"

    def _finished(self, events: DataFrame, gather: dict, required: bool) -> DataFrame:
        rows = events if self.only is None else events.filter(self.only())
        line = pairing.timeline(self.key)
        columns = {n: e() for n, e in gather.items()}
        parts = []
        for starts, dones in self.pairs:
            if not starts:
                parts.append(rows.filter(matches(dones)))
            elif self.style == "outermost" and "stack_depth" in rows.columns:
                parts.append(
                    outermost_by_depth(rows, line, matches(starts), matches(dones), F.col("stack_depth"), columns)
                )
            elif self.style == "outermost":  # without depths nesting can only be counted
                parts.append(pairing.outermost(rows, line, matches(starts), matches(dones), columns))
            else:
                parts.append(
                    pairing.pair(rows, line, matches(starts), matches(dones), columns, require_start=required)
                )
        return reduce(lambda a, b: a.unionByName(b), parts)

    def points(self, events: DataFrame, names: Sequence[str]) -> DataFrame:
        used = {n: self.dims[n] for n in names if n in self.dims}
        gather: dict = dict(self.always)
        for dim in used.values():
            gather |= dim.gather
        required = bool(self.always) or any(d.gather and not d.optional for d in used.values())
        if self.style == "phases":
            rows = _query_phases(events, self.key, gather)
        else:
            rows = self._finished(events, gather, required)
        if self.qualified is not None:
            rows = rows.filter(self.qualified())
        plain = {"hostname": F.col("host"), "pid": sc.decimal_id(F.col("pid"))}
        dims = [
            (used[n].expr() if n in used else plain.get(n, F.col(n))).alias(n) for n in names
        ]
        t = F.floor(F.col("ts_ns") / F.lit(1_000_000_000)).cast("bigint").alias("t")
        return rows.select(t, *dims, self.value().cast("double").alias("value"))

    def metric(self) -> Metric:
        fields = {n: FieldDef() for n in self.context} | {n: FieldDef(d.bucket) for n, d in self.dims.items()}
        # a thread, request or buffer stays on its host; a derived zone is known at the end only
        early = {"hostname": "host"}
        if "zonename" not in self.dims and self.key == THREAD:
            early["zonename"] = "zonename"
        return Metric(self.module, self.stat, fields, self.points, source="events", early=early)


def _query_phases(events: DataFrame, key: Sequence[str], gather: Mapping[str, Expr]) -> DataFrame:
    """Logical queries: parsed (query + exec), cached (query only) and prepared
    (exec only) ones count once each.

    The end of an exec inside a query is neither counted nor an end.
    """
    line = pairing.timeline(key)
    query, query_done = matches(["mysql*:::query-start"]), matches(["mysql*:::query-done"])
    run, run_done = matches(["mysql*:::query-exec-start"]), matches(["mysql*:::query-exec-done"])
    rows = events.filter(query | query_done | run | run_done)
    rows = pairing.outside(rows, line, query, query_done, run_done)
    rest = {c: F.col(c) for c in rows.columns if c not in key}
    ops = pairing.classify_phases(
        rows,
        line,
        {1: query, 2: run},
        query_done | run_done,
        rest,
        resets=(1,),
        gather={n: e() for n, e in gather.items()} or {"start_ts": F.col("ts_ns")},
    )
    # A query-done without its query-start (only an exec phase) does not count.
    return ops.filter((F.col("mask").bitwiseAND(1) == 1) | matches(["mysql*:::query-exec-done"])).drop("op")


def single(module: str, stat: str, context, probes, dims: Mapping[str, Dim] | None = None, **more) -> EventMetric:
    return EventMetric(module, stat, context, [((), tuple(probes))], dims=dims or {}, **more)


def paired(module: str, stat: str, context, start, done, key, dims: Mapping[str, Dim], **more) -> EventMetric:
    starts = (start,) if isinstance(start, str) else tuple(start)
    dones = (done,) if isinstance(done, str) else tuple(done)
    return EventMetric(module, stat, context, [(starts, dones)], key, dims, **more)


def suffixed(provider: str, names: Sequence[str], suffix: str, prefix: str = "") -> list[str]:
    return [f"{provider}*:::{prefix}{n}-{suffix}" for n in names]


def probe_name() -> Column:
    return F.substring_index("probe", ":", -1)


def file_optype() -> Column:
    """``fbt::fop_read:return`` -> ``read``."""
    return F.regexp_extract("probe", r"fop_(\w+):", 1)


def allowed_filesystem() -> Column:
    return F.col("start_fstype").isin(*FILESYSTEMS)


def _supervisor(stat: str, probe: str, who: str) -> EventMetric:
    return paired(
        "mantaop", stat, ZONE, f"marlin-supervisor*:::{probe}-start", f"marlin-supervisor*:::{probe}-done",
        REQUEST, {**derived(who, lambda: F.col("req_key")), **at_done("errname"), **LATENCY},
    )


def _tcp(stat: str, call: str, accepted: Expr) -> EventMetric:
    return paired(
        "tcp", stat, FAMILY, f"syscall::{call}:entry", f"syscall::{call}:return", THREAD,
        at_done("rport", "raddr"),
        always={"start_ts": lambda: F.col("ts_ns")},
        qualified=lambda: accepted() & arg("family").isin(*INET_FAMILIES),
    )


def _http_path() -> Column:
    return sc.url_path(arg("http_url"))


FILE_ALWAYS = {"start_fstype": lambda: arg("fstype")}
FILE_DIMS = {"fstype": Dim(lambda: F.col("start_fstype")), "optype": Dim(file_optype), **LATENCY}

EVENT_METRICS = [
    paired(
        "apache", "httpd_ops", FAMILY, "httpd*:::request-start", "httpd*:::request-done", THREAD,
        {**at_done("http_method", "http_url", "raddr", "rport"), **derived("http_path", _http_path), **LATENCY},
    ),
    paired(
        "cpu", "thread_executions", FAMILY, "sched:::on-cpu", "sched:::off-cpu", THREAD,
        {
            **derived("leavereason", lambda: sc.label(arg("state"), sc.RUN_STATES, sc.RUN_STATE_UNKNOWN)),
            **RUNTIME, **SUBSECOND_START,
        },
        only=lambda: number("pri") != IDLE_PRIORITY,
    ),
    single(
        "cpu", "thread_samples", FAMILY, ["profile:::profile-99hz"], SUBSECOND_NOW,
        only=lambda: number("pri") != IDLE_PRIORITY,
    ),
    paired(
        "disk", "physio_ops", HOST, "io:::start", "io:::done", BUFFER,
        {
            **at_done("disk", "optype"), **LATENCY, **size_at_done(TIME, "size"), **size_at_done(SIZE, "offset"),
        },
        qualified=lambda: arg("driver").isin(*DISK_DRIVERS),
    ),
    paired(
        "fs", "logical_ops", FAMILY, [f"fbt::fop_{c}:entry" for c in FILE_CALLS],
        [f"fbt::fop_{c}:return" for c in FILE_CALLS], THREAD, FILE_DIMS,
        always=FILE_ALWAYS, qualified=allowed_filesystem, style="outermost",
    ),
    paired(
        "fs", "logical_rwops", FAMILY, ["fbt::fop_read:entry", "fbt::fop_write:entry"],
        ["fbt::fop_read:return", "fbt::fop_write:return"], THREAD,
        {
            **FILE_DIMS,
            **size_at_start(event_log_linear(2, 0, 25, 32), "size"),
            **size_at_start(event_log_linear(10, 0, 12, 100), "offset"),
        },
        always=FILE_ALWAYS, qualified=allowed_filesystem, style="outermost",
    ),
    single("ldapjs", "connections", PROCESS, ["ldapjs*:::server-connection"], at_done("raddr")),
    paired(
        "ldapjs", "ops", PROCESS, suffixed("ldapjs", LDAP_OPS, "start", "server-"),
        suffixed("ldapjs", LDAP_OPS, "done", "server-"), REQUEST,
        {
            **at_done("raddr", "ldapbinddn", "ldaprequestdn", "status"),
            **derived("optype", lambda: sc.after_prefix(probe_name(), "server-")), **LATENCY,
        },
    ),
    paired(
        "ldapjs", "search_ops", PROCESS, "ldapjs*:::server-search-start", "ldapjs*:::server-search-done", REQUEST,
        {
            **at_done("raddr", "ldapbinddn", "ldaprequestdn", "status"), **at_start("ldapfilter", "ldapscope"),
            **LATENCY,
        },
    ),
    single("mantaop", "jobs_assigned", ZONE, ["marlin-supervisor*:::job-assigned"]),
    _supervisor("supervisor_auths", "auth", "user"),
    _supervisor("supervisor_deletes", "delete", "objname"),
    _supervisor("supervisor_locates", "locate", "objname"),
    single("mantaop", "supervisor_errors", ZONE, ["marlin-supervisor*:::error-dispatched"], at_done("jobid")),
    single("mantaop", "tasks_committed", ZONE, ["marlin-supervisor*:::task-committed"], at_done("jobid")),
    single("mantaop", "tasks_dispatched", ZONE, ["marlin-supervisor*:::task-dispatched"], at_done("jobid")),
    paired(
        "mantaop", "tasks_executed", HOST, "marlin-agent*:::task-dispatched", "marlin-agent*:::task-done", REQUEST,
        {**at_done("jobid"), **LATENCY},
    ),
    single("mantaop", "tasks_killed", HOST, ["marlin-agent*:::task-killed"], at_done("jobid")),
    paired(
        "mantaop", "zone_resets", HOST, "marlin-agent*:::zone-reset-start", "marlin-agent*:::zone-reset-done",
        REQUEST, {**derived("zonename", lambda: F.col("req_key")), **at_done("errname"), **LATENCY},
    ),
    EventMetric(
        "moray", "ops", PROCESS,
        [
            (suffixed("moray", STORE_OPS, "start"), suffixed("moray", STORE_OPS, "done")),
            (["moray*:::batch-op-start"], ["moray*:::batch-op-done"]),
        ],
        REQUEST,
        {
            # Operations of a batch name their type in an argument.
            **derived_at_start(
                "optype",
                lambda: F.when(F.col("probe").like("%batch-op-start"), arg("optype")).otherwise(
                    F.substring_index(probe_name(), "-", 1)
                ),
            ),
            **at_start("table"), **LATENCY, **CPUTIME,
        },
    ),
    paired(
        "moray", "queries", PROCESS, "moray*:::query-start", "moray*:::query-done", REQUEST,
        {**QUERY_PREFIX("querysubstr", 10), **LATENCY, **CPUTIME},
    ),
    paired(
        "mysql", "commands", PROCESS, "mysql*:::command-start", "mysql*:::command-done", THREAD,
        {**at_start("command", "user", "client"), **STATUS, **LATENCY, **CPUTIME},
    ),
    paired(
        "mysql", "connections", PROCESS, "mysql*:::connection-start", "mysql*:::connection-done", THREAD,
        {**at_start("user", "client"), **LATENCY},
    ),
    paired(
        "mysql", "filesort", PROCESS, "mysql*:::filesort-start", "mysql*:::filesort-done", THREAD,
        {
            **at_start("database"),
            **derived_at_start("table", lambda: F.substring_index(arg("table"), "#", 1)), **LATENCY, **CPUTIME,
        },
    ),
    EventMetric(
        "mysql", "queries", PROCESS, [], THREAD,
        {
            **QUERY_PREFIX("querysubstr", 6), **at_start("database", "user", "client"),
            **derived("parsed", lambda: F.when(F.col("mask") == 3, "yes").otherwise("no")),
            **STATUS, **LATENCY, **CPUTIME,
        },
        style="phases",
    ),
    paired(
        "mysql", "statements", PROCESS, suffixed("mysql", SQL_STATEMENTS, "start"),
        suffixed("mysql", SQL_STATEMENTS, "done"), THREAD,
        {
            **derived("statement", lambda: sc.before_last_dash(probe_name())), **STATUS,
            "rowsmatched": Dim(lambda: number("matched"), event_log_linear(10, 0, 7, 100)),
            "rowschanged": Dim(
                lambda: sc.rows_changed(probe_name(), number("changed")), event_log_linear(10, 0, 7, 100)
            ),
            **LATENCY, **CPUTIME,
        },
    ),
    paired(
        "node", "gc_ops", FAMILY, "node*:::gc-start", "node*:::gc-done", THREAD,
        {**derived("gctype", lambda: sc.label(number("type"), sc.GC_TYPES, sc.GC_TYPE_BOTH)), **LATENCY},
    ),
    paired(
        "node", "httpc_ops", FAMILY, "node*:::http-client-request", "node*:::http-client-response", REQUEST,
        {
            **at_start("http_method", "http_url"), **derived_at_start("http_path", _http_path),
            **at_done("raddr", "rport"), **LATENCY,
        },
    ),
    paired(
        "node", "httpd_ops", FAMILY, "node*:::http-server-request", "node*:::http-server-response", REQUEST,
        {
            **at_start("http_method", "http_url"), **derived_at_start("http_path", _http_path),
            # A request without forwarding header, or without a seen start, shows its peer.
            "http_origin": Dim(
                lambda: sc.request_origin(F.coalesce("start_forwarded", F.lit("")), arg("raddr")),
                gather={"start_forwarded": lambda: arg("forwarded_for")}, optional=True,
            ),
            **at_done("raddr", "rport"), **LATENCY,
        },
    ),
    single(
        "node", "socket_ops", FAMILY, ["node*:::net-socket-read", "node*:::net-socket-write"],
        {
            **derived(
                "optype", lambda: F.when(F.col("probe").like("%net-socket-read"), "read").otherwise("write")
            ),
            **at_done("raddr", "rport"), **size_at_done(SIZE, "size", "buffered"),
        },
    ),
    paired(
        "postgres", "queries", PROCESS, "postgres*:::query-start", "postgres*:::query-done", THREAD,
        {**QUERY_PREFIX("querysubstr", 10), **LATENCY, **CPUTIME},
    ),
    single("unix", "proc_execs", FAMILY, ["proc:::exec-success"], SUBSECOND_NOW),
    single(
        "unix", "proc_exits", FAMILY, ["proc:::exit"],
        {
            **SUBSECOND_NOW,
            "walltime": Dim(lambda: F.col("ts_ns") - number("started"), event_log_linear(10, 7, 15, 100)),
        },
    ),
    single("unix", "proc_forks", (*PROCESS, "ppid"), ["proc:::create"], SUBSECOND_NOW),
    paired(
        "restify", "handler_ops", FAMILY, "restify*:::handler-start", "restify*:::handler-done", REQUEST,
        {**at_done("restify_sname", "restify_rname", "restify_hname"), **LATENCY},
    ),
    paired(
        "restify", "server_ops", FAMILY, "restify*:::route-start", "restify*:::route-done", REQUEST,
        {
            **at_done("restify_sname", "restify_rname", "http_status"), **at_start("http_url", "http_method"),
            **LATENCY,
        },
    ),
    paired(
        "syscall", "syscalls", FAMILY, "syscall::*:entry", "syscall::*:return", THREAD,
        {
            **derived("syscall", lambda: F.regexp_extract("probe", r"^syscall::(\w+):", 1)),
            **SUBSECOND_START, **LATENCY, **CPUTIME,
        },
    ),
    _tcp("accepts", "accept", lambda: number("result") >= 0),
    _tcp("connects", "connect", lambda: number("result") == 0),
    single("unix", "thr_creates", FAMILY, ["proc:::lwp-create"], SUBSECOND_NOW),
    single(
        "vm", "irqs", ZONE, ["sdt:::kvm-inj-virq"],
        {**SUBSECOND_NOW, **derived("irqvector", lambda: sc.hex_id(number("vector").bitwiseAND(0xFF)))},
    ),
    single("vm", "physio_bytes", ZONE, ["sdt:::zvol-uio-start"], READ_WRITE, value=lambda: number("bytes")),
    paired(
        "vm", "physio_ops", ZONE, "sdt:::zvol-uio-start", "sdt:::zvol-uio-done", THREAD,
        {
            **READ_WRITE, **derived("errno", lambda: sc.hex_id(number("errno"))), **LATENCY,
            **size_at_start(TIME, "size"), **size_at_start(SIZE, "offset"),
        },
    ),
    single(
        "vm", "thread_samples", ZONE, ["profile:::profile-99hz"],
        {**SUBSECOND_NOW, **derived("vmmmuctx", lambda: sc.hex_id(number("cr3")))},
        only=lambda: F.col("execname") == GUEST_EXECNAME,
    ),
    single(
        "zfs", "arc_ops", FAMILY, ["sdt:::arc-hit", "sdt:::arc-miss"],
        derived("optype", lambda: sc.strip_prefix(probe_name(), "arc-")),
    ),
]
