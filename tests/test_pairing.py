from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import pairing as e
from tickloom.operators.nesting import outermost_by_depth
from tickloom.operators.ordered import Timeline, previous, running
from tickloom.plans.event_metrics import EVENT_METRICS
from tickloom.plans.spec import Instrumentation, instrument

SPANS = [3.0, 17.0, 1e9]  # slices of a few rows, and one slice for all


def events(seed, kinds, keys=(1, 2), n=120):
    """One key holds most of the rows; times may repeat within a key."""
    rng = random.Random(seed)
    rows, clock = [], 0
    for seq in range(n):
        clock += rng.choice([0, 1, 1, 2, 9])
        key = keys[0] if rng.random() < 0.7 else rng.choice(keys)
        rows.append((key, clock, seq, rng.choice(kinds)))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "key int, ts_ns bigint, seq bigint, kind string").repartition(5)


def line(span):
    return e.timeline(["key"], span=span)


def per_key(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("span", SPANS)
def test_previous_and_running(spark, span):
    rows = events(1, "ab")
    want_prev, want_sum, want_max = {}, {}, {}
    for mine in per_key(rows).values():
        before, total, top = None, 0, -1
        for _, ts, seq, kind in mine:
            want_prev[seq] = before
            before = seq
            total += seq
            top = max(top, ts % 7)
            want_sum[seq], want_max[seq] = total, top
    t = Timeline(["key"], ["ts_ns", "seq"], span)
    df = table(spark, rows)
    got = previous(df, t, {"p": F.col("seq")}).collect()
    assert {r["seq"]: r["p"] for r in got} == want_prev
    got = running(df, t, {"s": ("sum", F.col("seq")), "m": ("max", F.col("ts_ns") % 7)}).collect()
    assert {r["seq"]: r["s"] for r in got} == want_sum
    assert {r["seq"]: r["m"] for r in got} == want_max


def pairs_by_hand(rows, visible=lambda seq: True):
    out = {}
    for mine in per_key(rows).values():
        opened = None
        for _, ts, seq, kind in mine:
            if kind == "start":
                opened = ts
            elif kind == "done" and visible(seq):
                if opened is not None:
                    out[seq] = ts - opened
                opened = None
    return out


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize("seed", [1, 2])
def test_pairs(spark, span, seed):
    rows = events(seed, ["start", "done", "other"])
    start, done = F.col("kind") == "start", F.col("kind") == "done"
    got = e.pair(table(spark, rows), line(span), start, done, {"start_ts": F.col("ts_ns")})
    assert {r["seq"]: r["l"] for r in got.select("seq", e.latency().alias("l")).collect()} == pairs_by_hand(rows)
    even = F.col("seq") % 2 == 0
    got = e.pair(table(spark, rows), line(span), start, done & even, {"start_ts": F.col("ts_ns")}, clears=even)
    assert {r["seq"]: r["l"] for r in got.select("seq", e.latency().alias("l")).collect()} == pairs_by_hand(rows, lambda s: s % 2 == 0)
    kept = e.pair(table(spark, rows), line(span), start, done, {"start_ts": F.col("ts_ns")}, require_start=False)
    assert kept.count() == sum(r[3] == "done" for r in rows)
    assert kept.filter("start_ts is not null").count() == len(pairs_by_hand(rows))
    assert e.pair(table(spark, rows), line(span), start, done, {}).count() == sum(r[3] == "done" for r in rows)


def outermost_by_hand(rows):
    out = {}
    for mine in per_key(rows).values():
        depth, opened = 0, None
        for _, ts, seq, kind in mine:
            if kind == "enter":
                if depth == 0:
                    opened = ts
                depth += 1
            elif kind == "leave" and depth > 0:
                depth -= 1
                if depth == 0:
                    out[seq] = ts - opened
    return out


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize("seed", [3, 4])
def test_outermost(spark, span, seed):
    rows = events(seed, ["enter", "leave", "leave", "enter", "other"])
    got = e.outermost(
        table(spark, rows), line(span), F.col("kind") == "enter", F.col("kind") == "leave", {"start_ts": F.col("ts_ns")}
    )
    assert {r["seq"]: r["l"] for r in got.select("seq", e.latency().alias("l")).collect()} == outermost_by_hand(rows)


def outermost_at_depth_by_hand(rows):
    out = {}
    for mine in per_key(rows).values():
        call = None
        for _, ts, seq, kind in mine:
            name, _, depth = kind.partition(" ")
            if name == "enter" and call is None:
                call = (depth, ts)
            elif name == "leave" and call is not None and call[0] == depth:
                out[seq] = ts - call[1]
                call = None
    return out


@pytest.mark.parametrize("span", [*SPANS, 1.0])
@pytest.mark.parametrize("seed", [5, 6])
def test_outermost_by_depth(spark, span, seed):
    """Leaves are lost, doubled and out of place at random; slices begin inside calls of other slices."""
    kinds = [f"{name} {depth}" for name in ("enter", "enter", "leave") for depth in range(seed - 3)] + ["other", "enter "]
    rows = events(seed, kinds, keys=(1, 2, 3), n=300)
    depth = F.nullif(F.split("kind", " ")[1], F.lit("")).cast("int") if seed % 2 else F.split("kind", " ")[1].try_cast("int")
    got = outermost_by_depth(
        table(spark, rows), line(span), F.col("kind").startswith("enter"), F.col("kind").startswith("leave"), depth,
        {"start_ts": F.col("ts_ns")},
    )
    known = [r for r in rows if r[3] != "enter "]  # without a depth: no event
    assert {r["seq"]: r["l"] for r in got.select("seq", e.latency().alias("l")).collect()} == outermost_at_depth_by_hand(known)
    assert got.columns == ["key", "ts_ns", "seq", "kind", "start_ts"]


def test_lost_inner_leave_does_no_harm(spark):
    rows = [(1, 0, 0, "enter 5"), (1, 1, 1, "enter 7"), (1, 9, 2, "leave 5"), (1, 20, 3, "enter 5"), (1, 29, 4, "leave 5")]
    enter, leave, depth = F.col("kind").startswith("enter"), F.col("kind").startswith("leave"), F.split("kind", " ")[1].cast("int")
    found = outermost_by_depth(table(spark, rows), line(2.0), enter, leave, depth, {"start_ts": F.col("ts_ns")})
    assert sorted((r.seq, r.start_ts) for r in found.collect()) == [(2, 0), (4, 20)]
    assert outermost_by_depth(table(spark, rows), line(2.0), enter, leave, depth, {}).count() == 2
    assert outermost_by_depth(table(spark, rows).filter("false"), line(2.0), enter, leave, depth, {}).count() == 0


def queries_by_hand(rows):
    """State per thread: 0 nothing, 1 query, 2 exec, 3 both."""
    out = {}
    for mine in per_key(rows).values():
        mask, opened = 0, None
        for _, ts, seq, kind in mine:
            if kind == "query-start":
                mask, opened = 1, ts
            elif kind == "query-exec-start":
                mask, opened = mask | 2, ts
            elif kind == "query-done":
                if mask & 1:
                    out[seq] = ("yes" if mask == 3 else "no", ts - opened)
                mask, opened = 0, None
            elif kind == "query-exec-done" and not mask & 1:
                if mask:
                    out[seq] = ("no", ts - opened)
                mask, opened = 0, None
    return out


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_logical_queries(spark, seed):
    kinds = ["query-start", "query-exec-start", "query-exec-done", "query-done"]
    rows = events(seed, kinds, n=200)
    query = next(m for m in EVENT_METRICS if (m.module, m.stat) == ("mysql", "queries"))
    want = queries_by_hand(rows)
    df = table(spark, rows).select(
        F.lit("h").alias("host"), F.col("key").alias("thread_id"), (F.col("ts_ns") * 1_000_000_000).alias("ts_ns"), "seq",
        F.concat(F.lit("mysql9:::"), "kind").alias("probe"), F.col("ts_ns").alias("vts_ns"), F.lit(1).alias("pid"),
        F.create_map(F.lit("code"), F.lit("0")).alias("args"),
    )
    got = query.points(df, ["parsed", "latency"]).collect()
    assert sorted((r["parsed"], r["latency"] // 1_000_000_000) for r in got) == sorted(want.values())


ARGS = {
    "driver": "sd", "pri": "50", "family": "AF_INET", "result": "0", "fstype": "zfs", "http_url": "/a?b=1", "query": "select 1 from t",
    "code": "0", "forwarded_for": "1.2.3.4, 5.6.7.8", "raddr": "9.9.9.9", "table": "t#1", "optype": "put", "size": "5000", "state": "SSLEEP", "type": "2",
    "changed": "7", "matched": "9", "started": "0", "vector": "255", "errno": "10", "cr3": "4096", "bytes": "10", "offset": "1", "buffered": "2", "direction": "1",
}


def probe_table(spark, metric):
    rows = []
    for i, (starts, dones) in enumerate(metric.pairs or [(["mysql*:::query-start"], ["mysql*:::query-done"])]):
        for ts, probe in ((1_000_000_000, *starts[:1]), (1_500_000_000, dones[0])) if starts else ((1_500_000_000, dones[0]),):
            rows.append((ts, ts // 2, ts + i, "h", probe.replace("*", "1"), 1 + i, 10, f"r{i}", "z", "qemu-system-x86_", "x -y", 1, "sh", "sh", ARGS))
    return spark.createDataFrame(
        rows,
        "ts_ns bigint, vts_ns bigint, seq bigint, host string, probe string, thread_id bigint, pid bigint, req_key string,"
        " zonename string, execname string, psargs string, ppid bigint, pexecname string, ppsargs string, args map<string, string>",
    )


def test_every_event_metric_and_field(spark):
    """Each metric gives its one point for all of its fields at once."""
    found = {}
    for metric in EVENT_METRICS:
        fields = list(metric.metric().fields)
        rows = metric.points(probe_table(spark, metric), fields)
        assert rows.columns == ["t", *fields, "value"]
        found[(metric.module, metric.stat)] = rows.collect()
    assert all(len(rows) == max(1, len(m.pairs)) for m, rows in zip(EVENT_METRICS, found.values()))
    one = lambda module, stat: found[(module, stat)][0].asDict()
    assert one("apache", "httpd_ops")["http_path"] == "/a" and one("apache", "httpd_ops")["latency"] == 500_000_000
    assert one("node", "httpd_ops")["http_origin"] == "1.2.3.4"
    assert one("mysql", "queries")["querysubstr"] == "select..." and one("postgres", "queries")["querysubstr"] == "select 1 f..."
    assert one("mysql", "filesort")["table"] == "t"
    assert one("mysql", "statements")["statement"] == "select" and one("mysql", "statements")["rowschanged"] == 0
    assert {r["optype"] for r in found[("moray", "ops")]} == {"delobject", "put"}
    assert one("ldapjs", "ops")["optype"] == "add" and one("zfs", "arc_ops")["optype"] == "hit"
    assert one("fs", "logical_ops")["optype"] == "read" and one("fs", "logical_ops")["fstype"] == "zfs"
    assert one("vm", "irqs")["irqvector"] == "ff" and one("vm", "physio_ops")["errno"] == "a"
    assert one("cpu", "thread_executions")["leavereason"] == "sleeping" and one("cpu", "thread_executions")["subsecond"] == 0
    assert one("unix", "proc_exits")["walltime"] == 1_500_000_000 and one("unix", "proc_exits")["subsecond"] == 500
    assert one("node", "gc_ops")["gctype"] == "mark and sweep" and one("vm", "physio_bytes")["value"] == 10


def test_lazy_pairing(spark):
    """A done without start counts unless a start-side field is asked for."""
    syscalls = next(m for m in EVENT_METRICS if m.module == "syscall")
    lone = probe_table(spark, syscalls).filter(F.col("probe").like("%return"))
    run = lambda *dims: instrument(lone, syscalls.metric(), Instrumentation("syscall", "syscalls", decomposition=dims)).count()
    assert run("hostname") == 1 and run("latency") == 0
    httpd = next(m for m in EVENT_METRICS if m.stat == "httpd_ops" and m.module == "node")
    lone = probe_table(spark, httpd).filter(F.col("probe").like("%response"))
    assert [r["http_origin"] for r in httpd.points(lone, ["http_origin"]).collect()] == ["9.9.9.9"]
    assert httpd.points(lone, ["http_origin", "latency"]).count() == 0
