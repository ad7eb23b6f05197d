from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.helpers import nested
from tickloom.operators import counters as k
from tickloom.plans.counter_metrics import COUNTER_METRICS
from tickloom.plans.metrics import choose, definitions
from tickloom.plans.snapshot_metrics import COLLECTOR_METRICS, PROCESSES, STORAGE_METRICS
from tickloom.plans.spec import Instrumentation, SpecError, instrument
from tickloom.sources import tables as src

SNAPSHOT = (
    "hostname string, module string, class string, name string, instance int, read_no bigint, t bigint,"
    " snaptime bigint, data map<string, double>"
)


def disks(spark, reads):
    rows = [
        ("testhostname", "sd", "disk", f"sd{i}", i, n, 100 + n, 59151171350139, {"nread": float(n * (101 + i)), "nwritten": 0.0})
        for n in range(1, reads + 1) for i in range(3)
    ]
    return spark.createDataFrame(rows, SNAPSHOT)


def metric(name):
    return next(m.metric() for m in COUNTER_METRICS if f"{m.module}.{m.stat}" == name)


BUCKETED = [[[100, 109], 2]]
BOTH = {"sd0": [[[100, 109], 1]], "sd2": [[[100, 109], 1]]}


@pytest.mark.parametrize(
    ("dims", "want"),
    [((), 2), (("hostname",), {"testhostname": 2}), (("disk",), {"sd0": 1, "sd2": 1}), (("bytes_read",), BUCKETED), (("bytes_read", "disk"), BOTH)],
)
def test_three_disks(spark, dims, want):
    """Nothing after the first read; after the second one, all but the excluded disk."""
    spec = Instrumentation("disk", "disks", {"ne": ["disk", "sd1"]}, dims)
    assert instrument(disks(spark, 1), metric("disk.disks"), spec).count() == 0
    assert nested(instrument(disks(spark, 2), metric("disk.disks"), spec)) == want


def test_pairs_only_consecutive_reads(spark):
    reads = {"a": [0, 1, 2, 4, 5, 9, 10], "b": [3, 4]}
    rows = [(key, n, float(n)) for key, ns in reads.items() for n in ns]
    df = spark.createDataFrame(rows, "record string, read_no bigint, v double")
    for width in (1, 2, 3, 4096):  # wherever the reads are cut
        got = k.pair_reads(df, ["record"], reads=width, carry=["read_no", "v"])
        assert sorted((r["record"], r["prev"]["read_no"], r["read_no"]) for r in got.collect()) == [
            ("a", 0, 1), ("a", 1, 2), ("a", 4, 5), ("a", 9, 10), ("b", 3, 4)
        ]


def test_derivations(spark):
    new = {"a": 300.0, "b": 50.0, "whole": 100.0, "x": 30.0, "y": 20.0, "load": 640.0, "cap": 2.0**64, "zero": 0.0}
    old = {"a": 100.0, "b": 60.0, "whole": 40.0, "x": 10.0, "y": 5.0, "load": 1.0, "cap": 1.0, "zero": 0.0}
    rows = [("h", "m", "c", "n", 0, i, i, i * 1000, d) for i, d in ((1, old), (2, new))]
    paired = k.pair_reads(spark.createDataFrame(rows, SNAPSHOT), ["name"])
    got = paired.select(
        k.delta("a"), k.delta("b"), k.delta("a", "b"), k.percent_rate("a"), k.percent_rate("b"), k.residual("whole", "x", "y"),
        k.now("a"), k.limit("cap"), k.limit("zero"), k.limit("a"), k.load_average("load"),
    ).collect()[0]
    assert tuple(got) == (200, -10, 190, 20, -1, 25, 300, None, None, 300, 2.5)


def test_storage_quota(spark):
    rows = [("foo/bar", "h", 1, 15, 5, 1), ("foo/bob", "h", 1, 18, 6, 2), ("foo/none", "h", 1, 0, 7, 3)]
    df = spark.createDataFrame(rows, "name string, hostname string, t bigint, quota bigint, used bigint, usedbychildren bigint")
    by_stat = {m.stat: m for m in STORAGE_METRICS}
    run = lambda stat, pred, dims: nested(instrument(df, by_stat[stat], Instrumentation("zfs", stat, pred, dims)))
    assert run("dataset_quota", {"eq": ["zdataset", "foo/bar"]}, ()) == 15
    assert run("dataset_quota", {}, ("zdataset",)) == {"foo/bar": 15, "foo/bob": 18}
    assert run("dataset_unused_quota", {}, ("zdataset",)) == {"foo/bar": 10, "foo/bob": 12}
    assert run("dataset_used", {}, ()) == 4 + 4 + 4


def test_collector_events(spark):
    rows = [
        ("instr_backend_op", "foo", "dtrace", "1457", 1357000, 235), ("instr_backend_op", "foo", "kstat", "1200", 2827000, 429),
        ("instr_backend_op", "foo", "dtrace", "1312", 2123000, 486), ("instr_backend_op", "foo", "dtrace", "1457", 1200000, 287),
        ("instr_tick", "foo", "kstat", "1200", 2827000, 429),
    ]
    df = spark.createDataFrame(rows, "event string, hostname string, cabackend string, cainstnid string, latency bigint, subsecond bigint")
    spec = Instrumentation("ca", "instr_beops", {"eq": ["cabackend", "dtrace"]}, ("cainstnid", "subsecond"))
    got = instrument(df.withColumn("t", F.lit(1)), COLLECTOR_METRICS[1], spec)
    assert nested(got) == {"1457": [[[230, 239], 1], [[280, 289], 1]], "1312": [[[480, 489], 1]]}


def test_processes(spark):
    records = spark.createDataFrame(
        [(1, 7, 0, "init\0xx", "/sbin/init\0", 0, 10, 1, 1, 9), (1, 8, 7, "node", "node x", 5, 20, 2, 30, 9)],
        "t int, pr_pid int, pr_ppid int, pr_fname string, pr_psargs string, pr_zoneid int, pr_rssize int, pr_dmodel int, pr_nlwp int, pr_contract int",
    )
    zones = spark.createDataFrame([(0, "global")], "zoneid int, zonename string")
    got = {r["pid"]: r for r in src.processes(records, zones).collect()}
    assert (got["7"]["execname"], got["7"]["zonename"], got["7"]["pmodel"], got["7"]["rss"]) == ("init", "global", "32-bit", 10240)
    assert (got["8"]["zonename"], got["8"]["pmodel"], got["8"]["ppid"]) == ("shutting-down", "64-bit", "7")
    spec = Instrumentation("unix", "processes", {"gt": ["nthreads", 5]}, ("execname", "nthreads"))
    rows = src.processes(records, zones).withColumn("hostname", F.lit("h"))
    assert nested(instrument(rows, PROCESSES, spec)) == {"node": [[[30, pytest.approx(30.09)], 1]]}


def test_storage_list(spark, tmp_path):
    (tmp_path / "list").write_text("zones/a\t-\t12\tx\nzones/b\t7\tsoon\t-\n")
    rows = src.storage_list(spark, str(tmp_path / "list"), ["name", "quota", "used", "note"], text=["note"]).collect()
    assert [tuple(r) for r in rows] == [("zones/a", 0, 12, "x", None), ("zones/b", 7, None, "0", {"used": "soon"})]
    (tmp_path / "clash").write_text("a\t-\tlots\nb\t2\t3\n")
    clash = src.storage_list(spark, str(tmp_path / "clash"), ["name", "other", "_other"])
    assert clash.columns == ["name", "other", "_other", "__other"]
    assert [tuple(r) for r in clash.collect()] == [("a", 0, None, {"_other": "lots"}), ("b", 2, 3, None)]
    (tmp_path / "twice").write_text("a\t1\na\t2\n")
    with pytest.raises(ValueError):
        src.storage_list(spark, str(tmp_path / "twice"), ["name", "quota"])
    assert src.storage_list(spark, str(tmp_path / "twice"), ["name", "quota"], unique=False).count() == 2
    twice = spark.createDataFrame([("a",), ("a",), ("b",)], "name string")
    assert [tuple(r) for r in src.duplicate_names(twice).collect()] == [("a", 2)]
    with pytest.raises(ValueError):
        src.require_unique(twice)


def test_definitions_cover_every_metric():
    names = {(m.module, m.stat) for m in definitions()}
    assert len(definitions()) == 80 and len(names) == 77
    several = [n for n in names if sum((m.module, m.stat) == n for m in definitions()) > 1]
    assert sorted(several) == [("disk", "physio_ops"), ("fs", "logical_rwops"), ("zfs", "arc_ops")]


def test_source_choice():
    pick = lambda *dims: choose(Instrumentation("disk", "physio_ops", decomposition=dims), definitions()).source
    assert pick() == "counters" and pick("disk", "optype") == "counters" and pick("latency") == "events"
    for bad in (("disk", "physio_ops", ("zonename",)), ("disk", "nosuch", ())):
        with pytest.raises(SpecError):
            choose(Instrumentation(bad[0], bad[1], decomposition=bad[2]), definitions())
