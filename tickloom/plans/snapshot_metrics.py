"""Metrics of object snapshots: storage, processes and the collector itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.buckets import linear, log_linear
from ..operators import counters as k
from .spec import FieldDef, Metric


def _storage(stat: str, value, name: str) -> Metric:
    def points(rows, names):
        dims = [F.col("name").alias(n) if n == name else F.col(n) for n in names]
        return k.points(rows, value(), "t", *dims)

    return Metric("zfs", stat, {"hostname": FieldDef(), name: FieldDef()}, points, "point", source=name)


STORAGE_METRICS = [
    _storage("dataset_unused_quota", k.unused_quota, "zdataset"),
    _storage("dataset_used", k.own_used, "zdataset"),
    _storage("dataset_quota", k.quota, "zdataset"),
    _storage("pool_free", lambda: F.col("free"), "zpool"),
    _storage("pool_used", lambda: F.col("allocated"), "zpool"),
    _storage("pool_total", lambda: F.col("size"), "zpool"),
]

PROCESS_DIMS = ("hostname", "execname", "pid", "ppid", "contract", "psargs", "pmodel", "zonename")


def _process_points(rows, names):
    return k.points(rows, F.lit(1), "t", *names)


PROCESSES = Metric(
    "unix",
    "processes",
    {
        **{n: FieldDef() for n in PROCESS_DIMS},
        "rss": FieldDef(log_linear(10, 0, 11, 100)),
        "nthreads": FieldDef(log_linear(10, 1, 6, 1000)),
    },
    _process_points,
    source="processes",
)


LATENCY = log_linear(10, 0, 11, 100)
SUBSECOND = linear(10)
OPERATION = ("cabackend", "cainstnid", "cametric")


def _collector(stat: str, event: str, discrete: tuple[str, ...] = (), subsecond: bool = True) -> Metric:
    """Operations of the collecting agents; every event counts 1."""

    def points(rows, names):
        return k.points(rows.filter(F.col("event") == event), F.lit(1), "t", *names)

    fields = {n: FieldDef() for n in ("hostname", *discrete)} | {"latency": FieldDef(LATENCY)}
    if subsecond:
        fields["subsecond"] = FieldDef(SUBSECOND)
    return Metric("ca", stat, fields, points, source="collector")


COLLECTOR_METRICS = [
    _collector("instr_ticks", "instr_tick"),
    _collector("instr_beops", "instr_backend_op", OPERATION),
    _collector("instr_enables", "instr_backend_enable", OPERATION, subsecond=False),
    _collector("instr_disables", "instr_backend_disable", OPERATION, subsecond=False),
]
