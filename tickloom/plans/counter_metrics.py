"""Metrics derived from counter snapshots.

Each entry names the records it reads, the dimensions and how the value comes
out of two consecutive snapshots.  A dimension with several values per record
(``modes``) unpivots it into one point per value.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import Bucketizer, linear, log_linear
from ..functions.scalars import TCP_ERRORS
from ..operators import counters as k
from .spec import FieldDef, Metric

Expr = Callable[[], Column]
RECORD = ["hostname", "module", "instance", "class", "name"]


@dataclass(frozen=True)
class CounterMetric:
    module: str
    stat: str
    record: Mapping[str, str]
    value: Expr | None = None
    keep: Expr | None = None
    discrete: Mapping[str, Expr] = field(default_factory=dict)
    numeric: Mapping[str, tuple[Expr, Bucketizer]] = field(default_factory=dict)
    modes: tuple[str, Mapping[str, Expr]] | None = None
    scope: str = "interval"

    def points(self, snapshots: DataFrame, names) -> DataFrame:
        rows = snapshots
        for column, wanted in self.record.items():
            rows = rows.filter(F.col(column) == wanted)
        if "error" in rows.columns:
            rows = rows.filter(F.col("error").isNull())
        if self.keep is not None:
            rows = rows.filter(self.keep())
        dims = {n: e for n, e in self.discrete.items() if n in names}
        dims |= {n: e for n, (e, _) in self.numeric.items() if n in names}
        values = [self.value] if self.modes is None else list(self.modes[1].values())
        used = dict.fromkeys(c for e in [*values, *dims.values()] for c in getattr(e, "counters", ()))
        kept = ["t", "read_no", "snaptime", "data", *RECORD, *(["zonename"] if "zonename" in names else [])]
        paired = k.pair_reads(k.slim(rows, list(used)).select(*kept), RECORD)
        if self.modes is not None:
            paired = k.unpivot(paired, self.modes[0], {n: e() for n, e in self.modes[1].items()})
        else:
            paired = paired.withColumn("value", self.value().cast("double"))
        columns = [dims[n]().alias(n) if n in dims else F.col(n) for n in names]
        return paired.filter(F.col("value").isNotNull()).select("t", *columns, "value")

    def metric(self) -> Metric:
        fields = {"hostname": FieldDef()}
        fields |= {n: FieldDef() for n in self.discrete}
        if self.modes:
            fields[self.modes[0]] = FieldDef()
        fields |= {n: FieldDef(b) for n, (_, b) in self.numeric.items()}
        early = {"hostname": "hostname"} | {n: EARLY[e] for n, e in self.discrete.items() if e in EARLY}
        return Metric(self.module, self.stat, fields, self.points, self.scope, source="counters", early=early)


def _zone() -> Column:
    return F.col("zonename")


def _name() -> Column:
    return F.col("name")


# A record keeps its name and its zone from one reading to the next.
EARLY = {_zone: "zonename", _name: "name"}


def _numbered(prefix: str) -> Expr:
    return lambda: F.concat(F.lit(prefix), F.col("instance").cast("string"))


def _uses(expr: Expr, *counters: str) -> Expr:
    """Note the counters an expression reads, so that the rest can be left out."""
    expr.counters = counters
    return expr


def _delta(*names: str) -> Expr:
    return _uses(lambda: k.delta(*names), *names)


def _rate(*names: str) -> Expr:
    return _uses(lambda: k.percent_rate(*names), *names)


def _gauge(name: str) -> Expr:
    return _uses(lambda: k.now(name), name)


def _limit(name: str) -> Expr:
    return _uses(lambda: k.limit(name), name)


def _load(name: str) -> Expr:
    return _uses(lambda: k.load_average(name), name)


def _rest(whole: str, *parts: str) -> Expr:
    return _uses(lambda: k.residual(whole, *parts), whole, *parts)


ONE: Expr = lambda: F.lit(1)
ZONE = {"zonename": _zone}
COUNTS = log_linear(10, 0, 11, 100)
BYTES = log_linear(10, 2, 11, 100)
PERCENT = linear(1)


def _resource(fields: Mapping[str, tuple[str, ...]], bucket: Bucketizer) -> dict:
    return {n: (_delta(*names), bucket) for n, names in fields.items()}


ZONES = {"module": "zones", "class": "zone_misc"}
LINKS = {"module": "link", "class": "net"}
DISKS = {"class": "disk"}
TCP = {"module": "tcp", "class": "mib2"}
VFS = {"module": "zone_vfs"}
CAPS = {"module": "memory_cap"}
IO_OPS = {"read": _delta("reads"), "write": _delta("writes")}
IO_BYTES = {"read": _delta("nread"), "write": _delta("nwritten")}
LINK_BYTES = {"sent": _delta("obytes64"), "received": _delta("rbytes64")}
LINK_PACKETS = {"sent": _delta("opackets64"), "received": _delta("ipackets64")}
VM_EXITS = {
    "haltx": "halt-exits",
    "irqx": "irq-exits",
    "irqwx": "irq-window-exits",
    "iox": "io-exits",
    "mmiox": "mmio-exits",
}


def _is_vnic() -> Column:
    return k.is_vnic(F.col("zonename"))


COUNTER_METRICS = [
    CounterMetric(
        "cpu", "cpus", {"module": "cpu", "class": "misc", "name": "sys"}, ONE,
        discrete={"cpu": _numbered("cpu")},
        numeric={"utilization": (_rate("cpu_nsec_kernel", "cpu_nsec_user"), PERCENT)},
        scope="point",
    ),
    CounterMetric(
        "cpu", "usage", ZONES, discrete=ZONE, scope="point",
        modes=("cpumode", {"kernel": _rate("nsec_sys"), "user": _rate("nsec_user")}),
    ),
    CounterMetric("cpu", "waittime", ZONES, _delta("nsec_waitrq"), discrete=ZONE),
    CounterMetric(
        "cpu", "loadavg1", ZONES, _load("avenrun_1min"), discrete=ZONE, scope="point"
    ),
    CounterMetric(
        "nic", "nics", LINKS, ONE, keep=k.is_nic, discrete={"nic": _name}, scope="point",
        numeric={
            **_resource(
                {"packets": ("ipackets64", "opackets64"), "packets_in": ("ipackets64",), "packets_out": ("opackets64",)},
                COUNTS,
            ),
            **_resource(
                {"bytes": ("rbytes64", "obytes64"), "bytes_read": ("rbytes64",), "bytes_write": ("obytes64",)}, BYTES
            ),
        },
    ),
    CounterMetric("nic", "bytes", LINKS, keep=k.is_nic, discrete={"nic": _name}, modes=("direction", LINK_BYTES)),
    CounterMetric("nic", "packets", LINKS, keep=k.is_nic, discrete={"nic": _name}, modes=("direction", LINK_PACKETS)),
    CounterMetric("nic", "vnic_bytes", LINKS, keep=_is_vnic, discrete=ZONE, modes=("direction", LINK_BYTES)),
    CounterMetric("nic", "vnic_packets", LINKS, keep=_is_vnic, discrete=ZONE, modes=("direction", LINK_PACKETS)),
    CounterMetric(
        "disk", "disks", DISKS, ONE, keep=k.is_disk, discrete={"disk": _name}, scope="point",
        numeric={
            **_resource({"iops": ("reads", "writes"), "iops_read": ("reads",), "iops_write": ("writes",)}, COUNTS),
            **_resource({"bytes": ("nread", "nwritten"), "bytes_read": ("nread",), "bytes_write": ("nwritten",)}, BYTES),
            "busytime": (_rate("rtime"), PERCENT),
        },
    ),
    CounterMetric("disk", "physio_ops", DISKS, keep=k.is_disk, discrete={"disk": _name}, modes=("optype", IO_OPS)),
    CounterMetric("disk", "physio_bytes", DISKS, keep=k.is_disk, discrete={"disk": _name}, modes=("optype", IO_BYTES)),
    CounterMetric(
        "tcp", "segments", TCP, discrete={"tcpstack": _numbered("tcp")},
        modes=("direction", {"sent": _delta("outSegs"), "received": _delta("inSegs")}),
    ),
    CounterMetric(
        "tcp", "errors", TCP, discrete={"tcpstack": _numbered("tcp")},
        modes=("errtype", {text: _delta(name) for name, text in TCP_ERRORS.items()}),
    ),
    CounterMetric("fs", "logical_rwops", VFS, discrete=ZONE, modes=("optype", IO_OPS)),
    CounterMetric("fs", "logical_rwbytes", VFS, discrete=ZONE, modes=("optype", IO_BYTES)),
    CounterMetric("memory", "rss", CAPS, _gauge("rss"), discrete=ZONE, scope="point"),
    CounterMetric("memory", "rss_limit", CAPS, _limit("physcap"), discrete=ZONE, scope="point"),
    CounterMetric("memory", "swap", CAPS, _gauge("swap"), discrete=ZONE, scope="point"),
    CounterMetric("memory", "swap_limit", CAPS, _limit("swapcap"), discrete=ZONE, scope="point"),
    CounterMetric("memory", "reclaimed_bytes", CAPS, _delta("pagedout"), discrete=ZONE),
    CounterMetric("memory", "pageins", CAPS, _delta("pgpgin"), discrete=ZONE),
    CounterMetric(
        "vm", "exits", {"module": "kvm", "class": "misc"}, keep=k.is_vcpu, discrete={**ZONE, "vcpuid": _name},
        modes=(
            "vleavereason",
            {**{n: _delta(c) for n, c in VM_EXITS.items()}, "other": _rest("exits", *VM_EXITS.values())},
        ),
    ),
    CounterMetric(
        "zfs", "arc_ops", {"module": "zfs", "name": "arcstats"},
        modes=("optype", {"hit": _delta("hits"), "miss": _delta("misses")}),
    ),
]
