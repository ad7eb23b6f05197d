"""Counter snapshots to data points.

A snapshot row names a counter record (``module, instance, class, name``) and
carries its counters in ``data MAP<STRING,DOUBLE>``, the read it belongs to
(``read_no``) and the time of the read in ns (``snaptime``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import HALO, PREV, SLICE

READS_PER_SLICE = 4096

# --- fixed values: record filters, scales and sentinels ------------------------
NIC_NAMES = r"^(e1000g|bnx|igb|ixgbe|net)\d+$"
DISK_MODULES = ("cmdk", "sd")
GLOBAL_ZONE = "global"
VM_RECORD = "vm"
LOAD_SCALE = 256
NO_LIMIT = 2.0**64
# -------------------------------------------------------------------------------


def record_key() -> Column:
    return F.concat_ws(":", "module", "instance", "class", "name")


def pair_reads(
    snapshots: DataFrame,
    keys: Sequence[str],
    read_no: str = "read_no",
    reads: int = READS_PER_SLICE,
    carry: Sequence[str] = ("read_no", "snaptime", "data"),
) -> DataFrame:
    """Each snapshot with the same record's snapshot of the directly preceding read.

    Adds ``prev``, a struct of the ``carry`` columns.  Records missing from the previous
    read are left out.  Reads are numbered, so the rows of one record are cut
    every ``reads`` reads and the last read of a slice is sent to the next one
    as well: a single shuffle, and no record needs one task.
    """
    columns = snapshots.columns
    own = F.floor(F.col(read_no) / F.lit(reads)).cast("bigint")
    is_last = F.pmod(F.col(read_no), F.lit(reads)) == reads - 1
    rows = snapshots.withColumn(SLICE, F.explode(F.when(is_last, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, SLICE).orderBy(read_no)
    rows = rows.withColumn(HALO, F.col(SLICE) != own).withColumn(
        PREV, F.lag(F.struct(*carry)).over(w)
    )
    return rows.filter(~F.col(HALO) & (F.col(f"{PREV}.{read_no}") == F.col(read_no) - 1)).select(
        *columns, F.col(PREV).alias("prev")
    )


def slim(snapshots: DataFrame, counters: Sequence[str]) -> DataFrame:
    """``data`` cut down to the counters in use, before anything is shuffled."""
    if not counters:
        return snapshots.drop("data").withColumn("data", F.struct(F.lit(None).cast("double").alias("none")))
    return snapshots.withColumn("data", F.struct(*(F.col("data")[c].alias(c) for c in counters)))


def now(counter: str) -> Column:
    return F.col("data")[counter]


def before(counter: str) -> Column:
    return F.col("prev.data")[counter]


def delta(*counters: str) -> Column:
    """Growth of the sum of ``counters``; may be negative after a reset."""
    return sum((now(c) for c in counters[1:]), now(counters[0])) - sum(
        (before(c) for c in counters[1:]), before(counters[0])
    )


def interval() -> Column:
    """Time between the two snapshots in ns."""
    return F.col("snaptime") - F.col("prev.snaptime")


def percent_rate(*counters: str) -> Column:
    """Whole percent of the interval that the counters (ns) grew by."""
    return F.floor(F.lit(100) * delta(*counters) / interval()).cast("double")


def residual(whole: str, *parts: str) -> Column:
    """Growth of ``whole`` that no ``parts`` counter accounts for."""
    rest = delta(whole)
    for part in parts:
        rest = rest - delta(part)
    return rest


def limit(counter: str) -> Column:
    """Current limit, NULL when there is none."""
    v = now(counter)
    return F.when((v != 0) & (v != NO_LIMIT), v)


def load_average(counter: str) -> Column:
    return now(counter) / LOAD_SCALE


def unpivot(paired: DataFrame, label: str, values: Mapping[str, Column]) -> DataFrame:
    """One point per label: ``value`` with the dimension ``label``; NULLs dropped."""
    choices = F.array(*(F.struct(F.lit(k).alias(label), v.cast("double").alias("value")) for k, v in values.items()))
    return paired.select("*", F.inline(choices)).filter(F.col("value").isNotNull())


def is_nic() -> Column:
    return F.col("name").rlike(NIC_NAMES)


def is_vnic(zonename: Column) -> Column:
    return zonename.isNotNull() & (zonename != GLOBAL_ZONE)


def is_disk() -> Column:
    return F.col("module").isin(*DISK_MODULES)


def is_vcpu() -> Column:
    return F.col("name") != VM_RECORD


# --- snapshots without history ---------------------------------------------------


def unused_quota() -> Column:
    return F.when(F.col("quota") != 0, F.col("quota") - F.col("used"))


def own_used() -> Column:
    return F.col("used") - F.col("usedbychildren")


def quota() -> Column:
    return F.when(F.col("quota") != 0, F.col("quota"))


def points(df: DataFrame, value: Column, *dims: str | Column) -> DataFrame:
    """Points with ``value``; rows without a value are left out."""
    return df.select(*dims, value.cast("double").alias("value")).filter(F.col("value").isNotNull())


def stamp_source(df: DataFrame, source: Column) -> DataFrame:
    """Events as points of value 1 that carry their host."""
    return df.withColumns({"hostname": source, "value": F.lit(1.0)})
