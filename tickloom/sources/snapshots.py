"""Saved slots as a log of versions: write, read back, add to, merge, compact.

A folder holds *parts* and a *log*.  A part is a folder of three tables:
``slots`` (long values), ``reporting`` (slot, source, last time seen) and
``meta`` (version, granularity, number of sources).  A version of the log lists
the parts that make up the snapshot; it is one file, written after its parts.
So a reader sees all of a version or none of it, and a writer that fails leaves
the last version as it was.

A part adds to those before it, or replaces the instrumentations that it holds.
An addition is of the size of what it adds; :func:`compact` sums the parts up
into one and drops what is older than the retention.  One writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import merge
from ..operators.slots import retain

VERSION = (1, 0)
TABLES = ("slots", "reporting", "meta")
LOG = "part string, batch_id bigint, number int, replaces boolean, version int"


class SnapshotError(ValueError):
    """The snapshot is of another version or granularity."""


@dataclass(frozen=True)
class Snapshot:
    slots: DataFrame
    reporting: DataFrame
    meta: DataFrame


def capture(reports: DataFrame, slots: DataFrame, granularity: int, nsources: DataFrame | None = None) -> Snapshot:
    """Snapshot of reports (``inst_id, slot, source, t``) and their slots."""
    reporting = reports.groupBy("inst_id", "slot", "source").agg(F.max("t").alias("last_seen"))
    # an instrumentation of which only undefined data came in has no slot but is there
    ids = reporting.select("inst_id").distinct()
    counted = (
        ids.withColumn("nsources", F.lit(0).cast("bigint"))
        if nsources is None
        else ids.join(nsources, "inst_id", "left").select("inst_id", F.coalesce("nsources", F.lit(0)).alias("nsources"))
    )
    meta = counted.select(
        "inst_id",
        F.lit(VERSION[0]).alias("vers_major"),
        F.lit(VERSION[1]).alias("vers_minor"),
        F.lit(granularity).alias("granularity"),
        "nsources",
    )
    return Snapshot(slots, reporting, meta)


def versions(spark: SparkSession, path: str) -> DataFrame | None:
    """``version, part, batch_id, number, replaces`` of all versions that are kept; None without any."""
    try:
        return spark.read.schema(LOG).parquet(f"{path}/log")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def parts_of(spark: SparkSession, path: str, version: int | None = None) -> list[Row]:
    """The parts of a version, by default the last, in their order; they are few, as compaction keeps them so."""
    log = versions(spark, path)
    if log is None:
        return []
    top = log.agg(F.max("version")).scalar() if version is None else F.lit(version)
    return log.filter(F.col("version") == top).orderBy("number").collect()


def _commit(spark: SparkSession, path: str, before: list[Row], parts: list[tuple[str, bool]], batch_id: int | None) -> int:
    """Write the next version; readers see it once its only file is in place."""
    version = before[0].version + 1 if before else 0
    done = [r.batch_id for r in before if r.batch_id is not None]
    batch_id = max(done, default=None) if batch_id is None else batch_id
    rows = [(part, batch_id, number, replaces) for number, (part, replaces) in enumerate(parts)]
    listed = spark.createDataFrame(rows, "part string, batch_id bigint, number int, replaces boolean")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/log/version={version}")
    return version


def _write_part(snapshot: Snapshot, path: str, part: str) -> None:
    for name in TABLES:
        getattr(snapshot, name).write.mode("overwrite").parquet(f"{path}/parts/{part}/{name}")


def _new_part(kind: str) -> str:
    return f"{kind}-{uuid.uuid4().hex}"


def save(snapshot: Snapshot, path: str) -> int:
    """Replace the instrumentations in ``snapshot`` and leave others alone; gives the version."""
    spark = snapshot.slots.sparkSession
    before, part = parts_of(spark, path), _new_part("saved")
    _write_part(snapshot, path, part)
    return _commit(spark, path, before, [*((r.part, r.replaces) for r in before), (part, True)], None)


def add(snapshot: Snapshot, path: str, batch_id: int | None = None) -> int:
    """Add the values in ``snapshot`` to those saved; writes no more than these.

    A ``batch_id`` that is in already changes nothing, so a micro-batch may be
    repeated.
    """
    spark = snapshot.slots.sparkSession
    before = parts_of(spark, path)
    if batch_id is not None and any(r.batch_id is not None and r.batch_id >= batch_id for r in before):
        return before[0].version
    part = _new_part("added")
    _write_part(snapshot, path, part)
    return _commit(spark, path, before, [*((r.part, r.replaces) for r in before), (part, False)], batch_id)


def compact(spark: SparkSession, path: str, granularity: int, retention: int = 0, keep: int = 2) -> int:
    """Sum up all parts into one, without slots ``retention`` seconds older than the last report (0 keeps all).

    The last ``keep`` versions stay readable; what only older ones need is removed.
    """
    before = parts_of(spark, path)
    whole = load(spark, path, granularity)
    if retention:
        now = whole.reporting.agg(F.max("last_seen")).scalar()
        whole = Snapshot(retain(whole.slots, now, retention), retain(whole.reporting, now, retention), whole.meta)
    part = _new_part("whole")
    _write_part(whole, path, part)
    version = _commit(spark, path, before, [(part, True)], None)
    vacuum(spark, path, keep)
    return version


def vacuum(spark: SparkSession, path: str, keep: int) -> None:
    """Remove the log's older versions and the parts that none of the last ``keep`` versions lists."""
    log = versions(spark, path)
    if log is None:
        return
    rows = log.select("version", "part").collect()
    oldest = max(r.version for r in rows) - keep + 1
    needed = {r.part for r in rows if r.version >= oldest}
    gone = {f"log/version={r.version}" for r in rows if r.version < oldest}
    gone |= {f"parts/{r.part}" for r in rows if r.part not in needed}
    for name in sorted(gone):  # versions before the parts that they list
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def load(spark: SparkSession, path: str, granularity: int, version: int | None = None) -> Snapshot:
    """The last version, or the one asked for."""
    parts = parts_of(spark, path, version)
    if not parts:
        raise SnapshotError(f"no snapshot in {path}")
    out = None
    for row in parts:
        tables = {n: spark.read.parquet(f"{path}/parts/{row.part}/{n}") for n in TABLES}
        own = Snapshot(**tables)
        if out is None:
            out = own
            continue
        if row.replaces:
            ids = own.meta.select("inst_id").distinct()
            out = Snapshot(*(getattr(out, n).join(ids, "inst_id", "left_anti") for n in TABLES))
        out = Snapshot(*(getattr(out, n).unionByName(getattr(own, n), allowMissingColumns=True) for n in TABLES))
    bad = (F.col("vers_major") != VERSION[0]) | (F.col("granularity") != granularity)
    wrong = out.meta.filter(bad).limit(1).collect()
    if wrong:
        raise SnapshotError(f"cannot use {wrong[0].asDict()} with version {VERSION} and granularity {granularity}")
    return out if all(r.replaces for r in parts) else _summed(out)


def _summed(rows: Snapshot) -> Snapshot:
    dims = [c for c in ("inst_id", "slot", "key", "lo", "hi") if c in rows.slots.columns]
    slots = merge(rows.slots, dims)
    reporting = rows.reporting.groupBy("inst_id", "slot", "source").agg(F.max("last_seen").alias("last_seen"))
    meta = rows.meta.groupBy("inst_id", "vers_major", "granularity").agg(
        F.max("vers_minor").alias("vers_minor"), F.max("nsources").alias("nsources")
    )
    return Snapshot(slots, reporting, meta.select(*rows.meta.columns))


def merged(a: Snapshot, b: Snapshot) -> Snapshot:
    """Add the values, unite who reported, keep the latest times and counts."""
    return _summed(Snapshot(*(getattr(a, n).unionByName(getattr(b, n)) for n in TABLES)))
