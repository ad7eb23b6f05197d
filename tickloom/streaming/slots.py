"""Streaming slots: tumbling sums, first reports, completeness, sliding reads.

Streams are report streams with ``event_time TIMESTAMP`` (see
:func:`with_event_time`).  Late reports count while inside the retention, which
is the watermark delay and bounds the state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.slots import SETTLE

DIMS = ("inst_id", "key", "lo", "hi")


def with_event_time(reports: DataFrame, ms: str = "ts_ms") -> DataFrame:
    return reports.withColumn("event_time", F.timestamp_millis(F.col(ms).cast("bigint")))


def _dims(df: DataFrame, names: Sequence[str] = DIMS) -> list[str]:
    return [n for n in names if n in df.columns]


def _window(g: int, slide: int | None = None):
    return F.window("event_time", f"{g} seconds", f"{slide} seconds" if slide else None)


def _start(column: str = "window"):
    return F.unix_timestamp(F.col(f"{column}.start")).alias("slot")


def tumbling(reports: DataFrame, g: int, retention: int) -> DataFrame:
    """Slot sums; in update mode every change to a slot comes out at once."""
    dims = _dims(reports)
    return (
        reports.withWatermark("event_time", f"{retention} seconds")
        .groupBy(_window(g), *dims)
        .agg(F.sum("value").alias("value"))
        .select(_start(), *dims, "value")
    )


def settled(reports: DataFrame, g: int, timeout: int = SETTLE) -> DataFrame:
    """The same for append mode: a slot comes out once, ``timeout`` after its end."""
    return tumbling(reports, g, timeout)


def first_reports(reports: DataFrame, g: int, retention: int) -> DataFrame:
    """Gauge slots: the earliest report of each source, summed over the sources.

    ``reports`` has one row per report: ``inst_id, source, event_time, seq`` and
    ``value``, or ``items ARRAY<STRUCT<key, lo, hi, value>>``.  State is one
    report per source and slot.  Use append mode.
    """
    payload = "items" if "items" in reports.columns else "value"
    first = (
        reports.withWatermark("event_time", f"{retention} seconds")
        .groupBy(_window(g), "inst_id", "source")
        .agg(F.min_by(payload, F.struct("event_time", "seq")).alias(payload))
    )
    rows = first.select("window", "inst_id", F.inline("items")) if payload == "items" else first
    dims = _dims(rows)
    return rows.groupBy("window", *dims).agg(F.sum("value").alias("value")).select(_start(), *dims, "value")


def arrivals(reports: DataFrame, g: int, retention: int) -> DataFrame:
    """First arrival of each ``(inst_id, slot, source)``; append mode.

    Its table feeds ``slots.reporting`` and ``slots.complete``.
    """
    slot = F.unix_timestamp("event_time") - F.pmod(F.unix_timestamp("event_time"), F.lit(g))
    return (
        reports.withWatermark("event_time", f"{retention} seconds")
        .withColumn("slot", slot)
        .dropDuplicatesWithinWatermark(["inst_id", "slot", "source"])
        .select("inst_id", "slot", "source")
    )


def sliding(reports: DataFrame, width: int, g: int, retention: int) -> DataFrame:
    """Sums over the last ``width`` seconds, moving by ``g``."""
    dims = _dims(reports)
    return (
        reports.withWatermark("event_time", f"{retention} seconds")
        .groupBy(_window(width, g), *dims)
        .agg(F.sum("value").alias("value"))
        .select(_start(), *dims, "value")
    )


def sliding_from_slots(slots: DataFrame, width: int, g: int) -> DataFrame:
    """The same as a batch read of finished slots: each slot row joins the
    ``width / g`` windows it is part of."""
    dims = _dims(slots)
    starts = F.sequence(F.col("slot") - (width - g), F.col("slot"), F.lit(g).cast("bigint"))
    return (
        slots.withColumn("slot", F.explode(starts))
        .groupBy("slot", *dims)
        .agg(F.sum("value").alias("value"))
    )
