"""Time slots: alignment, scope, completeness and retention.

Times are ``BIGINT`` epoch seconds, intervals half-open.  ``g`` is the
granularity in seconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import merge

# --- fixed values: clock tolerances in seconds -------------------------------
SETTLE = 5  # wait for late hosts
WINDOW = 10  # look-back for the expected number of sources
LEAD = 10  # how far a host's clock may run ahead
SLOWEST = 5  # slowest rate at which a source reports
MAX_SLOTS = 3600
# ------------------------------------------------------------------------------

REPORT_DIMS = ("inst_id", "slot", "source")
VALUE_DIMS = ("key", "lo", "hi")


def down(t: Column, g: int | Column) -> Column:
    """Start of the slot that holds ``t``."""
    return (t - F.pmod(t, g if isinstance(g, Column) else F.lit(g))).cast("bigint")


def up(t: Column, g: int | Column) -> Column:
    """``t`` when aligned, else the start of the next slot."""
    g = g if isinstance(g, Column) else F.lit(g)
    return (t + F.pmod(-t, g)).cast("bigint")


def normalize(start: Column, duration: Column, g: int | Column) -> tuple[Column, Column]:
    """Start moved down, duration rounded up by itself.

    An unaligned request may thereby lose its tail: (12339, 10) at 10 s covers
    [12330, 12340).  That is the defined behaviour.
    """
    return down(start, g), up(duration, g)


def _present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def interval_scope(reports: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add up all reports of a slot."""
    dims = dict.fromkeys([*by, *_present(reports, ("inst_id", "slot", *VALUE_DIMS))])
    return merge(reports.filter(F.col("value").isNotNull()), list(dims))


def point_scope(reports: DataFrame, order: Sequence[str] = ("t", "seq"), by: Sequence[str] = ()) -> DataFrame:
    """Count a source's first report of a slot only, then add up the sources.

    A dimension belongs to the first report when its earliest order equals the
    source's earliest.  The first aggregation is per dimension and combines
    map-side, so a source with many reports shrinks before the shuffle; the
    window then sees one row per dimension.  ``by`` names further columns that
    the result keeps apart; they don't decide which report is the first.
    """
    dims = _present(reports, REPORT_DIMS)
    values = [n for n in dict.fromkeys([*by, *_present(reports, VALUE_DIMS)]) if n not in dims]
    rank = F.struct(*order)
    first = reports.groupBy(*dims, *values).agg(
        F.min(rank).alias("__first"), F.min_by("value", rank).alias("value")
    )
    earliest = F.min("__first").over(Window.partitionBy(*dims))
    kept = first.withColumn("__earliest", earliest).filter(F.col("__first") == F.col("__earliest"))
    return interval_scope(kept.drop("__first", "__earliest"), by)


def accumulate(
    reports: DataFrame, scope: str, order: Sequence[str] = ("t", "seq"), by: Sequence[str] = ()
) -> DataFrame:
    return point_scope(reports, order, by) if scope == "point" else interval_scope(reports, by)


def rollup(slots: DataFrame, start: int, duration: int, scope: str = "interval") -> DataFrame:
    """Value over ``[start, start+duration)``; gauges give their first slot."""
    end = start + (duration if scope == "interval" else 1)
    kept = slots.filter((F.col("slot") >= start) & (F.col("slot") < end))
    return merge(kept, _present(slots, ("inst_id", *VALUE_DIMS)))


def rollup_by(slots: DataFrame, width: int, scope: str = "interval") -> DataFrame:
    """The same for every aligned interval of ``width`` seconds at once."""
    period = down(F.col("slot"), width)
    rows = slots if scope == "interval" else slots.filter(F.col("slot") == period)
    return merge(rows.withColumn("period", period), _present_after(slots, "period"))


def _present_after(df: DataFrame, name: str) -> list[str]:
    return [*_present(df, ("inst_id",)), name, *_present(df, VALUE_DIMS)]


def zero_fill(values: DataFrame, spans: DataFrame, g: int, by: Sequence[str] = ()) -> DataFrame:
    """Scalar series with 0 for empty slots.

    ``spans`` holds one row per series with ``start`` and ``end`` (exclusive).
    """
    grid = spans.select(*by, F.explode(F.sequence("start", F.col("end") - g, F.lit(g))).alias("slot"))
    return grid.join(values, [*by, "slot"], "left").select(
        *by, "slot", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def reporting(reports: DataFrame) -> DataFrame:
    """Distinct sources per slot, undefined values included."""
    return reports.groupBy(*_present(reports, ("inst_id", "slot"))).agg(
        F.count_distinct("source").alias("reporting")
    )


def reporting_range(counts: DataFrame, width: int, g: int) -> DataFrame:
    """Least and most sources over every slot of each ``width`` interval.

    A slot without row counts 0, so fewer rows than slots means a minimum of 0.
    """
    by = _present(counts, ("inst_id",))
    return counts.groupBy(*by, down(F.col("slot"), width).alias("period")).agg(
        F.when(F.count("slot") < width // g, F.lit(0)).otherwise(F.min("reporting")).alias("min_reporting"),
        F.max("reporting").alias("max_reporting"),
    )


def dense(counts: DataFrame, g: int, chunk: int = 4096) -> DataFrame:
    """A row for every slot from an instrumentation's first to its last, 0 where nobody reported.

    Long series are laid out in chunks of slots, so no row holds them all.
    """
    by = _present(counts, ("inst_id",))
    ends = counts.groupBy(*by).agg(F.min("slot").alias("__low"), F.max("slot").alias("__high"))
    parts = ends.filter("__low is not null").withColumn(
        "__from", F.explode(F.sequence("__low", "__high", F.lit(chunk * g).cast("bigint")))
    )
    upto = F.least(F.col("__from") + (chunk - 1) * g, F.col("__high"))
    grid = parts.select(*by, F.explode(F.sequence("__from", upto, F.lit(g).cast("bigint"))).alias("slot"))
    return grid.join(counts, [*by, "slot"], "left").select(
        *by, "slot", F.coalesce("reporting", F.lit(0)).cast("bigint").alias("reporting")
    )


def expected(counts: DataFrame, g: int, chunk: int = 4096) -> DataFrame:
    """Sources to expect at each slot: the most seen in the settled window.

    A slot in which nobody reported has a row as well (see :func:`dense`).

    The window starts at ``down(t - SETTLE - WINDOW)`` and is ``up(WINDOW)``
    long.  It only reaches back a few slots, so long series are cut into
    chunks of slots that each repeat the last slots of the chunk before.
    """
    back = -(-(SETTLE + WINDOW) // g) * g
    length = -(-WINDOW // g) * g
    by = _present(counts, ("inst_id",))
    width = max(chunk * g, back)
    own = F.floor(F.col("slot") / width)
    homes = F.when(F.col("slot") >= (own + 1) * width - back, F.array(own, own + 1)).otherwise(F.array(own))
    rows = dense(counts, g, chunk).withColumn("__chunk", F.explode(homes))
    w = Window.partitionBy(*by, "__chunk").orderBy("slot").rangeBetween(-back, -back + length - g)
    return (
        rows.withColumn("expected", F.coalesce(F.max("reporting").over(w), F.lit(0)))
        .filter(F.col("__chunk") == own)
        .drop("__chunk")
    )


def complete(counts: DataFrame, g: int) -> DataFrame:
    """Whether every expected source has reported."""
    return expected(counts, g).withColumn("complete", F.col("reporting") >= F.col("expected"))


def not_from_future(reports: DataFrame, now: int | Column, time: str = "t") -> DataFrame:
    return reports.filter(F.col(time) - LEAD <= now)


def retain(slots: DataFrame, now: int | Column, retention: int, slot: Column | None = None) -> DataFrame:
    """Drop slots older than ``retention`` seconds; 0 keeps everything."""
    slot = F.col("slot") if slot is None else slot
    return slots if not retention else slots.filter(slot >= now - retention)


def on_sampling_grid(reports: DataFrame, g: int, time: str = "t") -> DataFrame:
    """Reports on seconds at which a source is due."""
    return reports.filter(F.pmod(F.col(time), F.lit(min(g, SLOWEST))) == 0)
