"""Value requests: which interval is asked for and what is the answer.

Requests are a table ``(request_id, inst_id, start_time, duration, end_time,
ndatapoints)`` with NULL for what was left out, so one job answers many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregate import merge, pack
from .slots import SETTLE, down, up

# --- fixed values: limits and defaults of a request ---------------------------
MAX_DURATION = 3600
DEFAULT_DURATION = {"raw": 1, "average": 1, "percentile": 1, "image": 60, "details": 60}
# ------------------------------------------------------------------------------


def limit_errors(requests: DataFrame, now: int | Column, timeout: int = SETTLE, g: int | Column = 1) -> DataFrame:
    """Requests with their first violated limit in ``error`` (NULL = fine)."""
    last_end = _latest_end(g)
    error = (
        F.when((F.col("duration") < 1) | (F.col("duration") > MAX_DURATION), "duration out of range")
        .when(F.col("ndatapoints") < 1, "ndatapoints must be positive")
        .when((F.col("start_time") < 0) | (F.col("end_time") < 0), "times must not be negative")
        .when(last_end > now + timeout, "request ends in the future")
    )
    return requests.withColumn("error", error)


def _latest_end(g: int | Column) -> Column:
    """End of the last interval asked for, where the request fixes one."""
    n = F.coalesce(F.col("ndatapoints"), F.lit(1))
    step = F.coalesce(F.col("duration"), F.col("end_time") - F.col("start_time"), F.lit(1))
    start = F.coalesce(F.col("start_time"), F.col("end_time") - step)
    return down(start, g) + up(step, g) * n


def infer_interval(requests: DataFrame, now: int | Column, default_duration: int, g: int | Column = 1) -> DataFrame:
    """Complete ``start_time`` and ``duration`` from any two of the three times.

    Adds ``error``; a request with an error keeps NULL start and duration.  An
    error that is there already, e.g. of :func:`limit_errors`, stands.
    """
    start, length, end = F.col("start_time"), F.col("duration"), F.col("end_time")
    no_start, no_length, no_end = start.isNull(), length.isNull(), end.isNull()
    d = F.coalesce(length, F.when(~no_start & ~no_end, end - start), F.lit(default_duration))
    s = F.when(~no_start, start).when(~no_end, end - d).otherwise(now - d - g)
    error = (
        F.when(no_start & ~no_end & (d > end), '"duration" cannot exceed "end_time"')
        .when(~no_start & ~no_end & no_length & (end <= start), '"end_time" must be later than "start_time"')
        .when(
            ~no_start & ~no_end & ~no_length & (start + length != end),
            '"start_time" + "duration" must equal "end_time"',
        )
        .when(d < 1, '"duration" must be positive')
    )
    if "error" in requests.columns:
        error = F.coalesce(F.col("error"), error)
    out = requests.select(
        *[c for c in requests.columns if c not in ("start_time", "duration", "end_time", "error")],
        s.cast("bigint").alias("start_time"),
        d.cast("bigint").alias("duration"),
        error.alias("error"),
    )
    bad = F.col("error").isNotNull()
    return out.withColumns(
        {c: F.when(~bad, F.col(c)) for c in ("start_time", "duration")}
    )


def data_points(requests: DataFrame, g: int | Column) -> DataFrame:
    """One row per data point of valid requests.

    The start is slotted once and the slotted duration steps, while the
    requested times step by the requested duration.
    """
    gc = g if isinstance(g, Column) else F.lit(g)
    n = F.coalesce(F.col("ndatapoints"), F.lit(1))
    valid = F.col("start_time").isNotNull() & F.col("duration").isNotNull() & gc.isNotNull() & (n >= 1)
    asked = F.when(valid, F.sequence(F.lit(0), (n - 1).cast("int")))
    # What is refused goes after its row is laid out, and the interval is said to be never NULL: conditions on
    # either would be pushed below, with all of the expressions that check a request written out in them.
    rows = requests.withColumn("point", F.explode_outer(asked)).filter("point is not null")
    set_ = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    width = set_(up(F.col("duration"), gc))
    return rows.select(
        "request_id",
        "inst_id",
        "point",
        set_(down(F.col("start_time"), gc) + F.col("point") * width).alias("start"),
        width.alias("width"),
        (F.col("start_time") + F.col("point") * F.col("duration")).alias("requested_start"),
        F.col("duration").alias("requested_duration"),
        (F.col("start_time") + (F.col("point") + 1) * F.col("duration")).alias("requested_end"),
    )


def checked(
    requests: DataFrame, now: int | Column, default_duration: int, g: int | Column = 1, timeout: int = SETTLE
) -> DataFrame:
    """Requests with their interval or the first limit or rule that they violate."""
    return infer_interval(limit_errors(requests, now, timeout, g), now, default_duration, g)


INTERVAL = ("inst_id", "start", "width")


def intervals(points: DataFrame) -> DataFrame:
    """Distinct intervals: many requests ask for the same, each is read once."""
    return points.select(*INTERVAL).distinct()


def slots_of(spans: DataFrame, g: int, scope: str = "interval") -> DataFrame:
    """A row per slot of each interval (at most MAX_DURATION / g): the range
    condition ``slot in [start, end)`` becomes an equi-join on the slot."""
    last = F.col("start") + F.col("width") - g if scope == "interval" else F.col("start")
    return spans.withColumn("slot", F.explode(F.sequence("start", last, F.lit(g).cast("bigint"))))


def interval_values(spans: DataFrame, slots: DataFrame, g: int, scope: str = "interval") -> DataFrame:
    """Long-form value of each distinct interval."""
    dims = [c for c in ("key", "lo", "hi") if c in slots.columns]
    hit = slots_of(spans, g, scope).join(slots, ["inst_id", "slot"])
    return merge(hit, [*INTERVAL, *dims])


def values(points: DataFrame, slots: DataFrame, g: int, scope: str = "interval") -> DataFrame:
    """Long-form value of every data point."""
    found = interval_values(intervals(points), slots, g, scope)
    return points.select("request_id", "point", *INTERVAL).join(found, list(INTERVAL)).drop(*INTERVAL)


def packed_values(
    points: DataFrame,
    slots: DataFrame,
    g: int,
    scope: str = "interval",
    render: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Nested value of every data point, packed (and rendered) once per interval."""
    packed = pack(interval_values(intervals(points), slots, g, scope), INTERVAL)
    if render is not None:
        packed = packed.withColumn("value", render(F.col("value")))
    return points.select("request_id", "point", *INTERVAL).join(packed, list(INTERVAL)).drop(*INTERVAL)


def _completeness(points: DataFrame, counts: DataFrame, g: int, nsources: DataFrame | None) -> DataFrame:
    """``minreporting`` and ``nsources`` of each distinct interval."""
    cells = slots_of(intervals(points), g).join(counts, ["inst_id", "slot"], "left")
    out = cells.groupBy(*INTERVAL).agg(F.min(F.coalesce("reporting", F.lit(0))).alias("minreporting"))
    if nsources is None:
        return out.withColumn("nsources", F.lit(0).cast("bigint"))
    return out.join(nsources, "inst_id", "left").withColumn("nsources", F.coalesce("nsources", F.lit(0)))


def _envelope_columns() -> list[Column]:
    return [
        F.col("request_id"),
        F.col("point"),
        F.col("start").alias("start_time"),
        F.col("width").alias("duration"),
        (F.col("start") + F.col("width")).alias("end_time"),
        F.col("requested_start").alias("requested_start_time"),
        F.col("requested_duration"),
        F.col("requested_end").alias("requested_end_time"),
        F.col("nsources"),
        F.col("minreporting"),
    ]


def envelope(points: DataFrame, counts: DataFrame, g: int, nsources: DataFrame | None = None) -> DataFrame:
    """Times and completeness of each data point.

    ``counts`` is :func:`slots.reporting`, ``nsources`` holds ``(inst_id,
    nsources)``; unknown means 0.
    """
    return points.join(_completeness(points, counts, g, nsources), list(INTERVAL)).select(*_envelope_columns())


def answer(
    points: DataFrame, slots: DataFrame, counts: DataFrame, g: int, scope: str = "interval", nsources=None
) -> DataFrame:
    """Envelope and packed value of every data point; NULL value = zero."""
    packed = pack(interval_values(intervals(points), slots, g, scope), INTERVAL)
    known = _completeness(points, counts, g, nsources).join(packed, list(INTERVAL), "left")
    return points.join(known, list(INTERVAL)).select(*_envelope_columns(), "value")
