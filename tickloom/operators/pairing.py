"""Pairing of start and done events.

Events are rows in a total order ``(ts_ns, seq)`` per correlation key (a
thread, or a tuple such as ``(pid, request id)``).  A *done* pairs with the row
directly before it when that is a *start*: a later start overwrites, a done
clears, and a done without a start gives nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import SLICE, Timeline, previous, running

ORDER = ("ts_ns", "seq")
HOUR_NS = 3_600_000_000_000.0


def timeline(keys: Sequence[str], order: Sequence[str] = ORDER, span: float = HOUR_NS) -> Timeline:
    return Timeline(list(keys), list(order), span)


def pair(
    events: DataFrame,
    line: Timeline,
    start: Column,
    done: Column,
    gather: Mapping[str, Column],
    clears: Column | None = None,
    require_start: bool = True,
) -> DataFrame:
    """Done events with the values gathered at their start.

    Without ``require_start`` a done without a start stays, with NULLs.  With nothing to gather every done counts and no pairing takes place.
    ``clears`` names the done events that end the pending start, by default all
    of them: a done outside it is invisible.
    """
    if not gather:
        return events.filter(done)
    ends = done if clears is None else (done & clears)
    rows = events.filter(start | ends)
    carry = {"__started": start, **{f"__{n}": c for n, c in gather.items()}}
    prev = previous(rows, line, carry)
    kept = prev.filter(done & F.col("__started")) if require_start else prev.filter(done)
    return kept.select(
        *events.columns, *(F.when(F.col("__started"), F.col(f"__{n}")).alias(n) for n in gather)
    )


def latency(start: str = "start_ts", ts: str = "ts_ns") -> Column:
    return F.col(ts) - F.col(start)


def cpu_time(start: str = "start_vts", vts: str = "vts_ns") -> Column:
    return F.col(vts) - F.col(start)


def nesting_depth(events: DataFrame, line: Timeline, enter: Column, leave: Column) -> DataFrame:
    """Enter/leave rows with ``depth`` after the row; unmatched leaves stay at 0.

    depth = S - min(0, lowest S so far) for the running sum S of +1/-1.  Per
    slice the sum and its lowest point suffice to start the next slice.
    """
    rows = events.filter(enter | leave).withColumn("__step", F.when(enter, 1).otherwise(-1))
    sliced = rows.withColumn(SLICE, line.slice)
    upto = line.local().rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("__s", F.sum("__step").over(upto)).withColumn("__low", F.min("__s").over(upto))
    per_slice = local.groupBy(*line.keys, SLICE).agg(
        F.sum("__step").alias("__sum"), F.min("__s").alias("__min")
    )
    before = line.across().rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).withColumn(
        "__lowest", F.least(F.coalesce(F.min(F.col("__base") + F.col("__min")).over(before), F.lit(0)), F.lit(0))
    ).select(*line.keys, SLICE, "__base", "__lowest")
    joined = local.join(carried, [*line.keys, SLICE])
    depth = F.col("__base") + F.col("__s") - F.least(F.col("__lowest"), F.col("__base") + F.col("__low"))
    return joined.select(*events.columns, (F.col("__step") == 1).alias("is_enter"), depth.alias("depth"))


def outermost(
    events: DataFrame, line: Timeline, enter: Column, leave: Column, gather: Mapping[str, Column]
) -> DataFrame:
    """Outermost leave events with the values gathered at their enter.

    Calls nested inside another call of the same key are ignored.
    """
    deep = nesting_depth(events, line, enter, leave)
    # An outermost enter makes depth 1; a leave back to 0 ends it unless the
    # row before was at 0 already (a leave without enter).
    edges = deep.filter((F.col("is_enter") & (F.col("depth") == 1)) | (~F.col("is_enter") & (F.col("depth") == 0)))
    return pair(edges, line, F.col("is_enter"), ~F.col("is_enter"), gather).drop("is_enter", "depth")


def operation_id(events: DataFrame, line: Timeline, is_done: Column) -> DataFrame:
    """Number the logical operations of a key: each ends with a done row."""
    numbered = running(events, line, {"__ends": ("sum", is_done.cast("int"))})
    return numbered.withColumn("op", F.col("__ends") - is_done.cast("int")).drop("__ends")


def classify_phases(
    events: DataFrame,
    line: Timeline,
    phases: Mapping[int, Column],
    done: Column,
    at_done: Mapping[str, Column],
    resets: Sequence[int] = (),
    gather: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per finished operation with the bits of the phases it went through.

    ``phases`` maps a bit to the rows that set it; rows since the last done
    belong together.  A phase in ``resets`` starts the mask anew.  Gives
    ``mask``, the ``gather`` values of the last phase row and the ``at_done``
    values.  A done without any phase gives nothing.
    """
    gather = gather or {"start_ts": F.col(line.order[0])}
    bits = F.lit(0)
    for bit, rows in phases.items():
        bits = F.when(rows, F.lit(bit)).otherwise(bits)
    marked = events.withColumns({"__bit": bits, "__done": done}).filter((F.col("__bit") > 0) | F.col("__done"))
    ops = operation_id(marked, line, F.col("__done"))
    rank = F.struct(*line.order)
    last = {b: F.max(F.when(F.col("__bit") == b, rank)).alias(f"__last{b}") for b in phases}
    named = lambda cols: F.struct(*(c.alias(n) for n, c in cols.items()))
    grouped = ops.groupBy(*line.keys, "op").agg(
        *last.values(),
        F.max_by(F.when(F.col("__bit") > 0, named(gather)), F.when(F.col("__bit") > 0, rank)).alias("__start"),
        F.max_by(F.when(F.col("__done"), named(at_done)), F.when(F.col("__done"), rank)).alias("__end"),
    )
    mask = F.lit(0)
    for bit in phases:
        mine = F.col(f"__last{bit}")
        alive = mine.isNotNull()
        for reset in resets:
            other = F.col(f"__last{reset}")
            alive = alive & (other.isNull() | (mine >= other))
        mask = mask + F.when(alive, F.lit(bit)).otherwise(F.lit(0))
    return (
        grouped.withColumn("mask", mask)
        .filter(F.col("__end").isNotNull() & (F.col("mask") > 0))
        .select(
            *line.keys,
            "op",
            "mask",
            *(F.col(f"__start.{n}").alias(n) for n in gather),
            *(F.col(f"__end.{n}").alias(n) for n in at_done),
        )
    )


def outside(events: DataFrame, line: Timeline, opens: Column, closes: Column, inner: Column) -> DataFrame:
    """Drop ``inner`` rows that lie between an ``opens`` and the next ``closes`` row."""
    marker = F.when(opens | closes, F.struct(*line.order, opens.alias("open")))
    state = running(events, line, {"__state": ("max", marker)})
    return state.filter(~(inner & F.coalesce(F.col("__state.open"), F.lit(False)))).drop("__state")
