"""Order-dependent columns over the rows of one key.

A plain ``lag`` or running window puts all rows of a key into one task.  One
host or thread may hold a large part of the data, so the rows of a key are cut
into time slices.  A slice is worked on by itself and gets what it needs from
the earlier ones through a small per-slice summary (partial aggregation, one
row per key and slice).

The first column of ``order`` must be numeric time, and ``span`` is the width
of a slice in its unit; pick it so that one slice of the busiest key fits a
task.  Key columns must not be NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "__slice"
HALO = "__halo"
PREV = "__prev"


@dataclass(frozen=True)
class Timeline:
    keys: Sequence[str]
    order: Sequence[str]
    span: float

    @property
    def slice(self) -> Column:
        return F.floor(F.col(self.order[0]) / F.lit(self.span)).cast("bigint")

    def local(self):
        """Window inside one slice of one key."""
        return Window.partitionBy(*self.keys, SLICE).orderBy(*self.order)

    def across(self):
        """Window over the slices of one key."""
        return Window.partitionBy(*self.keys).orderBy(SLICE)


def previous(df: DataFrame, line: Timeline, carry: Mapping[str, Column]) -> DataFrame:
    """Add the ``carry`` values of the directly preceding row of the same key.

    All of them are NULL on a key's first row.  The last row of each slice is
    also sent to the next slice that has rows, where it precedes the others.
    """
    columns = df.columns
    sliced = df.select(
        *columns, line.slice.alias(SLICE), F.struct(*(c.alias(n) for n, c in carry.items())).alias(PREV)
    )
    rank = F.struct(*line.order)
    tails = (
        sliced.groupBy(*line.keys, SLICE)
        .agg(F.max_by(F.struct(*line.order, PREV), rank).alias("tail"))
        .withColumn(SLICE, F.lead(SLICE).over(line.across()))
        .filter(F.col(SLICE).isNotNull())
        .select(*line.keys, SLICE, "tail.*", F.lit(True).alias(HALO))
    )
    rows = sliced.withColumn(HALO, F.lit(False)).unionByName(tails, allowMissingColumns=True)
    return (
        rows.withColumn(PREV, F.lag(PREV).over(line.local()))
        .filter(~F.col(HALO))
        .select(*columns, *(F.col(f"{PREV}.{n}").alias(n) for n in carry))
    )


COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, line: Timeline, aggs: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Add running aggregates ``{name: ("sum"|"max"|"min", column)}``.

    Each includes its own row.  ``order`` must be a total order within a key.
    """
    columns = df.columns
    inputs = {n: f"__in_{n}" for n in aggs}
    sliced = df.select(*columns, line.slice.alias(SLICE), *(c.alias(inputs[n]) for n, (_, c) in aggs.items()))
    upto = line.local().rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select(
        *columns, SLICE, *(COMBINE[f](inputs[n]).over(upto).alias(n) for n, (f, _) in aggs.items())
    )
    before = line.across().rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.groupBy(*line.keys, SLICE)
        .agg(*(COMBINE[f](inputs[n]).alias(inputs[n]) for n, (f, _) in aggs.items()))
        .select(*line.keys, SLICE, *(COMBINE[f](inputs[n]).over(before).alias(inputs[n]) for n, (f, _) in aggs.items()))
    )
    out = local.join(carried, [*line.keys, SLICE], "left")
    merge = {
        "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
        "max": F.greatest,
        "min": F.least,
    }
    return out.select(
        *columns, *(merge[f](F.col(inputs[n]), F.col(n)).alias(n) for n, (f, _) in aggs.items())
    )
