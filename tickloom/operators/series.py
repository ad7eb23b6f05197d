"""Keyed time series for display: gaps, top keys and the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHERS = "<other>"


def with_gaps(slots: DataFrame, span: DataFrame | tuple[int, int], g: int, by: Sequence[str] = ()) -> DataFrame:
    """Dense series over ``span``: ``(start, end)``, or a table ``by..., start, end``.

    In a slot that holds any data a missing key is 0; in a slot without data
    every key is NULL.  The result has one row per key and slot.
    """
    known = slots.select(*by, "key").distinct()
    if isinstance(span, DataFrame):
        known = known.join(span, list(by))
    else:
        known = known.withColumns({"start": F.lit(span[0]), "end": F.lit(span[1])})
    grid = known.select(*by, "key", F.explode(_slots(g)).alias("slot"))
    filled = slots.select(*by, "slot").distinct().withColumn("__has", F.lit(True))
    return (
        grid.join(slots, [*by, "slot", "key"], "left")
        .join(filled, [*by, "slot"], "left")
        .select(*by, "key", "slot", F.when(F.col("__has"), F.coalesce("value", F.lit(0.0))).alias("value"))
    )


def _slots(g: int):
    start = F.col("start").cast("bigint")
    return F.sequence(start, F.col("end").cast("bigint") - g, F.lit(g).cast("bigint"))


def key_totals(slots: DataFrame) -> DataFrame:
    return slots.groupBy("key").agg(F.sum("value").alias("total"))


def ranked_keys(slots: DataFrame) -> DataFrame:
    """Keys by total, largest first, ties by name."""
    return key_totals(slots).orderBy(F.desc("total"), F.asc("key"))


def top_keys(slots: DataFrame, n: int) -> DataFrame:
    return ranked_keys(slots).limit(n)


def top_series(slots: DataFrame, n: int) -> DataFrame:
    """Series of the ``n`` largest keys."""
    return slots.join(F.broadcast(top_keys(slots, n).select("key")), "key", "left_semi")


def top_and_others(slots: DataFrame, n: int) -> DataFrame:
    """Top series plus one series that adds up all other keys.

    ``n`` rows are broadcast.  The rest is missing when there is none.
    """
    top = top_keys(slots, n).select(F.col("key").alias("__top"))
    named = slots.join(F.broadcast(top), F.col("key") == F.col("__top"), "left").withColumn(
        "key", F.coalesce("__top", F.lit(OTHERS))
    )
    return named.groupBy("slot", "key").agg(F.sum("value").alias("value"))
