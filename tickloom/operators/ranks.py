"""Ranks over all distinct values of a column, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workdir import written

PART, HERE, BEFORE = "__part", "__here", "__before"


def dense_ranks(rows: DataFrame, value: Column, name: str = "level") -> tuple[DataFrame, int]:
    """(``name``, ``rank``) of the distinct non-NULL values, from 1 by rising value, and how many there are.

    The values are cut into ranges of about equal size, written, and ranked
    within their range; a range starts where the counts of those before it end.
    Values of any type with an order will do, and equal ones alone share a rank.
    """
    levels = rows.select(value.alias(name)).filter(F.col(name).isNotNull()).distinct()
    # written, as the borders of the ranges are sampled anew each time
    ranged = written(levels.repartitionByRange(name).withColumn(PART, F.spark_partition_id()), "ranks")
    counts = ranged.groupBy(PART).agg(F.count("*").alias(HERE))
    upto = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = counts.select(PART, F.coalesce(F.sum(HERE).over(upto), F.lit(0)).alias(BEFORE))
    local = F.row_number().over(Window.partitionBy(PART).orderBy(name))
    ranked = ranged.withColumn(HERE, local).join(starts, PART)
    return ranked.select(name, (F.col(HERE) + F.col(BEFORE)).alias("rank")), ranged.count()
