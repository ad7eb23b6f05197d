"""Sums of points and merges of values.

All values are kept in long form, one row per dimension tuple:
``[inst_id] [slot] [source] [key] [lo hi] value``.  Spark's partial aggregation
adds up a source's rows before anything is shuffled, so a busy key costs one
row per task.  :func:`pack` makes the nested shapes at the edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import Range


def total(df: DataFrame, value: str = "value") -> DataFrame:
    """One row; 0 without points."""
    return df.agg(F.coalesce(F.sum(value), F.lit(0)).alias("value"))


def decompose(
    df: DataFrame,
    *,
    key: Column | None = None,
    rng: Range | None = None,
    by: Sequence[Column | str] = (),
    value: Column | str = "value",
) -> DataFrame:
    """Sum of ``value`` by one discrete key and/or one bucketed numeric field.

    ``by`` adds outer dimensions such as the slot.  ``hi`` follows from ``lo``
    and is added to the groups, not to the rows.
    """
    dims = list(by)
    if key is not None:
        dims.append(key.alias("key"))
    if rng is None:
        if not dims:
            return total(df.select((F.col(value) if isinstance(value, str) else value).alias("value")))
        return df.groupBy(*dims).agg(F.sum(value).alias("value"))
    sums = df.groupBy(*dims, rng.lo.alias("lo")).agg(F.sum(value).alias("value"))
    return sums.select(*sums.columns[:-2], "lo", rng.hi_of(F.col("lo")).alias("hi"), "value")


def merge(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Add the values of equal dimensions; undefined values count as zero."""
    if "lo" in dims:
        rest = [d for d in dims if d != "hi"]
        return df.groupBy(*rest).agg(F.max("hi").alias("hi"), F.sum("value").alias("value"))
    if not dims:
        return total(df)
    return df.groupBy(*dims).agg(F.sum("value").alias("value"))


def conflicting_ranges(df: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """Ranges that start alike but end differently: must be empty before a merge."""
    return (
        df.groupBy(*dims, "lo")
        .agg(F.min("hi").alias("min_hi"), F.max("hi").alias("max_hi"))
        .filter(F.col("min_hi") != F.col("max_hi"))
    )


def union_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Long-form rows of several sources of one metric."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def keys_present(df: DataFrame, start: int, duration: int) -> DataFrame:
    """Distinct keys with data in ``[start, start+duration)``."""
    return df.filter((F.col("slot") >= start) & (F.col("slot") < start + duration)).select("key").distinct()


def for_key(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col("key") == key).drop("key")


def over_keys(df: DataFrame) -> DataFrame:
    """Distribution per slot over all keys."""
    return merge(df, [c for c in ("inst_id", "slot", "lo") if c in df.columns])


def last_seen(df: DataFrame, time: str = "t") -> DataFrame:
    return df.groupBy("source").agg(F.max(time).alias("last_seen"))


def sources_total(hosts: DataFrame) -> DataFrame:
    """Number of known hosts (pass the ownership result for a customer)."""
    return hosts.agg(F.count_distinct("hostname").alias("nsources"))


# --- packed values ----------------------------------------------------------


def pack_distribution(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``ARRAY<STRUCT<lo,hi,value>>`` sorted by ``lo``, per ``by``."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "value"))).alias("value"))


def pack_keys(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``MAP<key, value>`` per ``by`` with the keys in order."""
    return df.groupBy(*by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("value")
    )


def pack(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Nest long rows: one value per ``by`` tuple.

    The arrays hold one entry per bucket (log-linear: ``n`` per power) or key
    of *one* slot or interval, not of the data behind it.
    """
    keyed, ranged = "key" in df.columns, "lo" in df.columns
    if keyed and ranged:
        return pack_keys(pack_distribution(df, [*by, "key"]), by)
    if ranged:
        return pack_distribution(df, by)
    return pack_keys(df, by) if keyed else df.select(*by, "value")


def unpack(df: DataFrame) -> DataFrame:
    """Back to long rows from any packed shape."""
    kind = df.schema["value"].dataType.typeName()
    rest = [c for c in df.columns if c != "value"]
    if kind == "map":
        return unpack(df.select(*rest, F.explode("value").alias("key", "value")))
    if kind == "array":
        return df.select(*rest, F.inline("value"))
    return df


def _never(_: Column, __: Column) -> Column:
    return F.lit(False)


def add_keyed(a: Column, b: Column) -> Column:
    """Sum of two packed ``MAP<key, number>``; a missing key counts as 0, a NULL side as empty."""
    zero = F.lit(0.0)
    a, b = F.coalesce(a, F.map_filter(b, _never)), F.coalesce(b, F.map_filter(a, _never))
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def add_distributions(a: Column, b: Column) -> Column:
    """Sum of two packed distributions, sorted by ``lo``; a NULL side counts as empty."""
    a, b = F.coalesce(a, F.slice(b, 1, 0)), F.coalesce(b, F.slice(a, 1, 0))
    as_map = lambda d: F.map_from_entries(
        F.transform(d, lambda e: F.struct(F.struct(e["lo"].alias("lo"), e["hi"].alias("hi")), e["value"]))
    )
    summed = F.map_entries(add_keyed(as_map(a), as_map(b)))
    return F.array_sort(
        F.transform(
            summed, lambda e: F.struct(e["key"]["lo"].alias("lo"), e["key"]["hi"].alias("hi"), e["value"].alias("value"))
        )
    )
