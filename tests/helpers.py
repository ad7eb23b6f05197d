"""Small tables of the values that sources report."""

from __future__ import annotations

from pyspark.sql import functions as F

SCHEMA = "inst_id string, source string, t bigint, seq bigint, key string, lo double, hi double, value double"


def reports(spark, updates, g=1):
    """``updates``: ``(source, time, value)`` with nested values, in order of arrival."""
    rows = []
    for seq, (source, t, value) in enumerate(updates):
        rows += [("i", source, t, seq, *r) for r in flat(value)]
    df = spark.createDataFrame(rows, SCHEMA)
    unused = [c for i, c in ((4, "key"), (5, "lo"), (6, "hi")) if all(r[i] is None for r in rows)]
    df = df.drop(*unused)
    return df.withColumn("slot", F.col("t") - F.col("t") % g)


def flat(value):
    """Rows ``(key, lo, hi, value)`` of a nested value."""
    if isinstance(value, dict):
        if not value:
            return [(None, None, None, None)]
        return [(k, *r[1:]) for k, v in value.items() for r in flat(v)]
    if isinstance(value, list):
        return [(None, float(lo), float(hi), float(n)) for (lo, hi), n in value] or [(None, None, None, None)]
    return [(None, None, None, None if value is None else float(value))]


def nested(df):
    """Long rows as a nested value."""
    rows = [r.asDict() for r in df.collect()]
    keyed = any(r.get("key") is not None for r in rows)
    ranged = any(r.get("lo") is not None for r in rows)
    if not rows:
        return None
    if ranged:
        out = {}
        for r in sorted(rows, key=lambda r: r["lo"]):
            out.setdefault(r.get("key"), []).append([[r["lo"], r["hi"]], r["value"]])
        return out if keyed else out[None]
    if keyed:
        return {r["key"]: r["value"] for r in rows}
    return rows[0]["value"]
