"""Sources: reports, counters, probe events, processes, storage, catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.counters import record_key

REPORT_SCHEMA = T.StructType(
    [
        T.StructField("inst_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("ts_ms", T.DoubleType()),
        T.StructField("seq", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("lo", T.DoubleType()),
        T.StructField("hi", T.DoubleType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# --- fixed values: process records --------------------------------------------------
UNKNOWN_ZONE = "shutting-down"
MODELS = {1: "32-bit"}
DEFAULT_MODEL = "64-bit"
STORAGE_NONE = "-"
# --------------------------------------------------------------------------------------


def clean_reports(reports: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Reports that can be used, with ``t`` in whole seconds; batch or stream.

    Rows without instrumentation or time, and rows of instrumentations that
    are not in ``active(inst_id)``, are dropped.
    """
    ms = F.col("ts_ms").cast("double")
    kept = reports.filter(F.col("inst_id").isNotNull() & ms.isNotNull() & ~F.isnan(ms)).withColumn(
        "t", F.floor(ms / 1000).cast("bigint")
    )
    return kept if active is None else kept.join(active.select("inst_id"), "inst_id", "left_semi")


def counters(snapshots: DataFrame, **record: str) -> DataFrame:
    """Counter records selected by exact ``module``, ``class`` or ``name``."""
    rows = snapshots
    for column, wanted in record.items():
        rows = rows.filter(F.col(column.rstrip("_")) == wanted)
    if "error" in rows.columns:
        rows = rows.filter(F.col("error").isNull())
    return rows.withColumn("record", record_key())


def probe_events(events: DataFrame, probes: Sequence[str], column: str = "probe") -> DataFrame:
    return events.filter(F.col(column).isin(*probes))


def until_nul(text: Column) -> Column:
    """Text of a fixed-width buffer."""
    return F.substring_index(text, "\0", 1)


def processes(records: DataFrame, zones: DataFrame) -> DataFrame:
    """Process snapshots with readable fields.

    ``records``: ``pr_pid, pr_ppid, pr_fname, pr_psargs, pr_zoneid, pr_rssize
    (KB), pr_dmodel, pr_nlwp, pr_contract``; ``zones``: ``zoneid, zonename``.
    """
    model = F.lit(DEFAULT_MODEL)
    for code, text in MODELS.items():
        model = F.when(F.col("pr_dmodel") == code, text).otherwise(model)
    named = records.join(zones.withColumnRenamed("zoneid", "pr_zoneid"), "pr_zoneid", "left")
    rest = [c for c in records.columns if not c.startswith("pr_")]
    return named.select(
        *rest,
        F.col("pr_pid").cast("string").alias("pid"),
        F.col("pr_ppid").cast("string").alias("ppid"),
        until_nul(F.col("pr_fname")).alias("execname"),
        until_nul(F.col("pr_psargs")).alias("psargs"),
        F.coalesce("zonename", F.lit(UNKNOWN_ZONE)).alias("zonename"),
        (F.col("pr_rssize") * 1024).alias("rss"),
        F.col("pr_contract").alias("contract"),
        model.alias("pmodel"),
        F.col("pr_nlwp").alias("nthreads"),
    )


def kept_name(columns: Sequence[str], name: str = "other") -> str:
    """The column for values that are no numbers: ``other``, underlined as often as the listing's own columns need it."""
    while name in columns:
        name = f"_{name}"
    return name


def storage_list(
    spark: SparkSession, path: str, columns: Sequence[str], text: Sequence[str] = (), unique: bool = True
) -> DataFrame:
    """Tab-separated listing; the first column names the object.

    ``-`` reads as 0.  Columns are whole numbers unless named in ``text``; a
    value that is no number reads as NULL there and is kept in the last column
    (:func:`kept_name`), a map from column to text (NULL if there is none).  A
    listing that names an object twice is refused, unless ``unique`` is false.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.csv(path, sep="\t", schema=schema)
    name, *rest = columns
    numbers = [c for c in rest if c not in text]
    kept = F.map_filter(
        F.create_map(*[x for c in numbers for x in (F.lit(c), F.col(c))]) if numbers else F.create_map(),
        lambda _, value: (value != STORAGE_NONE) & value.try_cast("bigint").isNull(),
    ).cast("map<string, string>")
    other = F.when(F.size(kept) > 0, kept).alias(kept_name(["name", *rest]))
    listed = raw.select(F.col(name).alias("name"), *(_storage_value(c, c in text) for c in rest), other)
    return require_unique(listed) if unique else listed


def _storage_value(column: str, is_text: bool) -> Column:
    value = F.when(F.col(column) == STORAGE_NONE, F.lit("0")).otherwise(F.col(column))
    return (value if is_text else value.try_cast("bigint")).alias(column)


def duplicate_names(objects: DataFrame) -> DataFrame:
    return objects.groupBy("name").count().filter(F.col("count") > 1).select("name", "count")


def require_unique(objects: DataFrame) -> DataFrame:
    twice = [r["name"] for r in duplicate_names(objects).limit(10).collect()]
    if twice:
        raise ValueError(f"objects listed twice: {twice}")
    return objects


# --- catalog -----------------------------------------------------------------------------

CATALOG_SCHEMA = """
    modules map<string, struct<label: string>>,
    types map<string, struct<arity: string, unit: string, abbr: string, base: int, power: int, minmax: bigint>>,
    fields map<string, struct<label: string, type: string>>,
    metrics array<struct<module: string, stat: string, label: string, unit: string, type: string,
                         interval: string, fields: array<string>>>
"""
PROFILE_SCHEMA = """
    name string, label string, metrics array<struct<module: string, stat: string, fields: array<string>>>
"""


def catalog(spark: SparkSession, path: str, multiline: bool = True) -> Mapping[str, DataFrame]:
    """``modules, types, fields, metrics`` of a catalog file or folder tree."""
    docs = spark.read.schema(CATALOG_SCHEMA).json(path, multiLine=multiline, recursiveFileLookup=True)
    out = {
        part: docs.select(F.explode(part).alias("name", "v")).select("name", "v.*")
        for part in ("modules", "types", "fields")
    }
    out["metrics"] = docs.select(F.inline("metrics")).withColumn(
        "interval", F.coalesce("interval", F.lit("interval"))
    )
    return out


def metric_fields(metrics: DataFrame) -> DataFrame:
    return metrics.select("module", "stat", F.explode("fields").alias("field"))


def profiles(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """``name, label, place, module, stat, field`` of the profile files; ``place`` numbers a profile's metrics."""
    docs = spark.read.schema(PROFILE_SCHEMA).json(path, multiLine=multiline, recursiveFileLookup=True)
    listed = docs.select("name", "label", F.posexplode_outer("metrics").alias("place", "metric"))
    return listed.select("name", "label", "place", "metric.module", "metric.stat", F.explode_outer("metric.fields").alias("field"))
