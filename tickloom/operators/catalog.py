"""Catalog, profiles and ownership as DataFrames.

``metrics(module, stat, label, unit, type, interval, fields ARRAY)``,
``fields(name, label, type)``, ``types(name, arity, unit, abbr, base, power,
minmax)``, ``modules(name, label)``; metric sets and profiles in long form
``(module, stat, field)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRIC = ("module", "stat")
NAME_PATTERN = r"^\w+$"
ARITIES = ("discrete", "numeric")
BASES = (2, 10)
BUILT_IN_TYPE = "string"


# --- metric sets of hosts -------------------------------------------------------


def current_of_hosts(announcements: DataFrame) -> DataFrame:
    """Latest set of each host: a new announcement replaces the earlier one.

    ``announcements``: ``host, announced, module, stat, field``.  Repeats are
    folded before a host's rows meet.
    """
    latest = announcements.groupBy("host", *METRIC, "field").agg(F.max("announced").alias("announced"))
    newest = F.max("announced").over(Window.partitionBy("host"))
    return (
        latest.withColumn("__newest", newest)
        .filter(F.col("announced") == F.col("__newest"))
        .select("host", *METRIC, "field")
    )


def union_of_hosts(announcements: DataFrame) -> DataFrame:
    """Everything any host ever announced; it never shrinks."""
    return announcements.select(*METRIC, "field").distinct()


def base_metrics(metric_set: DataFrame) -> DataFrame:
    """One row per metric with its fields (a metric has at most all fields of
    the catalog)."""
    return metric_set.groupBy(*METRIC).agg(F.array_sort(F.collect_set("field")).alias("fields"))


def supports(metric_set: DataFrame, requested: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requests answered with ``supported``: the metric is known with all fields.

    ``requested``: ``request_id, module, stat, field``; a request without
    fields is one row with a NULL field.  ``by=("host",)`` asks one host each.
    """
    keys = [*by, *METRIC]
    known = metric_set.select(*keys, "field").distinct().withColumn("__known", F.lit(1))
    metrics = metric_set.select(*keys).distinct().withColumn("__metric", F.lit(True))
    return (
        requested.join(known, [*keys, "field"], "left")
        .groupBy("request_id", *keys)
        .agg((F.count("field") == F.count("__known")).alias("__all"))
        .join(metrics, keys, "left")
        .select("request_id", *keys, (F.col("__all") & F.coalesce("__metric", F.lit(False))).alias("supported"))
    )


def missing_fields(metric_set: DataFrame, requested: DataFrame) -> DataFrame:
    return requested.join(metric_set, [*METRIC, "field"], "left_anti")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metrics of both sets with their common fields.

    A metric of both stays even if no field is common.
    """
    left, right = base_metrics(a), base_metrics(b).withColumnRenamed("fields", "other")
    return left.join(right, list(METRIC)).select(
        *METRIC, F.array_sort(F.array_intersect("fields", "other")).alias("fields")
    )


def merge_names(first, second):
    """Union of two ordered name lists, first-seen order."""
    return F.array_union(first, second)


# --- catalog maintenance ----------------------------------------------------------


def conflicts(declared: DataFrame, name: Sequence[str] = ("name",), over: Sequence[str] | None = None) -> DataFrame:
    """Names declared in more than one way."""
    rest = list(over) if over is not None else [c for c in declared.columns if c not in name]
    return (
        declared.groupBy(*name)
        .agg(F.count_distinct(F.struct(*rest)).alias("variants"))
        .filter(F.col("variants") > 1)
    )


def merge_metrics(declared: DataFrame, order: str = "seq") -> DataFrame:
    """Metrics declared by several hosts as one row each.

    Fields in first-seen order; ``point`` wins over ``interval``.
    ``declared``: ``module, stat, interval, fields, <order>``.
    """
    seen = declared.select(*METRIC, "interval", order, F.posexplode_outer("fields").alias("pos", "field"))
    firsts = seen.groupBy(*METRIC, "field").agg(
        F.min(F.struct(order, "pos")).alias("first"), F.max("interval").alias("interval")
    )
    # max('interval', 'point') = 'point': the stronger scope also sorts last.
    packed = F.array_sort(
        F.collect_list(F.when(F.col("field").isNotNull(), F.struct("first", "field")))
    )
    return firsts.groupBy(*METRIC).agg(
        F.max("interval").alias("interval"), F.transform(packed, lambda s: s["field"]).alias("fields")
    )


def violations(modules: DataFrame, types: DataFrame, fields: DataFrame, metrics: DataFrame) -> DataFrame:
    """``(kind, name, problem)`` for every broken rule of a catalog."""

    def bad(df, kind, name, cond, problem):
        return df.filter(cond).select(
            F.lit(kind).alias("kind"), name.alias("name"), F.lit(problem).alias("problem")
        )

    named = F.col("name")
    metric_name = F.concat_ws(".", *METRIC)
    known_types = types.select("name").union(
        types.sparkSession.range(1).select(F.lit(BUILT_IN_TYPE).alias("name"))
    )
    uses = metrics.select(*METRIC, F.explode("fields").alias("field"))
    parts = [
        bad(df, kind, named, ~named.rlike(NAME_PATTERN), "bad name")
        for kind, df in (("module", modules), ("type", types), ("field", fields))
    ] + [
        bad(types, "type", named, ~F.col("arity").isin(*ARITIES) | F.col("arity").isNull(), "bad arity"),
        bad(types, "type", named, F.col("base").isNotNull() & ~F.col("base").isin(*BASES), "bad base"),
        bad(types, "type", named, F.col("base").isNotNull() & F.col("unit").isNull(), "base without unit"),
        bad(types, "type", named, F.col("power").isNotNull() & F.col("base").isNull(), "power without base"),
        bad(
            fields.filter(F.col("type").isNotNull()).join(
                known_types.withColumnRenamed("name", "type"), "type", "left_anti"
            ),
            "field", named, F.lit(True), "unknown type",
        ),
        bad(
            metrics.join(modules.select(F.col("name").alias("module")), "module", "left_anti"),
            "metric", metric_name, F.lit(True), "unknown module",
        ),
        bad(
            metrics.filter(F.col("type").isNotNull()).join(
                known_types.withColumnRenamed("name", "type"), "type", "left_anti"
            ),
            "metric", metric_name, F.lit(True), "unknown type",
        ),
        bad(metrics, "metric", metric_name, F.col("unit").isNull() & F.col("type").isNull(), "neither unit nor type"),
        bad(
            uses.join(fields.select(F.col("name").alias("field")), "field", "left_anti"),
            "metric", metric_name, F.lit(True), "unknown field",
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def describe(metric_set: DataFrame, modules: DataFrame, fields: DataFrame, types: DataFrame) -> DataFrame:
    """Modules, fields and types that a metric set reaches: ``(kind, name, label)``."""
    used = metric_set.select(F.col("field").alias("name")).distinct()
    kept = fields.join(used, "name", "left_semi")
    used_types = kept.select(F.coalesce("type", F.lit(BUILT_IN_TYPE)).alias("name")).distinct()
    mods = modules.join(metric_set.select(F.col("module").alias("name")).distinct(), "name", "left_semi")
    return (
        mods.select(F.lit("module").alias("kind"), "name", "label")
        .unionByName(kept.select(F.lit("field").alias("kind"), "name", "label"))
        .unionByName(
            used_types.join(types, "name", "left").select(
                F.lit("type").alias("kind"), "name", F.coalesce("arity", F.lit("discrete")).alias("label")
            )
        )
    )


def field_arities(fields: DataFrame, types: DataFrame) -> DataFrame:
    """``(name, arity)``; a field without type is discrete."""
    return fields.select("name", F.col("type").alias("__type")).join(
        types.select(F.col("name").alias("__type"), "arity"), "__type", "left"
    ).select("name", F.coalesce("arity", F.lit("discrete")).alias("arity"))


# --- profiles -----------------------------------------------------------------------

CUSTOMER_PROFILE, OPERATOR_PROFILE, EVERYTHING = "customer", "operator", "none"


def profile_for(customer: str | None, requested: str | None = None) -> str:
    """Customers always see the customer profile; operators may choose."""
    if customer is not None:
        return CUSTOMER_PROFILE
    return requested or OPERATOR_PROFILE


def visible(metric_set: DataFrame, profiles: DataFrame, name: str) -> DataFrame:
    """The metric set restricted to a profile, packed per metric."""
    if name == EVERYTHING:
        return base_metrics(metric_set)
    return intersect(metric_set, profiles.filter(F.col("name") == name))


def profile_violations(profiles: DataFrame) -> DataFrame:
    """``(name, problem)``; ``profiles``: ``name, label, module, stat, field``.

    With ``place``, the number of the metric in its profile, a metric that is
    listed at several places is a problem as well, and a field is duplicate only
    within one of them.
    """
    listed = F.col("module").isNotNull() & F.col("stat").isNotNull()
    place = ["place"] if "place" in profiles.columns else []
    counted = profiles.groupBy("name", "label", *METRIC, *place, "field").count()
    per_profile = profiles.groupBy("name").agg(
        F.count(F.when(listed, 1)).alias("metrics"), F.count("label").alias("labels")
    )
    return (
        counted.filter(listed & F.col("field").isNotNull() & (F.col("count") > 1))
        .select("name", F.lit("duplicate field").alias("problem"))
        .unionByName(
            per_profile.filter(F.col("metrics") == 0).select("name", F.lit("no metrics").alias("problem"))
        )
        .unionByName(
            per_profile.filter(F.col("labels") == 0).select("name", F.lit("no label").alias("problem"))
        )
        .unionByName(
            per_profile.filter(F.col("name").isNull()).select("name", F.lit("no name").alias("problem"))
        )
        .unionByName(_listed_twice(profiles.filter(listed)))
        .distinct()
    )


def _listed_twice(profiles: DataFrame) -> DataFrame:
    places = F.count_distinct("place") if "place" in profiles.columns else F.lit(1)
    often = profiles.groupBy("name", *METRIC).agg(places.alias("places")).filter(F.col("places") > 1)
    return often.select("name", F.lit("duplicate base metric").alias("problem"))


def require_valid_profiles(profiles: DataFrame) -> DataFrame:
    """``profiles``, or an error that names up to ten problems."""
    problems = profile_violations(profiles).limit(10).collect()
    if problems:
        raise ValueError("; ".join(f"{r['name']}: {r['problem']}" for r in problems))
    return profiles


# --- ownership ------------------------------------------------------------------------


def zones_by_host(vms: DataFrame, servers: DataFrame, owner: str | None = None) -> DataFrame:
    """``(owner_uuid, hostname, zonename)`` of active machines on known servers."""
    active = vms.filter(F.col("state") == "active")
    if owner is not None:
        active = active.filter(F.col("owner_uuid") == owner)
    return active.join(
        servers.select(F.col("uuid").alias("server_uuid"), "hostname"), "server_uuid"
    ).select("owner_uuid", "hostname", F.col("uuid").alias("zonename"))


def zone_lists(zones: DataFrame) -> DataFrame:
    """Zones per owner and host as a sorted list (one host's machines)."""
    return zones.groupBy("owner_uuid", "hostname").agg(
        F.array_sort(F.collect_list("zonename")).alias("zones")
    )


# --- sources and drill-down --------------------------------------------------------------


def choose_source(candidates: DataFrame, needed: DataFrame) -> DataFrame:
    """First source, in declared order, that has every field a spec needs.

    ``candidates``: ``module, stat, source, priority, field``; ``needed``:
    ``spec_id, module, stat, field``.  Specs no source can serve have NULL.
    """
    wanted = needed.groupBy("spec_id", *METRIC).agg(F.count_distinct("field").alias("wanted"))
    hits = (
        needed.distinct().join(candidates.distinct(), [*METRIC, "field"])
        .groupBy("spec_id", *METRIC, "source", "priority")
        .agg(F.count("field").alias("hits"))
    )
    best = (
        wanted.join(hits, ["spec_id", *METRIC])
        .filter(F.col("hits") == F.col("wanted"))
        .groupBy("spec_id")
        .agg(F.min_by("source", "priority").alias("source"))
    )
    return wanted.select("spec_id", *METRIC).join(best, "spec_id", "left")


def decompositions(metric_set: DataFrame, arities: DataFrame) -> DataFrame:
    """Every decomposition a metric allows: none, one field, or discrete × numeric.

    ``(module, stat, discrete, numeric)`` with NULL for "none".
    """
    typed = metric_set.select(*METRIC, "field").distinct().join(
        arities.withColumnRenamed("name", "field"), "field"
    )
    pick = lambda arity: F.collect_set(F.when(F.col("arity") == arity, F.col("field")))
    none = F.array(F.lit(None).cast("string"))
    packed = typed.groupBy(*METRIC).agg(
        F.concat(none, pick("discrete")).alias("ds"), F.concat(none, pick("numeric")).alias("ns")
    )
    return packed.select(*METRIC, F.explode("ds").alias("discrete"), "ns").select(
        *METRIC, "discrete", F.explode("ns").alias("numeric")
    )
