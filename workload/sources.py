"""S01-S08."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import slots as s
from tickloom.sources import snapshots as snap
from tickloom.sources import tables as src
from tickloom.sources.workdir import new_dir

from .base import G, query, with_p
from .counters import snapshots

ACTIVE = "active AS (SELECT event_type AS inst_id FROM events GROUP BY 1 HAVING count(*) * 5 > (SELECT count(*) FROM events))"


@query("s01_reports", with_p(
    "SELECT optype AS inst_id, source, us // 1000 // 1000 AS t, count(*) AS reports FROM p"
    " WHERE k % 10 NOT IN (0, 1) AND optype IN (SELECT inst_id FROM active) GROUP BY 1, 2, 3", ACTIVE))
def s01(t):
    """Reports with broken times, and reports of instrumentations that ended."""
    raw = t.points.select(
        F.col("optype").alias("inst_id"), "source",
        F.when(F.col("k") % 10 == 0, None).when(F.col("k") % 10 == 1, float("nan"))
        .otherwise(F.floor(F.col("us") / 1000).cast("double")).alias("ts_ms"),
    )
    counts = t.points.groupBy(F.col("optype").alias("inst_id")).agg(F.count("*").alias("n"))
    everything = t.points.agg(F.count("*").alias("n")).scalar()
    active = counts.filter(F.col("n") * 5 > everything)
    return src.clean_reports(raw, active).groupBy("inst_id", "source", "t").agg(F.count("*").alias("reports"))


@query("s02_counters", with_p("""
SELECT DISTINCT 'sd:' || user_id || ':disk:' || CASE user_id % 4 WHEN 0 THEN 'net' || user_id WHEN 1 THEN 'vm' ELSE 'sd' || user_id END AS record,
       t // 86400 AS read_no
FROM p WHERE user_id % 3 = 0 AND user_id % 11 <> 0"""))
def s02(t):
    """Records of one module and class; those read with an error are skipped."""
    rows = snapshots(t).withColumn("error", F.when(F.col("instance") % 11 == 0, "EIO"))
    return src.counters(rows, module="sd", class_="disk").select("record", "read_no")


@query("s03_probe_events", "SELECT event_id, event_type AS probe, value FROM events WHERE event_type IN ('view', 'purchase')")
def s03(t):
    rows = t.events.select("event_id", F.col("event_type").alias("probe"), "value")
    return src.probe_events(rows, ["view", "purchase"])


@query("s04_processes", """
SELECT CAST(s_suppkey AS VARCHAR) AS pid, CAST(s_suppkey % 7 AS VARCHAR) AS ppid, s_name AS execname, 'run ' || s_name AS psargs,
       coalesce(n_name, 'shutting-down') AS zonename, s_suppkey * 3 * 1024 AS rss, CASE WHEN s_suppkey % 3 = 1 THEN '32-bit' ELSE '64-bit' END AS pmodel,
       s_suppkey % 9 AS nthreads, s_suppkey % 4 AS contract
FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 4) ON n_nationkey = s_nationkey""")
def s04(t):
    key = F.col("s_suppkey")
    records = t.supplier.select(
        key.alias("pr_pid"), (key % 7).alias("pr_ppid"),
        F.concat("s_name", F.lit("\0stale")).alias("pr_fname"),
        F.concat(F.lit("run "), "s_name", F.lit("\0")).alias("pr_psargs"),
        F.col("s_nationkey").alias("pr_zoneid"), (key * 3).alias("pr_rssize"), (key % 3).alias("pr_dmodel"),
        (key % 9).alias("pr_nlwp"), (key % 4).alias("pr_contract"),
    )
    zones = t.nation.filter(F.col("n_regionkey") < 4).select(F.col("n_nationkey").alias("zoneid"), F.col("n_name").alias("zonename"))
    return src.processes(records, zones)


@query("s05_storage_list", """
SELECT 'zones/' || c_name AS name, CASE WHEN c_acctbal > 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) ELSE 0 END AS quota,
       CASE WHEN c_custkey % 9 <> 0 THEN c_custkey END AS used, CASE WHEN c_custkey % 5 = 0 THEN '0' ELSE c_mktsegment END AS mountpoint,
       CASE WHEN c_custkey % 9 = 0 THEN 'unlimited' END AS used_text
FROM customer""")
def s05(t):
    """A listing written as tab-separated text and read back."""
    path = new_dir(t.spark, "s05")
    key = F.col("c_custkey")
    t.customer.select(
        F.concat(F.lit("zones/"), "c_name"),
        F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal") * 100).cast("bigint").cast("string")).otherwise("-"),
        F.when(key % 9 == 0, "unlimited").otherwise(key.cast("string")),
        F.when(key % 5 == 0, "-").otherwise(F.col("c_mktsegment")),
    ).write.csv(path, sep="\t")
    listed = src.storage_list(t.spark, path, ["name", "quota", "used", "mountpoint"], text=["mountpoint"])
    return src.require_unique(listed).withColumn("used_text", F.col("other")["used"]).drop("other")


@query("s05_duplicates", "SELECT p_name AS name, count(*) AS count FROM part GROUP BY 1 HAVING count(*) > 1")
def s05_duplicates(t):
    return src.duplicate_names(t.part.select(F.col("p_name").alias("name")))


@query("s06_catalog", """
SELECT p_type AS module, 's' || p_partkey AS stat, p_name AS label, 'interval' AS interval, unnest(['f' || p_partkey, 'f' || (p_size)]) AS field FROM part""")
def s06(t):
    """Catalog files, one per part, read back as metric fields."""
    path = new_dir(t.spark, "s06")
    key = F.col("p_partkey").cast("string")
    named = lambda v: F.struct(v.alias("label"))
    fields = F.array(F.concat(F.lit("f"), key), F.concat(F.lit("f"), F.col("p_size")))
    metric = F.struct(
        F.col("p_type").alias("module"), F.concat(F.lit("s"), key).alias("stat"), F.col("p_name").alias("label"), fields.alias("fields")
    )
    doc = F.struct(
        F.create_map("p_type", named(F.col("p_type"))).alias("modules"),
        F.create_map(F.concat(F.lit("f"), key), named(F.col("p_name"))).alias("fields"),
        F.array(metric).alias("metrics"),
    )
    t.part.select(F.to_json(doc)).write.text(path)
    metrics = src.catalog(t.spark, path, multiline=False)["metrics"]
    return metrics.select("module", "stat", "label", "interval", F.explode("fields").alias("field"))


def cents(t):
    return t.reports.withColumn("value", F.round(F.col("value") * 100))


SAVED = """
SELECT optype AS inst_id, slot, sum(round(latency * 100)) AS value, count(DISTINCT source) AS reporting, max(t) AS last_seen FROM p GROUP BY 1, 2"""


def read_back(snapshot):
    seen = snapshot.reporting.groupBy("inst_id", "slot").agg(
        F.count_distinct("source").alias("reporting"), F.max("last_seen").alias("last_seen")
    )
    return snapshot.slots.join(seen, ["inst_id", "slot"])


@query("s07_snapshot", with_p(SAVED))
def s07(t):
    path = new_dir(t.spark, "s07")
    snap.save(snap.capture(cents(t), s.interval_scope(cents(t)), G), path)
    return read_back(snap.load(t.spark, path, G))


@query("s07_snapshot_replaces", with_p(SAVED))
def s07_replaces(t):
    """A second save replaces the instrumentations it holds and no others."""
    path = new_dir(t.spark, "s07r")
    rows = cents(t)
    half = rows.filter(F.col("t") % 2 == 0)
    snap.save(snap.capture(half, s.interval_scope(half), G), path)
    for kinds in (["view", "click"], ["purchase", "signup", "error"]):
        part = rows.filter(F.col("inst_id").isin(kinds))
        snap.save(snap.capture(part, s.interval_scope(part), G), path)
    return read_back(snap.load(t.spark, path, G))


@query("s08_restore_merge", with_p(SAVED))
def s08(t):
    """Two saved halves of every slot, merged."""
    paths = [new_dir(t.spark, f"s08-{i}") for i in (0, 1)]
    for i, path in enumerate(paths):
        part = cents(t).filter(F.col("seq") % 2 == i)
        snap.save(snap.capture(part, s.interval_scope(part), G), path)
    return read_back(snap.merged(*(snap.load(t.spark, path, G) for path in paths)))


