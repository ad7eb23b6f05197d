"""C01-C12, U01-U05."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import catalog as c
from tickloom.operators import transforms as u

from .base import query, with_p
from .predicates import ownership

# Hosts announce, day by day, the metrics and fields their events show.
ANNOUNCED = """ann AS (
  SELECT DISTINCT source AS host, t // 86400 AS announced, optype AS module, 's' || (k % 4) AS stat, 'f' || (user_id % 12) AS field FROM p)"""


def announcements(t):
    return t.points.select(
        F.col("source").alias("host"), F.floor(F.col("t") / 86400).cast("bigint").alias("announced"),
        F.col("optype").alias("module"), F.concat(F.lit("s"), F.col("k") % 4).alias("stat"),
        F.concat(F.lit("f"), F.col("user_id") % 12).alias("field"),
    )


CURRENT = """cur AS (
  SELECT DISTINCT host, module, stat, field FROM ann JOIN (SELECT host, max(announced) AS announced FROM ann GROUP BY 1) USING (host, announced))"""
UNION = "uni AS (SELECT DISTINCT module, stat, field FROM ann)"


@query("c01_hosts_current", with_p("SELECT * FROM cur", ANNOUNCED, CURRENT))
def c01(t):
    return c.current_of_hosts(announcements(t))


@query("c01_hosts_union", with_p("SELECT * FROM uni", ANNOUNCED, UNION))
def c01_union(t):
    return c.union_of_hosts(announcements(t))


def listed(df):
    return df.withColumn("fields", F.array_join("fields", ","))


@query("c02_base_metrics", with_p("SELECT module, stat, string_agg(field, ',' ORDER BY field) AS fields FROM uni GROUP BY 1, 2", ANNOUNCED, UNION))
def c02(t):
    return listed(c.base_metrics(c.union_of_hosts(announcements(t))))


REQUESTED = """want AS (
  SELECT o_orderkey AS request_id, ['view', 'click', 'purchase', 'signup', 'error'][1 + o_custkey % 5] AS module,
         's' || (o_orderkey % 4) AS stat, unnest(['f' || (o_custkey % 13), 'f' || (o_orderkey % 12)]) AS field FROM orders)"""


def requested(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    kinds = F.array(*(F.lit(x) for x in ("view", "click", "purchase", "signup", "error")))
    return t.orders.select(
        key.alias("request_id"), F.get(kinds, (cust % 5).cast("int")).alias("module"),
        F.concat(F.lit("s"), key % 4).alias("stat"),
        F.explode(F.array(F.concat(F.lit("f"), cust % 13), F.concat(F.lit("f"), key % 12))).alias("field"),
    )


@query("c03_supports", with_p("""
SELECT request_id, module, stat, bool_and((module, stat, field) IN (SELECT (module, stat, field) FROM uni)) AS supported
FROM want GROUP BY 1, 2, 3""", ANNOUNCED, UNION, REQUESTED))
def c03(t):
    return c.supports(c.union_of_hosts(announcements(t)), requested(t))


@query("c03_supports_host", with_p("""
SELECT host, request_id, module, stat, bool_and((host, module, stat, field) IN (SELECT (host, module, stat, field) FROM cur)) AS supported
FROM (SELECT 'host' || (request_id % 10) AS host, * FROM want) GROUP BY 1, 2, 3, 4""", ANNOUNCED, CURRENT, REQUESTED))
def c03_host(t):
    asked = requested(t).withColumn("host", F.concat(F.lit("host"), F.col("request_id") % 10))
    return c.supports(c.current_of_hosts(announcements(t)), asked, by=["host"])


@query("c03_missing", with_p("SELECT request_id, module, stat, field FROM want ANTI JOIN uni USING (module, stat, field)", ANNOUNCED, UNION, REQUESTED))
def c03_missing(t):
    rows = c.missing_fields(c.union_of_hosts(announcements(t)), requested(t))
    return rows.select("request_id", "module", "stat", "field")


@query("c04_intersection", with_p("""
SELECT a.module, a.stat, coalesce(string_agg(a.field, ',' ORDER BY a.field) FILTER (WHERE b.field IS NOT NULL), '') AS fields
FROM (SELECT DISTINCT module, stat, field FROM cur WHERE host = 'host1') a
LEFT JOIN (SELECT DISTINCT module, stat, field FROM cur WHERE host <> 'host1') b USING (module, stat, field)
WHERE (a.module, a.stat) IN (SELECT (module, stat) FROM cur WHERE host <> 'host1')
GROUP BY 1, 2""", ANNOUNCED, CURRENT))
def c04(t):
    current = c.current_of_hosts(announcements(t))
    mine, others = (current.filter(x) for x in (F.col("host") == "host1", F.col("host") != "host1"))
    return listed(c.intersect(mine, others))


# A catalog out of the parts, with errors of every kind.
PART_CATALOG = """mods AS (SELECT DISTINCT CASE WHEN p_size > 10 THEN replace(p_brand, '#', '_') ELSE p_brand END AS name, p_brand AS label FROM part),
typ AS (SELECT DISTINCT p_type || '_' || p_size AS name, ['numeric', 'discrete', 'other'][1 + p_size % 3] AS arity,
          CASE WHEN p_size % 5 <> 0 THEN 'bytes' END AS unit, [2, 10, 7, NULL][1 + p_size % 4] AS base,
          CASE WHEN p_size % 2 = 0 THEN 3 END AS power FROM part),
fld AS (SELECT 'f' || p_partkey AS name, p_name AS label, CASE WHEN p_partkey % 3 = 0 THEN p_type || '_' || (p_size + 1)
          WHEN p_partkey % 3 = 1 THEN 'string' END AS type FROM part),
met AS (SELECT replace(p_brand, '#', '_') AS module, 's' || p_partkey AS stat, CASE WHEN p_partkey % 4 = 0 THEN p_type || '_' || (p_size + 2) END AS type,
          CASE WHEN p_partkey % 3 = 0 THEN 'operations' END AS unit, ['f' || p_partkey, 'f' || (p_partkey * 2)] AS fields FROM part)"""


def part_catalog(t):
    part, size, key = t.part, F.col("p_size"), F.col("p_partkey")
    numbered = lambda p, n: F.concat(F.lit(p), n)
    pick = lambda *xs: F.array(*(F.lit(x) for x in xs))
    brand = F.replace("p_brand", F.lit("#"), F.lit("_"))
    modules = part.select(F.when(size > 10, brand).otherwise(F.col("p_brand")).alias("name"), F.col("p_brand").alias("label")).distinct()
    types = part.select(
        F.concat_ws("_", "p_type", "p_size").alias("name"),
        F.get(pick("numeric", "discrete", "other"), size % 3).alias("arity"),
        F.when(size % 5 != 0, "bytes").alias("unit"),
        F.get(pick(2, 10, 7, None), size % 4).alias("base"),
        F.when(size % 2 == 0, 3).alias("power"),
    ).distinct()
    fields = part.select(
        numbered("f", key).alias("name"), F.col("p_name").alias("label"),
        F.when(key % 3 == 0, F.concat_ws("_", "p_type", size + 1)).when(key % 3 == 1, "string").alias("type"),
    )
    metrics = part.select(
        brand.alias("module"), numbered("s", key).alias("stat"),
        F.when(key % 4 == 0, F.concat_ws("_", "p_type", size + 2)).alias("type"),
        F.when(key % 3 == 0, "operations").alias("unit"),
        F.array(numbered("f", key), numbered("f", key * 2)).alias("fields"),
    )
    return modules, types, fields, metrics


@query("c05_conflicts", """
SELECT p_name AS name, count(DISTINCT (p_type, p_size)) AS variants FROM part GROUP BY 1 HAVING count(DISTINCT (p_type, p_size)) > 1""")
def c05(t):
    """Part names declared with different type and size."""
    declared = t.part.select(F.col("p_name").alias("name"), "p_type", "p_size")
    return c.conflicts(declared)


@query("c05_merge_metrics", with_p("""
SELECT module, stat, max(interval) AS interval, string_agg(field, ',' ORDER BY first, field) AS fields FROM (
  SELECT optype AS module, 's' || (k % 4) AS stat, 'f' || (user_id % 12) AS field, min(event_id) AS first,
         max(CASE WHEN event_id % 97 = 0 THEN 'point' ELSE 'interval' END) AS interval FROM p GROUP BY 1, 2, 3)
GROUP BY 1, 2"""))
def c05_merge(t):
    """Each event declares a metric with one field; ``point`` wins."""
    declared = t.points.select(
        F.col("optype").alias("module"), F.concat(F.lit("s"), F.col("k") % 4).alias("stat"),
        F.when(F.col("event_id") % 97 == 0, "point").otherwise("interval").alias("interval"),
        F.array(F.concat(F.lit("f"), F.col("user_id") % 12)).alias("fields"), F.col("event_id").alias("seq"),
    )
    return listed(c.merge_metrics(declared))


@query("c06_validate", "WITH " + PART_CATALOG + """
SELECT 'module' AS kind, name, 'bad name' AS problem FROM mods WHERE NOT regexp_full_match(name, '\\w+')
UNION SELECT 'type', name, 'bad name' FROM typ WHERE NOT regexp_full_match(name, '\\w+')
UNION SELECT 'field', name, 'bad name' FROM fld WHERE NOT regexp_full_match(name, '\\w+')
UNION SELECT 'type', name, 'bad arity' FROM typ WHERE arity NOT IN ('discrete', 'numeric')
UNION SELECT 'type', name, 'bad base' FROM typ WHERE base NOT IN (2, 10)
UNION SELECT 'type', name, 'base without unit' FROM typ WHERE base IS NOT NULL AND unit IS NULL
UNION SELECT 'type', name, 'power without base' FROM typ WHERE power IS NOT NULL AND base IS NULL
UNION SELECT 'field', name, 'unknown type' FROM fld WHERE type IS NOT NULL AND type <> 'string' AND type NOT IN (SELECT name FROM typ)
UNION SELECT 'metric', module || '.' || stat, 'unknown module' FROM met WHERE module NOT IN (SELECT name FROM mods)
UNION SELECT 'metric', module || '.' || stat, 'unknown type' FROM met WHERE type IS NOT NULL AND type NOT IN (SELECT name FROM typ)
UNION SELECT 'metric', module || '.' || stat, 'neither unit nor type' FROM met WHERE unit IS NULL AND type IS NULL
UNION SELECT 'metric', module || '.' || stat, 'unknown field' FROM (SELECT *, unnest(fields) AS f FROM met) WHERE f NOT IN (SELECT name FROM fld)""")
def c06(t):
    modules, types, fields, metrics = part_catalog(t)
    return c.violations(modules, types, fields, metrics)


@query("c07_describe", "WITH " + PART_CATALOG + """,
used AS (SELECT DISTINCT module, unnest(fields) AS field FROM met WHERE unit IS NOT NULL)
SELECT 'module' AS kind, name, label FROM mods WHERE name IN (SELECT module FROM used)
UNION ALL SELECT 'field', name, label FROM fld WHERE name IN (SELECT field FROM used)
UNION ALL SELECT 'type', x.name, coalesce(typ.arity, 'discrete') FROM
  (SELECT DISTINCT coalesce(type, 'string') AS name FROM fld WHERE name IN (SELECT field FROM used)) x LEFT JOIN typ ON typ.name = x.name""")
def c07(t):
    modules, types, fields, metrics = part_catalog(t)
    seen = metrics.filter(F.col("unit").isNotNull()).select("module", "stat", F.explode("fields").alias("field"))
    return c.describe(seen, modules, fields, types)


PROFILES = """prof AS (
  SELECT ['customer', 'operator', 'audit'][1 + c_custkey % 3] AS name, c_mktsegment AS label,
         ['view', 'click', 'purchase', 'signup', 'error'][1 + c_nationkey % 5] AS module, 's' || (c_custkey % 4) AS stat,
         'f' || (c_nationkey % 12) AS field FROM customer)"""


def profile_table(t, *more):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    pick = lambda i, *xs: F.get(F.array(*(F.lit(x) for x in xs)), i.cast("int"))
    return t.customer.select(
        pick(key % 3, "customer", "operator", "audit").alias("name"), F.col("c_mktsegment").alias("label"),
        pick(nation % 5, "view", "click", "purchase", "signup", "error").alias("module"),
        F.concat(F.lit("s"), key % 4).alias("stat"), F.concat(F.lit("f"), nation % 12).alias("field"), *more,
    )


@query("c08_visible", with_p("""
SELECT a.module, a.stat, coalesce(string_agg(a.field, ',' ORDER BY a.field) FILTER (WHERE b.field IS NOT NULL), '') AS fields
FROM uni a LEFT JOIN (SELECT DISTINCT module, stat, field FROM prof WHERE name = 'customer') b USING (module, stat, field)
WHERE (a.module, a.stat) IN (SELECT (module, stat) FROM prof WHERE name = 'customer') GROUP BY 1, 2""", ANNOUNCED, UNION, PROFILES))
def c08(t):
    """What a customer sees, whatever profile it asks for."""
    name = c.profile_for("some customer", "operator")
    return listed(c.visible(c.union_of_hosts(announcements(t)), profile_table(t), name))


@query("c09_profile_violations", "WITH " + PROFILES + """
SELECT DISTINCT name, 'duplicate field' AS problem FROM (SELECT name FROM prof GROUP BY name, label, module, stat, field HAVING count(*) > 1)""")
def c09(t):
    return c.profile_violations(profile_table(t))


@query("c09_duplicate_metrics", "WITH " + PROFILES.replace(" FROM customer", ", c_custkey // 60 AS place FROM customer") + """
SELECT name, 'duplicate field' AS problem FROM prof GROUP BY name, label, module, stat, place, field HAVING count(*) > 1
UNION
SELECT name, 'duplicate base metric' FROM prof GROUP BY name, module, stat HAVING count(DISTINCT place) > 1""")
def c09_metrics(t):
    """Profiles that list a metric at several places."""
    return c.profile_violations(profile_table(t, F.floor(F.col("c_custkey") / 60).alias("place")))


@query("c10_zones_by_host", """
SELECT c_mktsegment AS owner_uuid, n_name AS hostname, string_agg('zone' || c_custkey, ',' ORDER BY 'zone' || c_custkey) AS zones
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0 GROUP BY 1, 2""")
def c10(t):
    lists = c.zone_lists(c.zones_by_host(*ownership(t)))
    return lists.withColumn("zones", F.array_join("zones", ","))


CANDIDATES = """cand AS (
  SELECT DISTINCT optype AS module, 's' || (k % 4) AS stat, ['counters', 'events', 'processes'][1 + user_id % 3] AS source, user_id % 3 AS priority,
         'f' || (user_id % 12) AS field FROM p)"""


@query("c11_choose_source", with_p("""
SELECT w.spec_id, w.module, w.stat, arg_min(h.source, h.priority) AS source
FROM (SELECT request_id AS spec_id, module, stat, count(DISTINCT field) AS wanted FROM want GROUP BY 1, 2, 3) w
LEFT JOIN (SELECT request_id AS spec_id, source, priority, count(DISTINCT field) AS hits FROM want JOIN cand USING (module, stat, field) GROUP BY 1, 2, 3) h
  ON h.spec_id = w.spec_id AND h.hits = w.wanted GROUP BY 1, 2, 3""", REQUESTED, CANDIDATES))
def c11(t):
    pick = F.get(F.array(*(F.lit(x) for x in ("counters", "events", "processes"))), (F.col("user_id") % 3).cast("int"))
    candidates = t.points.select(
        F.col("optype").alias("module"), F.concat(F.lit("s"), F.col("k") % 4).alias("stat"), pick.alias("source"),
        (F.col("user_id") % 3).alias("priority"), F.concat(F.lit("f"), F.col("user_id") % 12).alias("field"),
    )
    return c.choose_source(candidates, requested(t).withColumnRenamed("request_id", "spec_id"))


TYPED = """typed AS (
  SELECT module, stat, field, CASE WHEN CAST(substr(field, 2) AS INTEGER) % 3 = 0 THEN 'numeric' ELSE 'discrete' END AS arity FROM uni)"""


@query("c12_decompositions", with_p("""
SELECT m.module, m.stat, d.field AS discrete, n.field AS numeric
FROM (SELECT DISTINCT module, stat FROM typed) m
JOIN (SELECT module, stat, field FROM typed WHERE arity = 'discrete' UNION SELECT module, stat, NULL FROM typed) d USING (module, stat)
JOIN (SELECT module, stat, field FROM typed WHERE arity = 'numeric' UNION SELECT module, stat, NULL FROM typed) n USING (module, stat)""",
    ANNOUNCED, UNION, TYPED))
def c12(t):
    metric_set = c.union_of_hosts(announcements(t))
    number = F.substr("name", F.lit(2)).cast("int")
    arities = metric_set.select(F.col("field").alias("name")).distinct().withColumn(
        "arity", F.when(number % 3 == 0, "numeric").otherwise("discrete")
    )
    return c.decompositions(metric_set, arities)


# --- transformations ----------------------------------------------------------------------

# Orders stand for peers, suppliers for the networks they may belong to.
IPS = """ips AS (
  SELECT DISTINCT n, (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) AS ip
  FROM (SELECT o_custkey * 2654435 % 4294967296 AS n FROM orders))"""
NETS = """nets AS (
  SELECT s_suppkey * 4294967 AS start_ip, s_suppkey * 4294967 + 4000000 - s_suppkey % 7 * 100000 AS end_ip, s_name AS country, s_nationkey AS region FROM supplier)"""


def peers(t):
    n = (F.col("o_custkey") * 2654435) % 4294967296
    part = lambda d: (F.floor(n / d) % 256).cast("string")
    return t.orders.select(F.concat_ws(".", part(1 << 24), part(1 << 16), part(1 << 8), part(1)).alias("key"), F.lit(1.0).alias("value"))


def networks(t):
    start = F.col("s_suppkey") * 4294967
    return t.supplier.select(
        start.alias("start_ip"), (start + 4000000 - F.col("s_suppkey") % 7 * 100000).alias("end_ip"),
        F.col("s_name").alias("country"), F.col("s_nationkey").alias("region"),
    )


def host_names(t):
    name = F.concat(F.col("s_name"), F.lit(".example.net"))
    n = (F.col("s_suppkey") * 2654435) % 4294967296
    part = lambda d: (F.floor(n / d) % 256).cast("string")
    return t.supplier.select(
        F.concat_ws(".", part(1 << 24), part(1 << 16), part(1 << 8), part(1)).alias("ip"),
        F.when(F.col("s_suppkey") % 5 != 0, F.array(name, F.lit("alias.example.net"))).alias("names"),
    )


def registry(t):
    r = u.Registry()
    r.register("geolocate", "geolocate IP addresses", ["raddr", "http_origin"], u.geolocate(networks(t)))
    r.register("reversedns", "host names of IP addresses", ["raddr"], u.reverse_names(host_names(t)))
    return r


SPECS = """specs AS (
  SELECT o_orderkey AS spec_id, ['raddr', 'http_origin', 'zonename'][1 + o_custkey % 3] AS a, ['latency', 'raddr'][1 + o_orderkey % 2] AS b FROM orders),
fit AS (
  SELECT spec_id, 'geolocate' AS transformation FROM specs WHERE a IN ('raddr', 'http_origin') OR b = 'raddr'
  UNION ALL SELECT spec_id, 'reversedns' FROM specs WHERE a = 'raddr' OR b = 'raddr')"""


def specs(t):
    """Decompositions, one an order."""
    pick = lambda names, by: F.get(F.array(*map(F.lit, names)), (F.col(by) % len(names)).cast("int"))
    fields = F.array(pick(["raddr", "http_origin", "zonename"], "o_custkey"), pick(["latency", "raddr"], "o_orderkey"))
    return t.orders.select(F.col("o_orderkey").alias("spec_id"), fields.alias("fields"))


@query("u01_registry", "WITH " + SPECS + """
SELECT transformation, CASE transformation WHEN 'geolocate' THEN 'geolocate IP addresses' ELSE 'host names of IP addresses' END AS label,
       count(*) AS specs FROM fit GROUP BY 1""")
def u01(t):
    """The registered transformations and how many specs may use them."""
    r = registry(t)
    used = r.applicable_to(specs(t)).groupBy(F.col("transformation").alias("name")).agg(F.count("*").alias("specs"))
    return r.table(t.spark).join(used, "name").select(F.col("name").alias("transformation"), "label", "specs")


@query("u02_applicable", "WITH " + SPECS + "SELECT * FROM fit")
def u02(t):
    return registry(t).applicable_to(specs(t))


LOCATED = """located AS (
  SELECT ip AS key, country, region FROM ips JOIN nets ON n BETWEEN start_ip AND end_ip
  WHERE NOT (n // 16777216 IN (10, 127) OR n // 65536 = 169 * 256 + 254 OR n // 1048576 = 172 * 16 + 1 OR n // 65536 = 192 * 256 + 168))"""


@query("u03_apply", "WITH " + IPS + "," + NETS + "," + LOCATED + """
SELECT k.key, k.value, l.country FROM (
  SELECT (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) AS key, CAST(count(*) AS DOUBLE) AS value
  FROM (SELECT o_custkey * 2654435 % 4294967296 AS n FROM orders) GROUP BY 1) k LEFT JOIN located l USING (key)""")
def u03(t):
    """A keyed value with the information its keys have."""
    value = peers(t).groupBy("key").agg(F.sum("value").alias("value"))
    extra = u.apply(value, registry(t)["geolocate"])
    return value.join(extra.select("key", F.col("value.country").alias("country")), "key", "left")


@query("u04_geolocate", "WITH " + IPS + "," + NETS + "," + LOCATED + "SELECT * FROM located")
def u04(t):
    found = u.apply(peers(t), registry(t)["geolocate"])
    return found.select("key", "value.country", "value.region")


@query("u05_reverse_names", "WITH " + IPS + """
SELECT ip AS key, s_name || '.example.net,alias.example.net' AS names FROM ips
JOIN supplier ON s_suppkey * 2654435 % 4294967296 = n WHERE s_suppkey % 5 <> 0""")
def u05(t):
    found = u.apply(peers(t), registry(t)["reversedns"])
    return found.select("key", F.array_join("value", ",").alias("names"))
