"""P01-P16."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import catalog as cat
from tickloom.operators import counters as k
from tickloom.operators import predicates as p
from tickloom.operators.aggregate import decompose

from .base import query, with_p

ARITIES = {"source": "discrete", "zonename": "discrete", "optype": "discrete", "latency": "numeric", "k": "numeric"}
BY_TYPE = "SELECT optype AS key, CAST(count(*) AS DOUBLE) AS value FROM p WHERE {} GROUP BY 1"


def _counted(points, pred):
    p.validate(pred, ARITIES)
    return decompose(p.apply(points, pred), key=F.col("optype"))


def _register(name, pred, where):
    @query(name, with_p(BY_TYPE.format(where)))
    def _(t, pred=pred):
        return _counted(t.points, pred)


_register("p01_pred_trivial", {}, "true")
_register("p02_pred_lt", {"lt": ["latency", 25.5]}, "latency < 25.5")
_register("p03_pred_le", {"le": ["k", 50]}, "k <= 50")
_register("p04_pred_gt", {"gt": ["latency", 100]}, "latency > 100")
_register("p05_pred_ge", {"ge": ["k", 90]}, "k >= 90")
_register("p06_pred_eq", {"eq": ["source", "host3"]}, "source = 'host3'")
_register("p07_pred_ne", {"ne": ["optype", "view"]}, "optype <> 'view'")
_register(
    "p08_pred_and",
    {"and": [{"ge": ["latency", 10]}, {"ne": ["optype", "error"]}, {"lt": ["k", 70]}]},
    "latency >= 10 AND optype <> 'error' AND k < 70",
)
_register(
    "p09_pred_or",
    {"or": [{"eq": ["source", "host1"]}, {"and": [{"gt": ["latency", 150]}, {"eq": ["optype", "click"]}]}]},
    "source = 'host1' OR (latency > 150 AND optype = 'click')",
)


@query("p10_pred_validation", """
SELECT o_orderkey AS pred_id, CASE
    WHEN op NOT IN ('lt', 'le', 'gt', 'ge', 'eq', 'ne') THEN 'unknown operator'
    WHEN field NOT IN ('latency', 'k', 'optype', 'source', 'zonename') THEN 'unknown field'
    WHEN op IN ('lt', 'le', 'gt', 'ge') AND field NOT IN ('latency', 'k') THEN 'discrete field'
    WHEN (field IN ('latency', 'k')) = is_text THEN 'constant does not fit' END AS error
FROM (
  SELECT o_orderkey, ['lt', 'le', 'gt', 'ge', 'eq', 'ne', 'near'][1 + o_orderkey % 7] AS op,
         ['latency', 'k', 'optype', 'source', 'zonename', 'nosuch'][1 + o_custkey % 6] AS field, o_custkey % 5 < 2 AS is_text FROM orders)""")
def p10(t):
    """Comparisons asked for, one an order: which of them are refused, and why."""
    ops = F.array(*map(F.lit, ("lt", "le", "gt", "ge", "eq", "ne", "near")))
    fields = F.array(*map(F.lit, ("latency", "k", "optype", "source", "zonename", "nosuch")))
    op = F.get(ops, (F.col("o_orderkey") % 7).cast("int"))
    field = F.get(fields, (F.col("o_custkey") % 6).cast("int"))
    kinds = {"latency": "numeric", "k": "numeric", "optype": "discrete", "source": "discrete", "zonename": "discrete"}
    error = p.comparison_error(field, op, F.col("o_custkey") % 5 < 2, kinds)
    return t.orders.select(F.col("o_orderkey").alias("pred_id"), error.alias("error"))


NESTED = {"or": [{"and": [{"gt": ["latency", 60]}, {"eq": ["source", "host2"]}]}, {"lt": ["latency", 2]}]}


@query("p11_pred_fields", with_p("""
SELECT source, count(*) AS points, round(sum(latency), 2) AS latency FROM p
WHERE (latency > 60 AND source = 'host2') OR latency < 2 GROUP BY source"""))
def p11(t):
    """Only the predicate's fields are read."""
    needed = p.fields_of(NESTED)
    rows = p.apply(t.points.select(*needed), NESTED)
    return rows.groupBy("source").agg(F.count("*").alias("points"), F.round(F.sum("latency"), 2).alias("latency"))


@query("p12_pred_substitute", """
SELECT event_type AS key, count(*) AS points FROM events
WHERE (value > 60 AND user_id % 10 = 2) OR value < 2 GROUP BY 1""")
def p12(t):
    """Logical names compiled onto physical columns and expressions."""
    physical = p.substitute(NESTED, {"latency": "value"})
    columns = {"value": F.col("value"), "source": F.concat(F.lit("host"), F.col("user_id") % 10)}
    rows = t.events.filter(p.to_column(physical, columns))
    return rows.groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("points"))


@query("p13_pred_apply", with_p(
    "SELECT event_id, source, optype, latency FROM p WHERE (latency > 60 AND source = 'host2') OR latency < 2"))
def p13(t):
    return p.apply(t.points, NESTED).select("event_id", "source", "optype", "latency")


@query("p14_zone_scope", with_p("""
SELECT optype AS key, CAST(count(*) AS DOUBLE) AS value FROM p
WHERE zonename IN ('zone1', 'zone5', 'zone9') AND latency >= 20 GROUP BY 1"""))
def p14(t):
    pred = p.zone_scope(["zone1", "zone5", "zone9"], {"ge": ["latency", 20]})
    return _counted(t.points, pred)


@query("p14_zone_scope_table", with_p("""
SELECT optype AS key, CAST(count(*) AS DOUBLE) AS value FROM p
WHERE zonename IN (SELECT 'zone' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0)
GROUP BY 1"""))
def p14_table(t):
    """The zones of one owner, from the ownership tables."""
    vms, servers = ownership(t)
    zones = cat.zones_by_host(vms, servers, "BUILDING")
    return decompose(p.scope_to_zones(t.points, zones), key=F.col("optype"))


def ownership(t):
    vms = t.customer.select(
        F.concat(F.lit("zone"), F.col("c_custkey")).alias("uuid"),
        F.col("c_nationkey").alias("server_uuid"),
        F.col("c_mktsegment").alias("owner_uuid"),
        F.when(F.col("c_acctbal") > 0, "active").otherwise("stopped").alias("state"),
    )
    servers = t.nation.select(F.col("n_nationkey").alias("uuid"), F.col("n_name").alias("hostname"))
    return vms, servers


@query("p15_record_filters", """
WITH r AS (
  SELECT CASE user_id % 4 WHEN 0 THEN 'e1000g' || (user_id % 7) WHEN 1 THEN 'net' || (user_id % 5)
              WHEN 2 THEN 'z' || user_id || '_net0' ELSE 'vm' END AS name,
         CASE user_id % 3 WHEN 0 THEN 'sd' WHEN 1 THEN 'cmdk' ELSE 'st' END AS module,
         CASE WHEN user_id % 5 = 0 THEN 'global' WHEN user_id % 5 = 1 THEN NULL ELSE 'zone' || user_id END AS zonename
  FROM events)
SELECT count(*) FILTER (WHERE regexp_full_match(name, '(e1000g|bnx|igb|ixgbe|net)[0-9]+')) AS nics,
       count(*) FILTER (WHERE zonename <> 'global') AS vnics,
       count(*) FILTER (WHERE module IN ('sd', 'cmdk')) AS disks,
       count(*) FILTER (WHERE name <> 'vm') AS vcpus
FROM r""")
def p15(t):
    u = F.col("user_id")
    records = t.events.select(
        F.when(u % 4 == 0, F.concat(F.lit("e1000g"), u % 7)).when(u % 4 == 1, F.concat(F.lit("net"), u % 5))
        .when(u % 4 == 2, F.concat(F.lit("z"), u, F.lit("_net0"))).otherwise("vm").alias("name"),
        F.when(u % 3 == 0, "sd").when(u % 3 == 1, "cmdk").otherwise("st").alias("module"),
        F.when(u % 5 == 0, "global").when(u % 5 != 1, F.concat(F.lit("zone"), u)).alias("zonename"),
    )
    return records.agg(
        F.count_if(k.is_nic()).alias("nics"),
        F.count_if(k.is_vnic(F.col("zonename"))).alias("vnics"),
        F.count_if(k.is_disk()).alias("disks"),
        F.count_if(k.is_vcpu()).alias("vcpus"),
    )


@query("p16_drill_down", with_p("""
SELECT source AS key, CAST(count(*) AS DOUBLE) AS value FROM p
WHERE optype = 'click' AND latency >= 20 GROUP BY 1"""))
def p16(t):
    pred = p.drill_down({"ge": ["latency", 20]}, "optype", "click")
    p.validate(pred, ARITIES)
    return decompose(p.apply(t.points, pred), key=F.col("source"))
