from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tickloom.operators import catalog as c
from tickloom.sources import tables as src

SET = "module string, stat string, field string"


def announced(spark, rows):
    flat = [(h, n, m, s, f) for h, n, m, s, fields in rows for f in fields or [None]]
    return spark.createDataFrame(flat, f"host string, announced int, {SET}")


def answers(spark, metric_set, requests, by=()):
    rows = [(i, *host, "mod1", "stat11", f) for i, (*host, fields) in enumerate(requests) for f in fields or [None]]
    schema = f"request_id int, {'host string, ' if by else ''}{SET}"
    out = c.supports(metric_set, spark.createDataFrame(rows, schema), by).collect()
    got = {r["request_id"]: r["supported"] for r in out}
    return [got[i] for i in range(len(requests))]


def test_supports(spark):
    ann = announced(spark, [("host1", 1, "mod1", "stat11", ["f1", "f2"]), ("host2", 1, "mod1", "stat11", ["f2"])])
    union, current = c.union_of_hosts(ann), c.current_of_hosts(ann)
    asked = [[], ["f1"], ["f2"], ["f1", "f2"], ["f2", "f1"], ["f2", "f1", "f3"], ["f3"]]
    assert answers(spark, union, [(a,) for a in asked]) == [True] * 5 + [False] * 2
    per_host = {"host1": [True] * 5 + [False] * 2, "host2": [True, False, True] + [False] * 4, "host3": [False] * 7}
    for host, want in per_host.items():
        assert answers(spark, current, [(host, a) for a in asked], by=["host"]) == want
    assert [r["fields"] for r in c.base_metrics(union).collect()] == [["f1", "f2"]]


def test_replaced_announcement(spark):
    """A host's set is replaced, the union keeps everything."""
    ann = announced(spark, [("h", 1, "m", "s", ["a", "b"]), ("h", 2, "m", "s", ["b", "c"]), ("g", 1, "m", "s", ["a"])])
    current = {(r["host"], r["field"]) for r in c.current_of_hosts(ann).collect()}
    assert current == {("h", "b"), ("h", "c"), ("g", "a")}
    assert {r["field"] for r in c.union_of_hosts(ann).collect()} == {"a", "b", "c"}


def metric_set(spark, metrics):
    return spark.createDataFrame([(m, s, f) for m, s, fields in metrics for f in fields or [None]], SET)


def test_intersection(spark):
    profile = metric_set(spark, [
        ("mod1", "stat1", ["f1", "f2", "f3"]), ("mod1", "stat2", []), ("mod2", "stat1", ["f21", "f22"]), ("mod3", "stat9", ["f21", "f22"]),
    ])
    hosts = metric_set(spark, [
        ("mod1", "stat1", ["f0", "f1", "f2", "f3", "f4"]), ("mod1", "stat2", ["f31"]), ("mod1", "stat3", ["f41"]),
        ("mod2", "stat1", ["f20", "f21"]), ("mod2", "stat1", ["f20", "f21"]), ("mod3", "stat8", ["f71"]),
    ])
    want = [("mod1", "stat1", ["f1", "f2", "f3"]), ("mod1", "stat2", []), ("mod2", "stat1", ["f21"])]
    for left, right in ((profile, hosts), (hosts, profile)):
        assert [tuple(r) for r in c.intersect(left, right).orderBy("module", "stat").collect()] == want
    named = profile.withColumn("name", F.lit("customer"))
    assert c.profile_for("cust", "none") == "customer" and c.profile_for(None) == "operator" and c.profile_for(None, "none") == "none"
    assert c.visible(hosts, named, "customer").count() == 3 and c.visible(hosts, named, "none").count() == 5


CATALOG = {
    "modules": {"m": {"label": "M"}, "bad name": {"label": "B"}, "unused": {"label": "U"}},
    "types": {
        "number": {"arity": "numeric"}, "time": {"arity": "numeric", "unit": "seconds", "abbr": "s", "base": 10, "power": -9},
        "odd": {"arity": "other"}, "b": {"arity": "numeric", "base": 3, "unit": "x"}, "nounit": {"arity": "numeric", "base": 2},
        "nobase": {"arity": "numeric", "power": 2},
    },
    "fields": {"f": {"label": "F"}, "n": {"label": "N", "type": "number"}, "t": {"label": "T", "type": "time"}, "u": {"label": "U", "type": "nosuch"}},
    "metrics": [
        {"module": "m", "stat": "s", "label": "S", "unit": "ops", "fields": ["f", "n", "t"]},
        {"module": "x", "stat": "s", "label": "S", "type": "time", "interval": "point", "fields": ["f"]},
        {"module": "m", "stat": "q", "label": "Q", "fields": ["missing"]}, {"module": "m", "stat": "r", "label": "R", "type": "zz", "fields": []},
    ],
}
PROBLEMS = {
    ("module", "bad name", "bad name"), ("type", "odd", "bad arity"), ("type", "b", "bad base"), ("type", "nounit", "base without unit"),
    ("type", "nobase", "power without base"), ("field", "u", "unknown type"), ("metric", "x.s", "unknown module"),
    ("metric", "m.q", "neither unit nor type"), ("metric", "m.q", "unknown field"), ("metric", "m.r", "unknown type"),
}


def test_catalog_files(spark, tmp_path):
    folder = tmp_path / "catalog" / "metric"
    folder.mkdir(parents=True)
    (folder / "metrics.json").write_text(json.dumps(CATALOG, indent=2))
    parts = src.catalog(spark, str(tmp_path / "catalog"))
    names = ("modules", "types", "fields", "metrics")
    assert {tuple(r) for r in c.violations(*(parts[n] for n in names)).collect()} == PROBLEMS
    listed = src.metric_fields(parts["metrics"].filter("module = 'm' and stat = 's'"))
    seen = {(r["kind"], r["name"], r["label"]) for r in c.describe(listed, parts["modules"], parts["fields"], parts["types"]).collect()}
    assert seen == {
        ("module", "m", "M"), ("field", "f", "F"), ("field", "n", "N"), ("field", "t", "T"), ("type", "string", "discrete"),
        ("type", "number", "numeric"), ("type", "time", "numeric"),
    }
    arities = c.field_arities(parts["fields"], parts["types"])
    combos = {(r["discrete"], r["numeric"]) for r in c.decompositions(listed, arities).collect()}
    assert combos == {(None, None), ("f", None), (None, "n"), (None, "t"), ("f", "n"), ("f", "t")}
    assert {r["interval"] for r in parts["metrics"].filter("module = 'x'").collect()} == {"point"}


def test_profile_files(spark, tmp_path):
    good = {"name": "customer", "label": "Customer", "metrics": [{"module": "m", "stat": "s", "fields": ["f", "g"]}]}
    twice = {"name": "twice", "label": "Twice", "metrics": [{"module": "m", "stat": "s", "fields": ["f", "f"]}]}
    empty = {"name": "empty", "label": "Empty", "metrics": []}
    unlabelled = {"name": "plain", "metrics": [{"module": "m", "stat": "s", "fields": ["f"]}]}
    again = {"name": "again", "label": "Again", "metrics": [{"module": "m", "stat": "s", "fields": [f]} for f in "fg"]}
    for i, doc in enumerate((good, twice, empty, unlabelled, again)):
        (tmp_path / f"p{i}.json").write_text(json.dumps(doc))
    profiles = src.profiles(spark, str(tmp_path))
    problems = {tuple(r) for r in c.profile_violations(profiles).collect()}
    assert problems == {("twice", "duplicate field"), ("empty", "no metrics"), ("plain", "no label"), ("again", "duplicate base metric")}
    with pytest.raises(ValueError):
        c.require_valid_profiles(profiles)
    assert c.require_valid_profiles(profiles.filter("name = 'customer'")).count() == 2


def test_metadata_merge(spark):
    declared = spark.createDataFrame(
        [("m", "s", "interval", ["a", "b"], 1), ("m", "s", "point", ["c", "a"], 2), ("m", "t", "interval", ["z"], 3)],
        "module string, stat string, interval string, fields array<string>, seq int",
    )
    got = {r["stat"]: (r["interval"], r["fields"]) for r in c.merge_metrics(declared).collect()}
    assert got == {"s": ("point", ["a", "b", "c"]), "t": ("interval", ["z"])}
    types = spark.createDataFrame([("x", "numeric", 2), ("x", "numeric", 2), ("y", "numeric", 2), ("y", "discrete", 2)], "name string, arity string, base int")
    assert [r["name"] for r in c.conflicts(types).collect()] == ["y"]


def test_ownership(spark):
    vms = spark.createDataFrame(
        [("z1", "s1", "ann", "active"), ("z2", "s1", "ann", "active"), ("z3", "s2", "ann", "stopped"), ("z4", "s9", "ann", "active"), ("z5", "s2", "bob", "active")],
        "uuid string, server_uuid string, owner_uuid string, state string",
    )
    servers = spark.createDataFrame([("s1", "host1"), ("s2", "host2")], "uuid string, hostname string")
    lists = c.zone_lists(c.zones_by_host(vms, servers))
    assert {(r["owner_uuid"], r["hostname"]): r["zones"] for r in lists.collect()} == {("ann", "host1"): ["z1", "z2"], ("bob", "host2"): ["z5"]}
    assert c.zones_by_host(vms, servers, "nobody").count() == 0


def test_choose_source(spark):
    candidates = spark.createDataFrame(
        [("m", "s", "counters", 0, "a"), ("m", "s", "events", 1, "a"), ("m", "s", "events", 1, "b")], f"module string, stat string, source string, priority int, field string"
    )
    needed = spark.createDataFrame([(1, "m", "s", "a"), (2, "m", "s", "a"), (2, "m", "s", "b"), (3, "m", "s", "c")], f"spec_id int, {SET}")
    got = {r["spec_id"]: r["source"] for r in c.choose_source(candidates, needed).collect()}
    assert got == {1: "counters", 2: "events", 3: None}
