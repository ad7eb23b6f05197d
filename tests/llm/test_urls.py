from __future__ import annotations

import math
import re

import pytest

from tickloom.llm import urls
from tickloom.llm.queries import URL_RULES


def split(url):
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def pages():
    hosts = ["Example.ORG", "a.example.org", "org", "x.com", "com", "badexample.org", "b.net", "c.net:80", "É.org"]
    paths = ["", "/", "/es/1", "/en/1", "/en/12?a=1&b=2", "/fr/9#x", "/de/", "/de", "?q=/fr/", "#/de/"]
    rows = [f"http{'s' * (k % 2)}://{h}{p}" for k, h in enumerate(hosts) for p in paths]
    rows += [None, "", "no mark", "://", "a://b://c/d", "http://x.com/fr/\n2", "http://x.org/" + "y" * 50_000]
    return [(i, u) for i, u in enumerate([*rows, rows[0]])]


def test_hosts_paths_and_rules(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "page_id long, url string, rule string, features double")
    found = {r.page_id: r for r in urls.judge(df, URL_RULES, trees=3).collect()}
    assert len(found) == len(rows)
    for i, u in rows:
        host, path = split(u)
        rule = rule_of(host, path)
        assert (found[i].host, found[i].path) == (host, path), u
        assert found[i].rule == (rule.text if rule else None), u
        assert found[i].verdict == (rule.verdict if rule else "block" if found[i].score >= 0.5 else "allow")


def test_trees_learn_from_the_labelled(spark):
    rows = [(k, f"http://shop{k % 5}.org/{'deal' * (k % 3)}?a={k}&b=1&c=2" if k % 2 else f"http://news.net/{k}") for k in range(400)]
    rules = [urls.rule("block", f"shop{k}.org/") for k in range(3)] + [urls.rule("allow", "news.net/1"), urls.rule("allow", "news.net/2")]
    found = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules, trees=5).filter("rule is null")
    right = found.filter("(verdict = 'block') = (host <> 'news.net')").count()
    assert right >= 0.95 * found.count() > 100


@pytest.mark.parametrize(("rules", "rest"), [([], "allow"), ([urls.rule("block", "x.com/")], "block"), ([urls.rule("allow", "x.com/")], "allow")])
def test_one_kind_of_label_or_none(spark, rules, rest):
    df = spark.createDataFrame([(1, "http://x.com/a"), (2, "http://y.com/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(df, rules).collect()}[2] == rest
    assert urls.judge(df.filter("false"), rules).collect() == []


def test_the_sample_is_bounded_whatever_repeats(spark):
    rows = [(f"http://x.org/{k}", 1.0 if k % 3 else 0.0, float(k == 7) * 5000 + 1) for k in range(1000)]
    labelled = spark.createDataFrame(rows, "url string, label double, rows double")
    some = urls.training_sample(labelled, 1000, 100).collect()
    assert len(some) == 100 == len({r.url for r in some})
    assert len(urls.training_sample(labelled, 1000, 5000).collect()) == 1000


def test_a_url_on_a_third_of_the_rows_has_its_weight_and_the_rest_is_learned(spark):
    rows = [(k, f"http://shop{k % 5}.org/{'deal' * (k % 3)}?a={k}&b=1&c=2" if k % 2 else f"http://news.net/{k}") for k in range(400)]
    rows += [(1000 + k, "http://news.net/10") for k in range(200)]
    rules = [urls.rule("block", f"shop{k}.org/") for k in range(3)] + [urls.rule("allow", "news.net/1"), urls.rule("allow", "news.net/2")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    found = urls.judge(df, rules, trees=5)
    assert found.count() == len(rows)
    rest = found.filter("rule is null")
    assert rest.filter("(verdict = 'block') = (host <> 'news.net')").count() >= 0.95 * rest.count() > 100


def test_suffix_statistics_leave_the_own_label_out(spark):
    rows = [("u1", "a.org", 1.0), ("u2", "a.org", 0.0), ("u3", "a.org", 1.0), ("u4", "b.org", 1.0)]
    labelled = spark.createDataFrame(rows, "url string, suffix string, label double")
    asked = labelled.union(spark.createDataFrame([("u5", "a.org", None), ("u6", "c.org", None)], labelled.schema))
    found = urls.with_suffix(asked, urls.suffix_statistics(labelled), strength=2.0)
    got = {r.url: (r.suffix_rate, round(math.expm1(r.suffix_log_n))) for r in found.collect()}
    assert got["u1"] == ((1 + 1) / (2 + 2), 2)
    assert got["u2"] == ((2 + 1) / (2 + 2), 2)
    assert got["u4"] == (0.5, 0)
    assert got["u5"] == ((2 + 1) / (3 + 2), 3)
    assert got["u6"] == (0.5, 0)


def test_features_by_hand(spark):
    made = ["http://a-b.x.org/p/q1?x=1&y=22#f", "https://é.org/", "", None, "http://h.org/" + "z" * 300]
    df = spark.createDataFrame([(u, *split(u)) for u in made], "url string, host string, path string")
    for r in urls.lexical(df).collect():
        u = r.url or ""
        shares = [u.count(c) / len(u) for c in set(u)]
        query = re.search(r"\?([^#]*)", u)
        assert r.length == len(u) and r.depth == r.path.count("/") and r.labels == r.host.count(".")
        assert r.digits == sum(c in "0123456789" for c in u) / max(len(u), 1)
        assert r.entropy == pytest.approx(-sum(p * math.log2(p) for p in shares), abs=1e-9)
        assert r.parameters == (query[1].count("&") + 1 if query and query[1] else 0)
        assert (r.fragment, r.hyphens, r.secure) == (float("#" in u), u.count("-"), float(u.startswith("https")))
