from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tickloom.operators import predicates as p

def test_comparisons(spark):
    """Every operator on every value of a small table, texts included."""
    rows = [(n, word) for n in (-3, 0, 7) for word in ("oak", "elm", "")]
    df = spark.createDataFrame(rows, "girth int, tree string")
    preds = [{op: ["girth", n]} for op in sorted(p.COMPARISONS) for n in (-3, 0, 1, 7)]
    preds += [{op: ["tree", word]} for op in ("eq", "ne") for word in ("oak", "", "ash")]
    for row in df.select("*", *(p.to_column(x).alias(f"c{i}") for i, x in enumerate(preds))).collect():
        for i, x in enumerate(preds):
            assert row[f"c{i}"] is by_hand(x, row.asDict()), x


@pytest.mark.parametrize(
    "pred",
    [23, "23", ["foo"], {"eq": []}, {"eq": {}}, {"inval": [1, 2]}, {"eq": ["a", 1], "ne": ["a", 2]}, {"and": [{}]},
     {"eq": [1, 2]}, {"lt": ["a", True]}, {"eq": ["a", None]}, {"le": ["string", "x"]}],
)
def test_malformed(pred):
    with pytest.raises(p.PredicateError):
        p.validate(pred)


def test_field_checks():
    arities = {"latency": "numeric", "zonename": "discrete"}
    p.validate({"and": [{"gt": ["latency", 1]}, {"eq": ["zonename", "x"]}]}, arities)
    for bad in ({"gt": ["zonename", 3]}, {"eq": ["latency", "x"]}, {"eq": ["zonename", 3]}, {"eq": ["junk", 3]}):
        with pytest.raises(p.PredicateError):
            p.validate(bad, arities)


def test_missing_column(spark):
    with pytest.raises(p.PredicateError):
        p.apply(spark.range(1), {"le": ["junk", 3]})


def test_fields_and_substitution():
    pred = {"or": [{"le": ["nbytes", 4096]}, {"and": [{"ne": ["execname", "cron"]}, {"lt": ["nbytes", 9]}]}, {"eq": ["port", 22]}]}
    assert p.fields_of(pred) == ["nbytes", "execname", "port"]
    assert p.contains(pred, "port") and not p.contains(pred, "cron")
    renamed = p.substitute(pred, {"nbytes": "size / 8", "port": "p"})
    assert p.describe(renamed) == '(size / 8 <= 4096) || ((execname != "cron") && (size / 8 < 9)) || (p == 22)'
    assert p.fields_of(pred) == ["nbytes", "execname", "port"]  # the original stays
    assert p.describe({"and": [{}, {"ge": ["port", 1]}]}) == "(1) && (port >= 1)"
    assert p.is_trivial({}) and not p.is_trivial(pred)


def test_scope_and_drill_down():
    zones = p.zone_scope(["foo", "bar"], prefix="zones/", field="zdataset")
    assert zones == {"or": [{"eq": ["zdataset", "zones/foo"]}, {"eq": ["zdataset", "zones/bar"]}]}
    assert p.zone_scope(["a"], {"gt": ["latency", 1]}) == {"and": [{"eq": ["zonename", "a"]}, {"gt": ["latency", 1]}]}
    assert p.drill_down({}, "optype", "read") == {"eq": ["optype", "read"]}
    assert p.drill_down({"gt": ["x", 1]}, "optype", "read") == {"and": [{"eq": ["optype", "read"]}, {"gt": ["x", 1]}]}


LEAVES = st.one_of(
    st.tuples(st.sampled_from(sorted(p.COMPARISONS)), st.sampled_from(["a", "b"]), st.integers(-2, 2)).map(
        lambda t: {t[0]: [t[1], t[2]]}
    ),
    st.just({}),
)
TREES = st.recursive(
    LEAVES, lambda kids: st.tuples(st.sampled_from(["and", "or"]), st.lists(kids, min_size=2, max_size=3)).map(lambda t: {t[0]: t[1]}),
    max_leaves=6,
)


def by_hand(pred, row):
    if not pred:
        return True
    op, args = next(iter(pred.items()))
    if op == "and":
        return all(by_hand(c, row) for c in args)
    if op == "or":
        return any(by_hand(c, row) for c in args)
    return p.COMPARISONS[op](row[args[0]], args[1])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TREES, min_size=1, max_size=8))
def test_any_tree(spark, preds):
    points = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]
    df = spark.createDataFrame(points, "a int, b int")
    for row in df.select("a", "b", *(p.to_column(x).alias(f"c{i}") for i, x in enumerate(preds))).collect():
        for i, x in enumerate(preds):
            assert row[f"c{i}"] == by_hand(x, row.asDict())
