"""JSON predicate trees as Spark columns.

A predicate is ``{}`` (true), ``{op: [field, constant]}`` with one of the six
comparisons, or ``{"and"|"or": [predicate, predicate, ...]}``.
"""

from __future__ import annotations

import operator
from collections.abc import Collection, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIVIAL: dict = {}

ORDERING = {"lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}
EQUALITY = {"eq": operator.eq, "ne": operator.ne}
COMPARISONS = {**ORDERING, **EQUALITY}
CONNECTIVES = {"and": operator.and_, "or": operator.or_}
SYMBOLS = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "==", "ne": "!=", "and": "&&", "or": "||"}


class PredicateError(ValueError):
    """The predicate is malformed or does not fit the metric's fields."""


def _split(pred: Mapping) -> tuple[str | None, list]:
    """Operator and operands; ``(None, [])`` for the trivial predicate."""
    if not isinstance(pred, Mapping):
        raise PredicateError(f"a predicate must be an object, not {pred!r}")
    if not pred:
        return None, []
    if len(pred) != 1:
        raise PredicateError(f"a predicate has exactly one key, got {sorted(pred)}")
    op, args = next(iter(pred.items()))
    if not isinstance(args, (list, tuple)):
        raise PredicateError(f"{op}: operands must be a list")
    if op in CONNECTIVES:
        if len(args) < 2:
            raise PredicateError(f"{op}: needs at least two operands")
    elif op in COMPARISONS:
        if len(args) != 2 or not isinstance(args[0], str):
            raise PredicateError(f"{op}: needs [field, constant]")
        if isinstance(args[1], bool) or not isinstance(args[1], (int, float, str)):
            raise PredicateError(f"{op}: the constant must be a number or a string")
    else:
        raise PredicateError(f"unknown predicate operator {op!r}")
    return op, list(args)


def is_trivial(pred: Mapping) -> bool:
    return _split(pred)[0] is None


def fields_of(pred: Mapping) -> list[str]:
    """Distinct fields in first-seen order."""
    op, args = _split(pred)
    if op is None:
        return []
    if op in COMPARISONS:
        return [args[0]]
    return list(dict.fromkeys(f for child in args for f in fields_of(child)))


def contains(pred: Mapping, field: str) -> bool:
    return field in fields_of(pred)


def comparison_error(field: Column, op: Column, is_text: Column, arities: Mapping[str, str]) -> Column:
    """Why a comparison given row by row is refused; NULL if it is fine.

    The rules are those of :func:`validate` for one comparison with ``{field: arity}``.
    """
    kind = F.lit(None).cast("string")
    for name, arity in arities.items():
        kind = F.when(field == name, arity).otherwise(kind)
    return (
        F.when(~F.coalesce(op.isin(*COMPARISONS), F.lit(False)), "unknown operator")
        .when(kind.isNull(), "unknown field")
        .when(op.isin(*ORDERING) & (kind != "numeric"), "discrete field")
        .when((kind == "numeric") == is_text, "constant does not fit")
    )


def validate(pred: Mapping, arities: Mapping[str, str] | None = None) -> None:
    """Raise unless ``pred`` is well formed and fits ``{field: arity}``."""
    op, args = _split(pred)
    if op is None:
        return
    if op in CONNECTIVES:
        for child in args:
            validate(child, arities)
        return
    field, constant = args
    if arities is None:
        if op in ORDERING and isinstance(constant, str):
            raise PredicateError(f"{op}: needs a number, got {constant!r}")
        return
    if field not in arities:
        raise PredicateError(f"unknown field {field!r}")
    numeric = arities[field] == "numeric"
    if op in ORDERING and not numeric:
        raise PredicateError(f"{op}: field {field!r} is discrete")
    if numeric == isinstance(constant, str):
        raise PredicateError(f"{op}: constant {constant!r} does not fit {arities[field]} field {field!r}")


def substitute(pred: Mapping, names: Mapping[str, str]) -> dict:
    """Rename fields (logical to physical)."""
    op, args = _split(pred)
    if op is None:
        return {}
    if op in CONNECTIVES:
        return {op: [substitute(child, names) for child in args]}
    return {op: [names.get(args[0], args[0]), args[1]]}


def part_on(pred: Mapping, fields: Collection[str]) -> dict:
    """What must hold of ``fields`` alone for ``pred`` to hold: the conjuncts that name no other field."""
    op, args = _split(pred)
    if op == "and":
        parts = [part for child in args if (part := part_on(child, fields))]
        return {"and": parts} if len(parts) > 1 else parts[0] if parts else {}
    return dict(pred) if op is not None and set(fields_of(pred)) <= set(fields) else {}


def to_column(pred: Mapping, columns: Mapping[str, Column] | None = None) -> Column:
    """Compile to a boolean column; ``columns`` maps fields to expressions."""
    op, args = _split(pred)
    if op is None:
        return F.lit(True)
    if op in CONNECTIVES:
        return reduce(CONNECTIVES[op], [to_column(child, columns) for child in args])
    field, constant = args
    if columns is not None and field not in columns:
        raise PredicateError(f"unknown field {field!r}")
    column = columns[field] if columns is not None else F.col(field)
    return COMPARISONS[op](column, F.lit(constant))


def apply(df: DataFrame, pred: Mapping, columns: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows that satisfy ``pred``; a NULL dimension does not."""
    if is_trivial(pred):
        return df
    missing = [f for f in fields_of(pred) if (columns is None and f not in df.columns)]
    if missing:
        raise PredicateError(f"unknown fields {missing}")
    return df.filter(to_column(pred, columns))


def describe(pred: Mapping) -> str:
    """Infix text of a predicate; trivial parts print as ``1``."""
    op, args = _split(pred)
    if op is None:
        return "1"
    if op in CONNECTIVES:
        return f" {SYMBOLS[op]} ".join(f"({describe(child)})" for child in args)
    constant = f'"{args[1]}"' if isinstance(args[1], str) else args[1]
    return f"{args[0]} {SYMBOLS[op]} {constant}"


def all_of(*preds: Mapping) -> dict:
    """Conjunction that leaves trivial parts out."""
    parts = [dict(p) for p in preds if not is_trivial(p)]
    if len(parts) < 2:
        return parts[0] if parts else {}
    return {"and": parts}


def any_of(*preds: Mapping) -> dict:
    return dict(preds[0]) if len(preds) == 1 else {"or": [dict(p) for p in preds]}


def zone_scope(zones: list[str], pred: Mapping = TRIVIAL, field: str = "zonename", prefix: str = "") -> dict:
    """Restrict ``pred`` to a list of zones (storage names carry ``zones/``)."""
    if not zones:
        raise PredicateError("no zones to scope to")
    return all_of(any_of(*({"eq": [field, prefix + z]} for z in zones)), pred)


def scope_to_zones(df: DataFrame, zones: DataFrame, field: str = "zonename") -> DataFrame:
    """The same for a zone *table*: a semi-join, so the list may be long."""
    return df.join(zones.select(F.col("zonename").alias(field)), field, "left_semi")


def drill_down(pred: Mapping, field: str, key: str) -> dict:
    """Predicate after clicking ``key`` of the discrete decomposition ``field``."""
    return all_of({"eq": [field, key]}, pred)
