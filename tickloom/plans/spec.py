"""Instrumentation: metric + predicate + decomposition + granularity -> slots.

A :class:`Metric` turns its source table into points (``t``, ``value`` and the
dimension columns asked for); :func:`instrument` filters, groups and slots them
in one lazy plan.  Only the fields a spec names are built, so Spark prunes the
rest at the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import Bucketizer
from ..operators import predicates
from ..operators.aggregate import decompose
from ..operators.slots import MAX_SLOTS, SLOWEST, accumulate, down, not_from_future, on_sampling_grid, retain

# --- fixed values: defaults and limits of an instrumentation --------------------
DEFAULT_RETENTION = 600
GRANULARITY_STEP = 5
# ---------------------------------------------------------------------------------


class SpecError(ValueError):
    """The instrumentation does not fit the metric or the limits."""


@dataclass(frozen=True)
class FieldDef:
    """A dimension: numeric ones carry their bucketizer."""

    bucket: Bucketizer | None = None

    @property
    def arity(self) -> str:
        return "discrete" if self.bucket is None else "numeric"


@dataclass(frozen=True)
class Metric:
    """``points(source, fields)`` gives ``t, value`` and the named dimensions.

    With ``scope="point"`` the values are readings: of the reports that a
    source (the field ``reporter``) makes in a slot only the first one counts.
    The points of one source and second are a report.

    ``early`` maps fields to columns of the source table that have the same
    value in all rows that are brought together into a point: a condition on
    them is checked before rows are paired and shuffled.
    """

    module: str
    stat: str
    fields: Mapping[str, FieldDef]
    points: Callable[[DataFrame, Sequence[str]], DataFrame]
    scope: str = "interval"
    source: str = "events"
    reporter: str = "hostname"
    early: Mapping[str, str] = field(default_factory=dict)

    @property
    def arities(self) -> dict[str, str]:
        return {n: f.arity for n, f in self.fields.items()}


@dataclass(frozen=True)
class Instrumentation:
    module: str
    stat: str
    predicate: Mapping = field(default_factory=dict)
    decomposition: Sequence[str] = ()
    granularity: int = 1
    retention: int = DEFAULT_RETENTION
    zones: Sequence[str] | None = None

    def fields(self) -> list[str]:
        scope = ["zonename"] if self.zones else []
        return list(dict.fromkeys([*predicates.fields_of(self.predicate), *self.decomposition, *scope]))

    def validate(self, arities: Mapping[str, str]) -> None:
        g = self.granularity
        if g != 1 and (g < 1 or g % GRANULARITY_STEP):
            raise SpecError("granularity must be 1 or a multiple of 5")
        if self.retention < 0 or self.retention / g > MAX_SLOTS:
            raise SpecError(f"retention may cover at most {MAX_SLOTS} slots")
        unknown = [f for f in self.decomposition if f not in arities]
        if unknown:
            raise SpecError(f"unknown fields {unknown}")
        kinds = [arities[f] for f in self.decomposition]
        if kinds.count("discrete") > 1 or kinds.count("numeric") > 1:
            raise SpecError("at most one discrete and one numeric decomposition")
        predicates.validate(self.predicate, arities)


def ordered_decomposition(spec: Instrumentation, arities: Mapping[str, str]) -> list[str]:
    """Discrete first, numeric last."""
    return sorted(spec.decomposition, key=lambda f: arities[f] == "numeric")


def value_arity(spec: Instrumentation, arities: Mapping[str, str]) -> tuple[str, int]:
    """Kind of value and its dimension."""
    kinds = {arities[f] for f in spec.decomposition}
    if not kinds:
        kind = "scalar"
    else:
        kind = "numeric-decomposition" if "numeric" in kinds else "discrete-decomposition"
    return kind, len(spec.decomposition) + 1


def value_arities(fields: Column, arities: Mapping[str, str]) -> tuple[Column, Column]:
    """The same for decompositions given row by row as arrays of field names."""
    numeric = F.array(*[F.lit(n) for n, kind in arities.items() if kind == "numeric"]).cast("array<string>")
    kind = (
        F.when(F.size(fields) == 0, "scalar")
        .when(F.arrays_overlap(fields, numeric), "numeric-decomposition")
        .otherwise("discrete-decomposition")
    )
    return kind, F.size(fields) + 1


def collection_granularity(granularity: int) -> int:
    """How often a source reports: once per slot, but at least every 5 s."""
    return min(granularity, SLOWEST)


def instrument(
    source: DataFrame,
    metric: Metric,
    spec: Instrumentation,
    by: Sequence[str] = (),
    now: int | Column | None = None,
    on_grid: bool = False,
) -> DataFrame:
    """Long-form slots ``by..., slot, [key], [lo, hi], value`` of a spec.

    ``by`` keeps further point columns, e.g. the reporting source.  Metrics of
    point scope are summed per source and second first (map-side combining) and
    give the first report of each source and slot; a report in which the
    predicate leaves nothing isn't seen.

    With ``now`` points from further ahead than a clock may be are dropped, and
    slots older than the spec's retention (0 keeps all).  ``on_grid`` keeps the
    points of the seconds at which a source is due.
    """
    spec.validate(metric.arities)
    pred = spec.predicate
    if spec.zones:
        pred = predicates.zone_scope(list(spec.zones), pred)
    fields = spec.fields()
    if metric.scope == "point":
        fields = list(dict.fromkeys([*fields, metric.reporter, *by]))
    early = predicates.part_on(pred, [n for n, column in metric.early.items() if column in source.columns])
    source = predicates.apply(source, predicates.substitute(early, metric.early))
    points = predicates.apply(metric.points(source, fields), pred)
    if on_grid:
        points = on_sampling_grid(points, spec.granularity)
    if now is not None:
        points = retain(not_from_future(points, now), now, spec.retention, down(F.col("t"), spec.granularity))
    key = rng = None
    for name in ordered_decomposition(spec, metric.arities):
        definition = metric.fields[name]
        if definition.bucket is None:
            key = F.col(name)
        else:
            rng = definition.bucket(F.col(name))
    slot: Column = down(F.col("t"), spec.granularity).alias("slot")
    if metric.scope != "point":
        return decompose(points, key=key, rng=rng, by=[*by, slot])
    kept = [n for n in by if n != "source"]
    reports = decompose(points, key=key, rng=rng, by=[*kept, slot, F.col(metric.reporter).alias("source"), "t"])
    sums = accumulate(reports, "point", ["t"], by)
    dims = [c for c in ("key", "lo", "hi") if c in sums.columns]
    return sums.select(*by, "slot", *dims, "value")
