"""All metric definitions by ``(module, stat)``; some have several sources."""

from __future__ import annotations

from collections.abc import Iterable

from .counter_metrics import COUNTER_METRICS
from .event_metrics import EVENT_METRICS
from .snapshot_metrics import COLLECTOR_METRICS, PROCESSES, STORAGE_METRICS
from .spec import Instrumentation, Metric, SpecError


def definitions() -> list[Metric]:
    """In the order in which the sources of one metric are tried."""
    return [
        *(m.metric() for m in COUNTER_METRICS),
        *(m.metric() for m in EVENT_METRICS),
        *STORAGE_METRICS,
        *COLLECTOR_METRICS,
        PROCESSES,
    ]


def choose(spec: Instrumentation, candidates: Iterable[Metric]) -> Metric:
    """First definition of the spec's metric that has all fields it names."""
    named = [m for m in candidates if (m.module, m.stat) == (spec.module, spec.stat)]
    if not named:
        raise SpecError(f"unknown metric {spec.module}.{spec.stat}")
    for metric in named:
        if set(spec.fields()) <= set(metric.fields):
            return metric
    raise SpecError(f"no source of {spec.module}.{spec.stat} has {spec.fields()}")
