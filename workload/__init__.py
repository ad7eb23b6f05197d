"""Queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from . import aggregation, catalog, counters, events, heatmaps, predicates, scalars, sources, streams, timeslots, values
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
_ = (
    aggregation, catalog, counters, events, heatmaps, predicates, scalars, sources, streams, timeslots, values,
)
