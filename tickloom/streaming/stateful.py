"""Stateful streams: event pairing, completeness of slots and counter deltas.

Pairing and completeness keep their state with ``transformWithState``, which
needs the RocksDB state store: start their queries within :func:`state_store`, as the
sinks do.  Batch data goes through ``operators.pairing``, ``operators.slots`` and
``operators.counters`` instead, which cut the rows of a key over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.slots import SETTLE, WINDOW

OUTPUT = "append"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MS = 1_000_000
#: Rows are handed to the state so many at a time.
CHUNK = 1000


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that stateful queries need, for queries started within; the session's own comes back."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


class _Pairing(StatefulProcessor):
    """Rows of a key wait until the watermark has passed them and are then gone through in their order."""

    def __init__(self, keys: Sequence[str], orphan_ns: int | None):
        self.keys, self.orphan_ns = list(keys), orphan_ns

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, seq long, is_start boolean, vts long")
        self.pending = handle.getValueState("pending", "ts long, vts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, some = None, []
        for r in rows:
            some.append((r["ts_ns"], r["seq"], r["kind"] == "start", r["vts_ns"]))
            first = r["ts_ns"] if first is None else min(first, r["ts_ns"])
            if len(some) == CHUNK:
                self.waiting.appendList(some)
                some = []
        if some:
            self.waiting.appendList(some)
        if first is not None:
            self.handle.registerTimer(first // MS + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = (timerValues.getCurrentWatermarkInMs() + 1) * MS
        due, later = [], []
        for row in self.waiting.get():
            row = tuple(row)
            (due if row[0] < upto else later).append(row)
        if not due and not self.pending.exists():
            return
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(min(r[0] for r in later) // MS + 1)
        start = tuple(self.pending.get()) if self.pending.exists() else None
        for ts, _, is_start, vts in sorted(due):
            if is_start:
                start = (ts, vts)
                continue
            if start is not None and not self._orphaned(start, ts):
                names = dict(zip(self.keys, key, strict=True))
                yield Row(**names, ts_ns=ts, latency=ts - start[0], cputime=vts - start[1])
            start = None
        if start is not None and self._orphaned(start, upto):
            start = None
        if start is None:
            self.pending.clear()
        else:
            self.pending.update(start)
            if self.orphan_ns is not None:
                self.handle.registerTimer((start[0] + self.orphan_ns) // MS + 1)

    def _orphaned(self, start: tuple[int, int], now: int) -> bool:
        return self.orphan_ns is not None and now - start[0] > self.orphan_ns

    def close(self) -> None:
        pass


def pair_stream(
    events: DataFrame,
    keys: Sequence[str],
    delay: str = "10 seconds",
    orphan_ms: int | None = None,
) -> DataFrame:
    """Finished operations of an event stream, in the order of event time.

    ``events``: keys, ``kind`` ("start"/"done"), ``ts_ns``, ``vts_ns``, ``seq``.
    Gives keys, ``ts_ns``, ``latency``, ``cputime`` per paired done, as the batch
    pairing does by ``(ts_ns, seq)``, however the rows are shuffled over
    micro-batches within ``delay``.  A key keeps the rows that the watermark has
    not passed and one pending start.  Later rows are dropped.  A start is
    forgotten after ``orphan_ms`` of event time, and no done pairs with it then.
    """
    keys = list(keys)
    rows = events.select(*keys, "kind", "ts_ns", "vts_ns", "seq", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000)).alias("__time"))
    longs = [T.StructField(c, T.LongType()) for c in ("ts_ns", "latency", "cputime")]
    schema = T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in keys), *longs])
    orphan_ns = None if orphan_ms is None else orphan_ms * MS
    return rows.withWatermark("__time", delay).groupBy(*keys).transformWithState(
        _Pairing(keys, orphan_ns), schema, OUTPUT, "eventTime"
    )


EMITTED = "inst_id string, slot long, value double, reporting long, expected long, complete boolean, reason string"


class _Completeness(StatefulProcessor):
    """An instrumentation's slots that may still change or are looked back at."""

    def __init__(self, g: int, retention: int, timeout: int):
        self.g, self.retention, self.timeout = g, retention, timeout
        self.back = -(-(SETTLE + WINDOW) // g) * g
        self.length = -(-WINDOW // g) * g

    def init(self, handle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot long", "value double, sources array<string>, emitted boolean")
        self.clock = handle.getValueState("clock", "seconds long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh: dict[int, list] = {}
        latest = self.clock.get()[0] if self.clock.exists() else 0
        for r in rows:
            slot = r["t"] - r["t"] % self.g
            latest = max(latest, r["t"])
            entry = fresh.setdefault(slot, [0.0, set(), 0])
            entry[0] += r["value"] if r["value"] is not None else 0.0
            entry[1].add(r["source"])
            entry[2] += 1
        self.clock.update((latest,))
        changed: dict[int, tuple] = {}
        for slot, (value, sources, n) in sorted(fresh.items()):
            before = self._get(slot)
            if before is not None and before[2]:
                yield self._row(key, slot, value, n, None, None, "late")
                continue
            known = before or (0.0, (), False)
            changed[slot] = (known[0] + value, sorted(sources.union(known[1])), False)
            self.slots.updateValue((slot,), changed[slot])
        yield from self._emit(key, latest)
        if changed:
            self.handle.registerTimer((min(changed) + self.g + self.timeout) * 1000)
            self.handle.registerTimer((max(changed) + self.g + self.back + self.retention) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The instrumentation may be silent: then the watermark is its clock."""
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        yield from self._emit(key, max(passed, self.clock.get()[0] if self.clock.exists() else 0))
        for (slot,) in [tuple(k) for k in self.slots.keys()]:
            if slot + self.g + self.back <= passed:
                self.slots.removeKey((slot,))

    def _get(self, slot: int):
        return tuple(self.slots.getValue((slot,))) if self.slots.containsKey((slot,)) else None

    def _emit(self, key, clock: int) -> Iterator[Row]:
        held = {tuple(k)[0]: tuple(v) for k, v in self.slots.iterator()}
        for slot, (value, sources, emitted) in sorted(held.items()):
            if emitted:
                continue
            window = range(slot - self.back, slot - self.back + self.length, self.g)
            expected = max((len(held[s][1]) for s in window if s in held), default=0)
            complete = len(sources) >= expected
            if complete or slot + self.g + self.timeout <= clock:
                self.slots.updateValue((slot,), (value, sources, True))
                yield self._row(key, slot, value, len(sources), expected, complete, "complete" if complete else "timeout")

    @staticmethod
    def _row(key, slot, value, reporting, expected, complete, reason) -> Row:
        return Row(inst_id=key[0], slot=slot, value=value, reporting=reporting, expected=expected, complete=complete, reason=reason)

    def close(self) -> None:
        pass


def emitted(reports: DataFrame, g: int, retention: int, timeout: int = SETTLE) -> DataFrame:
    """Each slot once, with its value and count, as soon as all expected sources have reported or ``timeout`` passed.

    ``reports``: ``inst_id, source, t`` (seconds), ``value`` and ``event_time``;
    a NULL value reports without adding to the sum.  Expected are the most
    sources of a slot in the settled window, see ``slots.expected``.  After a
    micro-batch the slots that are complete come out with reason ``complete``, and
    those whose end the instrumentation's latest report (or the watermark, if it
    has gone silent) has passed by ``timeout`` seconds with reason ``timeout``.
    What comes in for a slot that is out is counted apart: reason ``late`` with
    the sum of the values and the number of reports.  State is a row per slot
    within the retention.
    """
    rows = reports.select("inst_id", "source", "t", F.col("value").cast("double").alias("value"), "event_time")
    return rows.withWatermark("event_time", f"{retention} seconds").groupBy("inst_id").transformWithState(
        _Completeness(g, retention, timeout), EMITTED, OUTPUT, "eventTime"
    )


def delta_stream(
    snapshots: DataFrame, keys: Sequence[str], key_schema: str, counters: Sequence[str], forget_ms: int | None = None
) -> DataFrame:
    """Growth of each counter between consecutive reads of a record.

    ``snapshots``: keys, ``read_no``, ``snaptime`` and the counters as bigints.
    Gives keys, ``read_no``, ``interval`` and ``d_<counter>``.  A record that has
    not been read for ``forget_ms`` of processing time is forgotten; that needs a
    running trigger.
    """
    keys, counters = list(keys), list(counters)
    tracked = ["read_no", "snaptime", *counters]
    outputs = ["read_no", "interval", *(f"d_{c}" for c in counters)]
    timeout = GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # records are many and each has few rows: plain arrays, as frames cost more than what is in them
        parts = [np.column_stack([b[c].to_numpy(dtype="int64") for c in tracked]) for b in batches]
        rows = np.concatenate(parts)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        if state.exists:
            rows = np.vstack([np.array(state.get, dtype="int64"), rows])
        state.update(tuple(int(v) for v in rows[-1]))
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        grown = np.diff(rows, axis=0)
        consecutive = grown[:, 0] == 1
        if not consecutive.any():
            return
        grown[:, 0] = rows[1:, 0]
        yield pd.DataFrame({**dict(zip(keys, key)), **dict(zip(outputs, grown[consecutive].T))})

    schema = ", ".join([key_schema, *(f"{c} long" for c in outputs)])
    state_schema = ", ".join(f"{c} long" for c in tracked)
    return snapshots.select(*keys, *tracked).groupBy(*keys).applyInPandasWithState(
        step, schema, state_schema, OUTPUT, timeout
    )
