"""Outermost calls, matched by the depth of the stack.

A thread is idle or inside one outermost call.  An enter of an idle thread
begins a call and keeps its stack depth; the first leave at that depth ends it.
All other enters and leaves, those of nested calls among them, change nothing,
so a lost leave of a nested call does no harm.

Rows of a key are cut into time slices.  What a slice does is a function of the
state it begins in, and a small one: from idle to some state, and for each depth
at which it has leaves from a call of that depth to some state; calls of other
depths go through.  These functions are composed along the slices of a key, and
each slice is then gone through from the state it really begins in.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import SLICE, Timeline

ENTER, DEPTH, GATHERED, FIRST, PASS = "__enter", "__depth", "__gathered", "__first", "__pass"

#: A state: None is idle, else the depth of the call that goes on and what was gathered at its begin.
State = tuple[int, Any] | None


def _kinds(df: DataFrame, columns) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType) for c in columns]


def _rows(batch: pa.RecordBatch, columns) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def slice_functions(rows: DataFrame, line: Timeline) -> DataFrame:
    """Each slice's function: keys, slice, ``__pass`` with an entry per state it may begin in.

    ``from`` is the depth of a call, or NULL for idle; ``depth`` (NULL: idle) and
    ``gathered`` are the state it ends in.  A depth without an entry goes through.
    Rows come from the last to the first: then the function of the rows behind a
    row is known.
    """
    place = [*line.keys, SLICE]
    gathered = rows.schema[GATHERED].dataType
    entry = T.StructType([
        T.StructField("from", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("gathered", gathered),
    ])
    schema = T.StructType([*_kinds(rows, place), T.StructField(PASS, T.ArrayType(entry))])

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, idle, ends, finished, known = None, None, {}, [], None

        def finish() -> None:
            entries = [(None, idle), *ends.items()]
            finished.append((*here, [{"from": d, "depth": s and s[0], "gathered": s and s[1]} for d, s in entries]))

        def packed() -> pa.RecordBatch:
            entry = pa.struct([("from", pa.int64()), ("depth", pa.int64()), ("gathered", known.field(GATHERED).type)])
            kinds = [*(known.field(c).type for c in place), pa.list_(entry)]
            columns = [pa.array(c, k) for c, k in zip(zip(*finished, strict=True), kinds, strict=True)]
            return pa.record_batch(columns, names=[*place, PASS])

        for batch in batches:
            known = batch.schema
            for *where, enters, depth, value in _rows(batch, [*place, ENTER, DEPTH, GATHERED]):
                if tuple(where) != here:
                    if here is not None:
                        finish()
                    here, idle, ends = tuple(where), None, {}
                if enters:
                    # a call begun here ends where one of its depth would, or goes on
                    idle = ends.get(depth, (depth, value))
                else:
                    ends[depth] = idle
            if finished:
                yield packed()
                finished = []
        if here is not None:
            finish()
            yield packed()

    order = [F.desc(c) for c in line.order]
    slim = rows.select(*place, *line.order, ENTER, DEPTH, GATHERED)
    ordered = slim.repartition(*place).sortWithinPartitions(*place, *order)
    return ordered.mapInArrow(backwards, schema)


def begun(functions: DataFrame, line: Timeline) -> DataFrame:
    """The states other than idle that slices begin in: keys, slice, ``__depth``, ``__gathered``."""
    place = [*line.keys, SLICE]
    gathered = functions.schema[PASS].dataType.elementType["gathered"].dataType
    schema = T.StructType([*_kinds(functions, place), T.StructField(DEPTH, T.LongType()), T.StructField(GATHERED, gathered)])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, None
        for batch in batches:
            at, out = [], []
            for row, (*where, entries) in enumerate(_rows(batch, [*place, PASS])):
                if where[:-1] != here:
                    here, state = where[:-1], None
                if state is not None:
                    at.append(row)
                    out.append(state)
                for e in entries:
                    if e["from"] == (state and state[0]):
                        state = None if e["depth"] is None else (e["depth"], e["gathered"])
                        break
            columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in place]
            kind = batch.schema.field(PASS).type.value_type.field("gathered").type
            depths, values = zip(*out, strict=True) if out else ((), ())
            yield pa.record_batch([*columns, pa.array(depths, pa.int64()), pa.array(values, kind)], names=[*place, DEPTH, GATHERED])

    # a key's slices are as many as the time has, whatever the number of rows
    return functions.repartition(*line.keys).sortWithinPartitions(*place).mapInArrow(along, schema)


def outermost_by_depth(
    events: DataFrame, line: Timeline, enter: Column, leave: Column, depth: Column, gather: Mapping[str, Column]
) -> DataFrame:
    """Leave events that end an outermost call, with the values gathered at its enter.

    A row without a depth changes nothing.  ``line.order`` must be a total order
    within a key; its columns and the keys must not be NULL.
    """
    place = [*line.keys, SLICE]
    values = F.struct(*(c.alias(n) for n, c in gather.items())) if gather else F.struct(F.lit(True).alias("__none"))
    rows = events.filter((enter | leave) & depth.isNotNull()).select(
        *events.columns, line.slice.alias(SLICE), enter.alias(ENTER), depth.cast("bigint").alias(DEPTH),
        F.when(enter, values).alias(GATHERED),
    )
    states = begun(slice_functions(rows, line), line).withColumn(FIRST, F.lit(True))
    both = rows.withColumn(FIRST, F.lit(False)).unionByName(states, allowMissingColumns=True)
    both = both.repartition(*place).sortWithinPartitions(*place, F.desc(FIRST), *line.order)
    schema = T.StructType([*_kinds(events, events.columns), T.StructField(GATHERED, rows.schema[GATHERED].dataType)])

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, None
        for batch in batches:
            at, out = [], []
            for row, (*where, first, enters, depth, value) in enumerate(_rows(batch, [*place, FIRST, ENTER, DEPTH, GATHERED])):
                if where != here:
                    here, state = where, None
                if first or (enters and state is None):
                    state = (depth, value)
                elif not enters and state is not None and state[0] == depth:
                    at.append(row)
                    out.append(state[1])
                    state = None
            columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in events_columns]
            found = pa.array(out, batch.schema.field(GATHERED).type)
            yield pa.record_batch([*columns, found], names=[*events_columns, GATHERED])

    events_columns = list(events.columns)
    ended = both.mapInArrow(forwards, schema)
    return ended.select(*events_columns, *(F.col(f"{GATHERED}.{n}").alias(n) for n in gather))
