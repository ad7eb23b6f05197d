from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tickloom.operators import pairing, slots
from tickloom.operators.aggregate import merge
from tickloom.sources import snapshots as snap
from tickloom.sources import tables, wire
from tickloom.sources.snapshots import capture, load, save
from tickloom.sources.workdir import SETTING, new_dir, shared_dir
from tickloom.streaming import sinks
from tickloom.streaming import slots as st
from tickloom.streaming.stateful import STORE, delta_stream, emitted, pair_stream

ONCE = {"availableNow": True}
REPORTS = "inst_id string, source string, ts_ms bigint, seq bigint, value double"


def stream_of(spark, path, schema, batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def reports(spark, tmp_path, *batches):
    rows = [[("i", s, t * 1000, n, v) for n, (s, t, v) in enumerate(batch)] for batch in batches]
    return st.with_event_time(stream_of(spark, str(tmp_path / "in"), REPORTS, rows))


def read(spark, path):
    return spark.read.parquet(f"{path}/data")


def test_revised_slots(spark, tmp_path):
    stream = reports(spark, tmp_path, [("a", 101, 5.0), ("b", 112, 1.0)], [("b", 104, 7.0)], [("c", 119, 2.0)])
    out = str(tmp_path / "out")
    sinks.revised_table(st.tumbling(stream, 10, 600), out, ONCE).awaitTermination()
    assert {r["slot"]: r["value"] for r in sinks.latest(spark, out, ["slot"]).collect()} == {100: 12, 110: 3}
    revisions = {(r["slot"], r["value"]) for r in read(spark, out).collect()}
    assert {(100, 5.0), (100, 12.0), (110, 1.0), (110, 3.0)} <= revisions


def test_settled_slots_come_once(spark, tmp_path):
    """Slots whose end is five seconds past come out; data for them is then late."""
    stream = reports(spark, tmp_path, [("a", 101, 5.0), ("a", 117, 1.0)], [("a", 131, 1.0)], [("b", 103, 9.0)], [("a", 160, 1.0)])
    out = str(tmp_path / "out")
    sinks.append_table(st.settled(stream, 10), out, ONCE).awaitTermination()
    got = sorted((r["slot"], r["value"]) for r in read(spark, out).collect())
    assert got == [(100, 5.0), (110, 1.0), (130, 1.0)]


def test_first_reports(spark, tmp_path):
    schema = "inst_id string, source string, ts_ms bigint, seq bigint, items array<struct<key: string, lo: double, hi: double, value: double>>"
    item = lambda key, v: (key, None, None, v)
    rows = [
        [("i", "a", 104_000, 1, [item("x", 50.0), item("z", 1.0)]), ("i", "b", 102_000, 2, [item("x", 1.0)])],
        [("i", "a", 101_000, 3, [item("x", 5.0), item("y", 6.0)])], [("i", "a", 500_000, 4, [item("x", 0.0)])],
    ]
    stream = st.with_event_time(stream_of(spark, str(tmp_path / "in"), schema, rows))
    out = str(tmp_path / "out")
    sinks.append_table(st.first_reports(stream, 10, 60), out, ONCE).awaitTermination()
    assert {(r["slot"], r["key"]): r["value"] for r in read(spark, out).collect()} == {(100, "x"): 6, (100, "y"): 6}


def test_arrivals_and_completeness(spark, tmp_path):
    batches = [[(s, 100 + t, 1.0) for s in "ab" for t in range(0, 40, 5)], [("a", 101, 1.0), ("a", 141, 1.0), ("c", 100, 1.0)]]
    out = str(tmp_path / "out")
    sinks.append_table(st.arrivals(reports(spark, tmp_path, *batches), 10, 600), out, ONCE).awaitTermination()
    arrived = read(spark, out)
    assert arrived.count() == 10
    got = {r["slot"]: (r["reporting"], r["expected"], r["complete"]) for r in slots.complete(slots.reporting(arrived), 10).collect()}
    assert got[100] == (3, 0, True) and got[120] == (2, 3, False) and got[130] == (2, 2, True) and got[140] == (1, 2, False)


def test_sliding(spark, tmp_path):
    updates = [("a", 101, 5.0), ("a", 112, 1.0), ("a", 125, 2.0)]
    out = str(tmp_path / "out")
    sinks.revised_table(st.sliding(reports(spark, tmp_path, updates), 30, 10, 600), out, ONCE).awaitTermination()
    live = {r["slot"]: r["value"] for r in sinks.latest(spark, out, ["slot"]).collect()}
    assert live == {80: 5, 90: 6, 100: 8, 110: 3, 120: 2}
    done = spark.createDataFrame([(100, 5.0), (110, 1.0), (120, 2.0)], "slot bigint, value double")
    assert {r["slot"]: r["value"] for r in st.sliding_from_slots(done, 30, 10).collect()} == live


EVENTS = "key int, kind string, ts_ns bigint, vts_ns bigint, seq bigint"


def test_pairs_in_the_order_of_event_time(spark, tmp_path):
    """Rows come in any order within the delay, over micro-batches of any size, and pair as the batch does."""
    import random

    rng = random.Random(9)
    second = 1_000_000_000
    rows = [(1 if rng.random() < 0.7 else 2, rng.choice(["start", "done"]), (i // 2 + 1) * second, i, i) for i in range(160)]
    shuffled = rng.sample(rows, len(rows))
    end = (3, "done", 10_000 * second, 0, 1000)  # the watermark passes all others
    stream = stream_of(spark, str(tmp_path / "in"), EVENTS, [shuffled[:1], shuffled[1:60], shuffled[60:61], shuffled[61:], [end]])
    before = spark.conf.get(STORE, None)
    out = str(tmp_path / "out")
    sinks.append_table(pair_stream(stream, ["key"], "10 minutes"), out, ONCE).awaitTermination()
    assert spark.conf.get(STORE, None) == before
    start, done = F.col("kind") == "start", F.col("kind") == "done"
    clocks = {"start_ts": F.col("ts_ns"), "start_vts": F.col("vts_ns")}
    batch = pairing.pair(spark.createDataFrame(rows, EVENTS), pairing.timeline(["key"], span=7.0 * second), start, done, clocks)
    want = batch.select("key", "ts_ns", pairing.latency().alias("latency"), pairing.cpu_time().alias("cputime"))
    assert sorted(map(tuple, read(spark, out).collect())) == sorted(map(tuple, want.collect()))


def test_starts_are_kept_between_batches_and_orphans_go(spark, tmp_path):
    second = 1_000_000_000
    at = lambda key, kind, t: (key, kind, t * second, t, t)
    batches = [[at(1, "start", 100), at(2, "start", 100)], [at(3, "done", 160)], [at(1, "done", 170), at(3, "done", 175)],
               [at(2, "done", 400)], [at(3, "done", 500)], [at(3, "done", 900)]]
    for orphan_ms, want in ((None, {(1, 170, 70), (2, 400, 300)}), (120_000, {(1, 170, 70)})):
        where = tmp_path / str(orphan_ms)
        stream = stream_of(spark, str(where / "in"), EVENTS, batches)
        sinks.append_table(pair_stream(stream, ["key"], "10 seconds", orphan_ms), str(where), ONCE).awaitTermination()
        got = {(r["key"], r["ts_ns"] // second, r["latency"] // second) for r in read(spark, str(where)).collect()}
        assert got == want


def test_slots_come_out_complete_or_in_time(spark, tmp_path):
    """Slots of 10 s: the settled window is the slot 20 s before."""
    batches = [
        [("a", 101, 1.0), ("b", 109, 2.0)],  # nothing is expected: out at once
        [("a", 111, 3.0)],
        [("a", 120, 5.0), ("b", 121, 6.0)],
        [("a", 131, 7.0)],
        [("b", 138, None), ("b", 103, 50.0)],  # completes 130; 103 is late
        [("a", 149, 1.0)],
        [("a", 166, 1.0)],  # 140 is out of time
    ]
    out = str(tmp_path / "out")
    schema = "inst_id string, source string, ts_ms bigint, seq bigint, value double"
    rows = [[("i", s, t * 1000, n, v) for n, (s, t, v) in enumerate(batch)] for batch in batches]
    stream = st.with_event_time(stream_of(spark, str(tmp_path / "in"), schema, rows)).withColumn("t", F.floor(F.col("ts_ms") / 1000))
    sinks.append_table(emitted(stream, 10, 600), out, ONCE).awaitTermination()
    got = {(r.slot, r.reason): (r.value, r.reporting, r.expected, r.complete) for r in read(spark, out).collect()}
    assert got[100, "complete"] == (3.0, 2, 0, True) and got[110, "complete"] == (3.0, 1, 0, True)
    assert got[120, "complete"] == (11.0, 2, 2, True)
    assert got[100, "late"] == (50.0, 1, None, None)
    emitted_once = [slot for slot, reason in got if reason != "late"]
    assert len(emitted_once) == len(set(emitted_once))
    counts = {100: 2, 110: 1, 120: 2, 130: 2, 140: 1, 160: 1}
    for (slot, reason), row in got.items():
        if reason != "late":
            assert row[2] == counts.get(slot - 20, 0) and row[3] == (row[1] >= row[2]) and (reason == "complete") == row[3]
    assert got[140, "timeout"][:3] == (1.0, 1, 2)


def test_deltas_across_batches(spark, tmp_path):
    schema = "key string, read_no bigint, snaptime bigint, c bigint"
    reads = {"a": [0, 1, 2, 4, 5], "b": [1, 2]}
    rows = [(k, n, n * 10, 2**60 + n * n) for k, ns in reads.items() for n in ns]
    batches = [[r for r in rows if r[1] == n] for n in range(6) if any(r[1] == n for r in rows)]
    out = str(tmp_path / "out")
    sinks.append_table(delta_stream(stream_of(spark, str(tmp_path / "in"), schema, batches), ["key"], "key string", ["c"]), out, ONCE).awaitTermination()
    got = sorted((r["key"], r["read_no"], r["interval"], r["d_c"]) for r in read(spark, out).collect())
    assert got == [("a", 1, 10, 1), ("a", 2, 10, 3), ("a", 5, 10, 9), ("b", 2, 10, 3)]


def test_snapshots_of_a_stream(spark, tmp_path):
    schema = "inst_id string, source string, t bigint, slot bigint, value double"
    batches = [[("i", "a", 101, 100, 5.0)], [("i", "b", 109, 100, 6.0), ("j", "a", 111, 110, 1.0)]]
    start = spark.createDataFrame([("i", "z", 90, 100, 100.0)], schema)
    save(capture(start, slots.interval_scope(start), 10), str(tmp_path / "old"))
    out = str(tmp_path / "out")
    query = sinks.save_snapshots(stream_of(spark, str(tmp_path / "in"), schema, batches), out, 10, ONCE, restore_from=str(tmp_path / "old"))
    query.awaitTermination()
    final = load(spark, out, 10)
    assert {(r["inst_id"], r["slot"]): r["value"] for r in final.slots.collect()} == {("i", 100): 111, ("j", 110): 1}
    assert {r["source"]: r["last_seen"] for r in final.reporting.filter("inst_id = 'i'").collect()} == {"a": 101, "b": 109, "z": 90}
    assert sinks.save_trigger(1) == {"processingTime": "60 seconds"} and sinks.save_trigger(300) == {"processingTime": "300 seconds"}


def test_a_batch_writes_what_it_touched_and_a_repeated_one_nothing(spark, tmp_path):
    schema = "inst_id string, source string, t bigint, slot bigint, value double"
    rows = [("i", f"s{n % 3}", 1000 + n, 1000 + n - n % 10, float(n)) for n in range(200)]
    out = str(tmp_path / "out")
    write = sinks.snapshot_writer(out, 10, parts=4, retention=100)
    for batch_id in range(6):
        mine = rows[batch_id * 30 : batch_id * 30 + 30]
        batch = spark.createDataFrame(mine, schema)
        write(batch, batch_id)
        newest = snap.parts_of(spark, out)[-1]
        if newest.part.startswith("added"):
            assert spark.read.parquet(f"{out}/parts/{newest.part}/slots").count() == 3
        before = snap.parts_of(spark, out)
        write(batch, batch_id)  # as after a restart
        assert [r.part for r in snap.parts_of(spark, out)] == [r.part for r in before] or before[-1].part.startswith("added")
    total = {r["slot"]: r["value"] for r in load(spark, out, 10).slots.collect()}
    want = {}
    for r in rows[:180]:
        want[r[3]] = want.get(r[3], 0) + r[4]
    assert total == {k: v for k, v in want.items() if k in total} and set(total) >= {k for k in want if k >= 1179 - 100}
    assert min(total) > 1000  # what was too old went with a compaction
    assert len(snap.parts_of(spark, out)) < 6


def test_a_failed_save_leaves_the_last_version(spark, tmp_path):
    schema = "inst_id string, source string, t bigint, slot bigint, value double"
    take = lambda *rows: (lambda df: capture(df, slots.interval_scope(df), 10))(spark.createDataFrame(list(rows), schema))
    path = str(tmp_path / "s")
    assert save(take(("i", "a", 5, 0, 1.0), ("i", "a", 15, 10, 2.0), ("j", "a", 5, 0, 3.0)), path) == 0
    broken = take(("i", "b", 25, 20, 9.0))
    # the slots are written, then the writer is gone
    broken.slots.write.parquet(f"{path}/parts/saved-lost/slots")
    held = lambda v=None: {(r["inst_id"], r["slot"]): r["value"] for r in load(spark, path, 10, v).slots.collect()}
    first = {("i", 0): 1.0, ("i", 10): 2.0, ("j", 0): 3.0}
    assert held() == first
    assert save(broken, path) == 1  # no slot of the replaced instrumentation stays behind
    assert held() == {("i", 20): 9.0, ("j", 0): 3.0} and held(0) == first
    assert snap.add(take(("i", "c", 26, 20, 1.0), ("k", "c", 6, 0, 4.0)), path) == 2
    whole = {("i", 20): 10.0, ("j", 0): 3.0, ("k", 0): 4.0}
    assert held() == whole
    assert snap.compact(spark, path, 10, keep=1) == 3 and held() == whole
    kept = {p.name for p in (tmp_path / "s" / "parts").iterdir()}
    assert {r.part for r in snap.parts_of(spark, path)} <= kept and len(kept) == 2  # the lost one is in no log
    with pytest.raises(snap.SnapshotError):
        load(spark, str(tmp_path / "nothing"), 10)


def test_revisions_are_summed_up(spark, tmp_path):
    updates = [[("a", 100 + 10 * (n % 3), 1.0)] for n in range(7)]
    out = str(tmp_path / "out")
    sinks.revised_table(st.tumbling(reports(spark, tmp_path, *updates), 10, 600), out, ONCE, ["slot"], parts=3).awaitTermination()
    assert {r["slot"]: r["value"] for r in sinks.latest(spark, out, ["slot"]).collect()} == {100: 3, 110: 2, 120: 2}
    assert len([p for p in (tmp_path / "out" / "data").iterdir() if p.name.startswith("batch_id")]) <= 3


def test_messages_as_a_stream(spark, tmp_path):
    """JSON messages end to end: read, cleaned, decoded, summed."""
    lines = [
        '{"inst_id":"i","source":"a","ts_ms":100500,"seq":1,"value":"{\\"x\\":1,\\"y\\":2}"}', '{"inst_id":"i","source":"b","ts_ms":100900,"seq":2,"value":"{\\"x\\":5}"}',
        '{"inst_id":"gone","source":"b","ts_ms":100900,"seq":3,"value":"{\\"x\\":5}"}', '{"inst_id":"i","source":"c","seq":4,"value":"{\\"x\\":9}"}',
        '{"source":"c","ts_ms":100000,"seq":5,"value":"{\\"x\\":9}"}',
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.json").write_text("\n".join(lines))
    active = spark.createDataFrame([("i",)], "inst_id string")
    stream = tables.clean_reports(wire.file_messages(spark, str(tmp_path / "in"), streaming=True), active)
    rows = wire.decode(st.with_event_time(stream), wire.KEYED)
    out = str(tmp_path / "out")
    sinks.revised_table(st.tumbling(rows, 1, 60), out, ONCE).awaitTermination()
    assert {(r["slot"], r["key"]): r["value"] for r in sinks.latest(spark, out, ["slot", "key"]).collect()} == {(100, "x"): 6, (100, "y"): 2}
    batch = tables.clean_reports(wire.file_messages(spark, str(tmp_path / "in")), active)
    assert merge(wire.decode(batch, wire.KEYED), ["key"]).count() == 2


def test_work_folder(spark):
    """The session's folder is used, and each run gets its own part of it."""
    one, two = new_dir(spark, "x"), new_dir(spark, "x")
    assert one != two and one.startswith(shared_dir(spark))
    setting = spark.conf.get(SETTING, None)
    assert setting is None or shared_dir(spark) == setting


def test_steps_land_from_one_table(spark, tmp_path):
    """What is streamed in several steps is worked out once, and each step holds its rows."""
    from types import SimpleNamespace

    from pyspark.sql import functions as F

    from workload import streams

    worked = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            worked.add(batch.num_rows)
            yield batch

    rows = spark.range(90).mapInArrow(count, "id long")
    stream = streams.landed(SimpleNamespace(spark=spark), rows, "steps-in", ["id"], *[F.col("id") % 3 == n for n in range(3)])
    assert stream.isStreaming and worked.value == 90
