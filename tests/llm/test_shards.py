from __future__ import annotations

import zlib

import pytest

from tickloom.llm.shards import shard_by_bytes

SCHEMA = "doc_id long, text string, size int, shard string"


def brute_force(rows, shards):
    sized = []
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        sized.append((doc_id is not None, doc_id or 0, len(data) + 8, zlib.crc32(data), doc_id))
    sized.sort(key=lambda r: r[:4])
    total, before, out, slots = sum(r[2] for r in sized), 0, [], {}
    for _, _, size, crc, doc_id in sized:
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        slots[shard] = slots.get(shard, -1) + 1
        out.append((doc_id, size, crc, "bytes", shard, slots[shard], None))
        before += size
    return out


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None, 0, "x")],
        [(None, "a", 1, "y"), (None, "a", 1, "y"), (3, "", 0, None), (2, "é" * 500, 9, "z"), (2, "é" * 500, 9, "z")],
        [(i, "w" * (i * 37 % 101), i, "s") for i in range(300)],
    ],
)
def test_as_one_running_sum(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = [tuple(r) for r in shard_by_bytes(df, 7).collect()]
    assert sorted(found, key=repr) == sorted(brute_force(rows, 7), key=repr)
