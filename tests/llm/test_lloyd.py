from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from tickloom.llm import lloyd

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def brute_force(rows, k, rounds, size):
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [math.floor(64 * float(np.float32(c))) for c in v]))
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), i, x) for i, x in kept if i is not None)[:k]
    centroids = [x for _, _, x in seeds]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for c in range(len(centroids)):
            members = [x for (_, x), n in zip(kept, own, strict=True) if n == c]
            if members:
                centroids[c] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    found = [(i, *nearest(x)) for i, x in kept] if centroids else []
    inertia = {}
    for _, d, c in found:
        inertia[c] = inertia.get(c, 0) + d
    most = 2**63 - 1
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    return sorted(
        ((i, c, min(d, most), min(inertia[c], most), min(sum(inertia.values()), most), digest[c]) for i, d, c in found), key=key
    )


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def vectors():
    random.seed(12)
    rows = [(i, [random.gauss(i % 5, 1) for _ in range(8)], "x") for i in range(300)]
    rows += [(300 + i, rows[7][1], "x") for i in range(150)]
    rows += [(600, None, ""), (601, [1.0, None] * 4, ""), (602, [math.nan] * 8, ""), (603, [math.inf] * 8, ""), (604, [1.0] * 7, "")]
    return rows + [(None, rows[0][1], ""), rows[3], rows[3], (3, rows[9][1], "")]


@pytest.mark.parametrize(("k", "blocks", "group"), [(6, 3, 4096), (4, 8, 16), (2, 1, 100)])
def test_as_one_by_one(spark, k, blocks, group):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = lloyd.cluster(df, k=k, rounds=3, size=8, blocks=blocks, group=group)
    assert got(found) == brute_force(rows, k, 3, 8)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [1.0, 2.0], "") for i in range(9)] + [(9, [3.0, 2.0], "")]
    found = lloyd.cluster(spark.createDataFrame(rows, SCHEMA), k=5, size=2, blocks=2)
    assert got(found) == brute_force(rows, 5, 3, 2)


def test_large_components(spark):
    rows = [(i, [random.choice([1e9, 1e30, -1e25, 0.5]) for _ in range(4)], "") for i in range(40)]
    found = lloyd.cluster(spark.createDataFrame(rows, SCHEMA), k=3, size=4)
    assert got(found) == brute_force(rows, 3, 3, 4)
    rows = [(i, [random.gauss(0, 1e6) for _ in range(4)], "") for i in range(40)]
    found = lloyd.cluster(spark.createDataFrame(rows, SCHEMA), k=3, size=4)
    assert got(found) == brute_force(rows, 3, 3, 4)


def test_few_and_none(spark):
    df = spark.createDataFrame(vectors(), SCHEMA)
    few = [r for r in vectors() if r[0] in (5, 6)]
    assert got(lloyd.cluster(spark.createDataFrame(few, SCHEMA), size=8)) == brute_force(few, 16, 3, 8)
    assert lloyd.cluster(df.filter("false"), size=8).collect() == []
    assert lloyd.cluster(df).collect() == []
