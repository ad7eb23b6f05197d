"""Lloyd's centroid clustering with the dimensions dealt over tasks.

Vectors are kept in groups of rows, and each group is cut into column blocks. A
round has two steps. Tasks of column blocks compute the exact squared distances
of their rows to their slice of every centroid; the blocks of a group are added
up by a shuffle on the group, and each row takes the least. Then tasks of column
blocks add up their rows by cluster, and each block's slice of the centroids is
replaced by the floored means.

All numbers are whole and exact. Their width follows from the largest component:
2, 4 or 8 bytes, or integers of any size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.sources.workdir import new_dir

BLOCKS, GROUP = 4, 4096
#: Whole numbers of any size go through Spark's sums in parts of so many decimal digits.
PART = 10**18
LARGEST_LONG = (1 << 63) - 1


def width(largest: int) -> str:
    """How numbers of up to ``largest`` either way are stored."""
    return next((kind for kind, bits in (("i2", 15), ("i4", 31), ("i8", 63)) if largest < 1 << bits), "any")


def pack(numbers: np.ndarray, kind: str) -> bytes:
    return b" ".join(b"%d" % n for n in numbers.ravel()) if kind == "any" else numbers.astype(kind).tobytes()


def unpack(packed: bytes, kind: str, columns: int) -> np.ndarray:
    """A matrix in which sums of squares can't overflow."""
    if kind == "any":
        return np.array([int(n) for n in packed.split()], object).reshape(-1, columns)
    return np.frombuffer(packed, kind).astype(np.int64).reshape(-1, columns)


def cuts(size: int, blocks: int) -> list[int]:
    return [size * b // blocks for b in range(blocks + 1)]


def partial_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to each centroid over these columns."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def usable(vectors: DataFrame, size: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): the vectors of ``size`` finite components, times ``scale``."""
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(F.col(vector_col), lambda c: c.cast("double") * scale)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(F.size(vector_col) == size, scaled).alias("x"))
    return rows.filter(F.col("x").isNotNull() & finite)


def dealt(kept: DataFrame, size: int, blocks: int, group: int, kind: str) -> DataFrame:
    """(group, block, ids, slice): groups of rows by column blocks; ids are with the first block."""
    id_kind = kept.schema["vec_id"].dataType.simpleString()
    edges = cuts(size, blocks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for low in range(0, whole.num_rows, group):
                batch = whole.slice(low, group)
                x = np.floor(batch.column("x").flatten().to_numpy().reshape(batch.num_rows, size))
                if kind == "any":
                    x = np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
                slices = [pack(x[:, a:b], kind) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows] + [batch.num_rows] * (blocks - 1), pa.int32()), batch.column("vec_id"))
                yield pa.record_batch(
                    [pa.array([number] * blocks), pa.array(range(blocks), pa.int32()), ids, pa.array(slices, pa.binary())],
                    names=["group", "block", "ids", "slice"],
                )
                number += 1

    return kept.mapInArrow(deal, f"group long, block int, ids array<{id_kind}>, slice binary")


def assigned(table: DataFrame, centroids: np.ndarray, blocks: int, kind: str, far: str) -> DataFrame:
    """(group, clusters, distances): each row's nearest centroid, the first of equally near ones, packed."""
    k, size = centroids.shape
    edges = cuts(size, blocks)
    shared = table.sparkSession.sparkContext.broadcast(centroids)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 1) for whole in batches for i in range(whole.num_rows)):
            a, b = (edges[batch.column("block")[0].as_py() + i] for i in (0, 1))
            x = unpack(batch.column("slice")[0].as_py(), kind, b - a)
            part = pack(partial_distances(x, shared.value[:, a:b]), far)
            yield pa.record_batch([batch.column("group"), pa.array([part], pa.binary())], names=["group", "part"])

    def add(parts: pa.Table) -> pa.Table:
        total = sum(unpack(p, far, k) for p in parts.column("part").to_pylist())
        nearest = total.argmin(axis=1)
        own = total[np.arange(len(total)), nearest]
        columns = [parts.column("group").slice(0, 1), [pack(nearest, "i4")], [pack(own, far)]]
        return pa.table([pa.array(c) if isinstance(c, list) else c for c in columns], names=["group", "clusters", "distances"])

    parts = table.select("group", "block", "slice").mapInArrow(measure, "group long, part binary")
    return parts.groupBy("group").applyInArrow(add, "group long, clusters binary, distances binary")


def moved(table: DataFrame, nearest: DataFrame, centroids: np.ndarray, blocks: int, kind: str) -> np.ndarray:
    """The floored means of the clusters' rows; a cluster without rows stays where it is."""
    k, size = centroids.shape
    edges = cuts(size, blocks)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.full((k, size), 0, object), np.zeros((k, blocks), np.int64)
        for batch in batches:
            for block, packed, own in zip(*(batch.column(c).to_pylist() for c in ("block", "slice", "clusters")), strict=True):
                a, b = edges[block], edges[block + 1]
                x, cluster = unpack(packed, kind, b - a), np.frombuffer(own, "i4")
                for c in np.unique(cluster):
                    rows = x[cluster == c]
                    totals[c, a:b] += rows.sum(axis=0).astype(object)
                    counts[c, block] += len(rows)
        out = []
        for c, block in zip(*np.nonzero(counts), strict=True):
            for d in range(edges[block], edges[block + 1]):
                n, sign = abs(totals[c, d]), 1 if totals[c, d] >= 0 else -1
                part = 0
                while n or not part:
                    out.append((c, d, part, sign * (n % PART), counts[c, block]))
                    n, part = n // PART, part + 1
        columns = [pa.array(list(x), pa.int64()) for x in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 5
        yield pa.record_batch(columns, names=["cluster", "place", "part", "total", "n"])

    both = table.select("group", "block", "slice").join(nearest.select("group", "clusters"), "group")
    sums = both.mapInArrow(add_up, "cluster long, place long, part long, total long, n long")
    sums = sums.groupBy("cluster", "place", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    totals, counts = np.full((k, size), 0, object), np.zeros((k, size), object)
    for r in sums.collect():  # clusters x dimensions, whatever the number of vectors
        totals[r.cluster, r.place] += int(r.total) * PART**r.part
        counts[r.cluster, r.place] = max(counts[r.cluster, r.place], r.n)
    there = counts[:, 0] > 0
    out = centroids.copy()
    out[there] = totals[there] // counts[there]
    return out


def cluster(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    size: int = 64,
    scale: float = 64.0,
    seed: str = "1",
    blocks: int = BLOCKS,
    group: int = GROUP,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per kept vector: ``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Kept are vectors of exactly ``size`` components, none null or non-finite
    (also after multiplying); they become ``floor(scale * component)``. The first
    centroids are the ``k`` vectors whose id has the smallest sha256 of
    ``seed:id``, in that order; with fewer vectors there are as many centroids.
    Each of the ``rounds`` assigns every vector to the nearest centroid by squared
    Euclidean distance (ties: the smaller number) and moves every centroid with
    vectors to their floored mean; at last vectors are assigned once more.

    Repeated rows and rows that share an id each take part. A row without an id
    takes part, but is no first centroid. Distances and sums of 2^63 or more are
    returned as 2^63 - 1; all else is computed exactly. An empty table, or one
    without a usable vector, gives no rows. Other columns are left out, whatever
    their names.
    """
    spark = vectors.sparkSession
    folder = new_dir(spark, "lloyd")
    kept = usable(vectors, size, scale, id_col, vector_col)
    most = kept.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()[0]
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.filter("vec_id is not null").orderBy(by_hash, "vec_id", "x").limit(k).collect()
    id_kind = kept.schema["vec_id"].dataType.simpleString()
    result = f"vec_id {id_kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], result)
    largest = math.floor(most) + 1
    kind, far = width(largest), width(size * (2 * largest + 1) ** 2)
    wide = far == "any"
    centroids = np.array([[math.floor(c) for c in r.x] for r in first], object)
    table = _written(dealt(kept, size, blocks, group, kind), f"{folder}/dealt")
    typed = lambda c: c if wide else c.astype(np.int64)
    for _ in range(rounds):
        nearest = assigned(table, typed(centroids), blocks, kind, far)
        centroids = moved(table, nearest, centroids, blocks, kind)

    nearest = assigned(table, typed(centroids), blocks, kind, far)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clusters = [np.frombuffer(c, "i4") for c in batch.column("clusters").to_pylist()]
            lists = [pa.array(clusters, pa.list_(pa.int32()))]
            own = [unpack(d, far, 1).ravel() for d in batch.column("distances").to_pylist()]
            lists.append(pa.array([[min(int(n), LARGEST_LONG) for n in d] for d in own], pa.list_(pa.int64())))
            yield pa.record_batch([batch.column("group"), *lists], names=["group", "cluster", "distance"])

    rows = nearest.mapInArrow(opened, "group long, cluster array<int>, distance array<long>")
    rows = rows.join(table.filter("block = 0").select("group", F.col("ids").alias("vec_id")), "group")
    rows = rows.select(F.explode(F.arrays_zip("vec_id", "cluster", "distance")).alias("row")).select("row.*")
    rows = _written(rows, f"{folder}/rows")
    inertia = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()
    own = {r.cluster: int(r.n) for r in inertia}
    total = min(sum(own.values()), LARGEST_LONG)
    facts = [
        (c, min(own.get(c, 0), LARGEST_LONG), total, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
        for c, row in enumerate(centroids)
    ]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select(*[part.split()[0] for part in result.split(", ")])


def _written(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
