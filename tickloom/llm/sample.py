"""Bounded samples of labelled documents, and models fitted on them in one task."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % n


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learnable: Column, rows: int, most_bytes: int
) -> DataFrame:
    """``text``, ``label`` and ``weight`` of at most ``rows`` documents.

    Half of the places are for either label, filled by a hash of the id. The
    weight gives each label its share among all labelled rows back. ``learnable``
    decides on ``doc_id`` which labels may be seen; null ids and labels are left
    out, of labels that contradict each other the larger counts, and texts beyond
    ``most_bytes`` are not fitted on. The chosen ids are bounded by ``rows`` and
    so may be broadcast.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learnable)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    counted = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.filter(F.col("label") == y).orderBy(*order).limit(rows // 2) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    weights = F.lit(1.0)
    for y, n in counted.items():
        weights = F.when(F.col("label") == y, n / min(n, rows // 2)).otherwise(weights)
    texts = docs.select("doc_id", "text").filter(F.octet_length(F.coalesce("text", F.lit(""))) <= most_bytes)
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label", weights.alias("weight"))


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in found.files}


def fit_in_one_task(
    sample: DataFrame,
    features: Callable[[pa.RecordBatch], dict[str, np.ndarray]],
    fit: Callable[[list[dict[str, np.ndarray]]], dict[str, np.ndarray]],
) -> dict[str, np.ndarray]:
    """Features where the sample lies, the fit in one task (the sample is bounded), the model to the driver."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = b.column("doc_id")
                yield pa.record_batch([ids[:1], pa.array([pack(features(b))], pa.binary())], names=["first", "part"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(x) for b in batches for x in b.column("part").to_pylist()]
        yield pa.record_batch([pa.array([pack(fit(parts))], pa.binary())], names=["model"])

    parts = sample.mapInArrow(described, "first long, part binary")
    model = parts.repartition(1).sortWithinPartitions("first").mapInArrow(fitted, "model binary").first()
    return unpack(model["model"]) if model else fit([])  # an empty sample may have no task at all


def sum_by(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of the runs that start at ``firsts`` (n + 1 numbers; runs may be empty)."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[firsts[1:]] - total[firsts[:-1]]


def run_firsts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Adam:
    """Steps for a dictionary of arrays, changed in place."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.step = weights, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def apply(self, gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in gradients.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.01 * (g * g - self.square[k])
            mean = self.mean[k] / (1 - 0.9**self.step)
            square = self.square[k] / (1 - 0.99**self.step)
            self.weights[k] -= self.rate * mean / (np.sqrt(square) + 1e-8)
