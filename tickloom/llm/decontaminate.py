"""Benchmark decontamination: a prefix-filtered join of item-sized windows with the documents' shingles.

A window of a benchmark item is contained in a document only if every shingle
of the window is. So one shingle of each window is enough to find candidates:
the rarest one, counted over all documents. It is looked for in the documents,
bounds on position and length follow from where it stands in its window, and
what is left is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.workdir import new_dir

from .words import ALPHANUMERIC, LOWER, SLICE, column_bytes, hash_spans, shingles, slices, small_batches, spans

WINDOW, SHINGLE = 13, 5
#: Places of the filter that is sent to all tasks: a fixed size, whatever the benchmark's.
PLACES = 1 << 23


def _words(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = column_bytes(batch.column(column))
    small = LOWER[data]
    return small, *spans(small, offsets, ALPHANUMERIC)


def windows_of(items: DataFrame, window: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words, shingles): all windows of all items; the k-th shingle starts at the k-th word.

    An item with fewer words than a window is one window, a window with fewer
    words than a shingle is one shingle.
    """
    kind = items.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small, starts, ends, firsts = _words(batch, "text")
            hashes = hash_spans(small, starts, ends)
            by_size = {k: shingles(hashes, firsts, k, short=False) for k in range(1, shingle + 1)}
            ids, words, found = [], [], []
            for i, item in enumerate(batch.column("id").to_pylist()):
                low, high = firsts[i], firsts[i + 1]
                own = [bytes(small[s:e]).decode() for s, e in zip(starts[low:high], ends[low:high], strict=True)]
                own_hashes, hashed = by_size[min(max(len(own), 1), shingle)]
                for k in range(max(1, len(own) - window + 1) if own else 0):
                    ids.append(item)
                    words.append(own[k : k + window])
                    n = max(1, len(words[-1]) - shingle + 1)
                    found.append(own_hashes[hashed[i] + k : hashed[i] + k + n].view(np.int64).tolist())
            columns = [pa.array(ids, batch.column("id").type), pa.array(words, pa.list_(pa.string()))]
            yield pa.record_batch(
                [*columns, pa.array(found, pa.list_(pa.int64()))], names=["item_id", "words", "shingles"]
            )

    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"item_id {kind}, words array<string>, shingles array<long>")


def bitmap(hashes: DataFrame, column: str, places: int = PLACES) -> np.ndarray:
    """A filter of ``places`` bits; at most so many numbers come to the driver."""
    taken = hashes.select(F.pmod(column, F.lit(places)).cast("int").alias("place")).distinct().toArrow()
    bits = np.zeros(places, bool)
    bits[taken.column("place").to_numpy()] = True
    return np.packbits(bits)


def found_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes fall on a place that is taken; ``pmod`` of signed numbers as on the JVM."""
    place = np.mod(hashes.view(np.int64), np.int64(len(bits) * 8))
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def _all_shingles(
    hashes: np.ndarray, firsts: np.ndarray, sizes: list[int], bits: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of the shingles of the given sizes that pass the filter, by text."""
    found = []
    for k in sizes:
        own, hashed = shingles(hashes, firsts, k, short=False)
        where = np.flatnonzero(found_in(bits, own))
        text = np.searchsorted(hashed, where, "right") - 1
        found.append((own[where], text, where - hashed[text]))
    out = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.argsort(out[1], kind="stable")
    return out[0][order], out[1][order], out[2][order]


def shingle_counts(docs: DataFrame, bits: np.ndarray, sizes: list[int], text_col: str, most: int = SLICE) -> DataFrame:
    """(hash, n) over all documents, for the shingles that pass the filter; summed within tasks first."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", most)):
            small, starts, ends, firsts = _words(batch, "text")
            found, _, _ = _all_shingles(hash_spans(small, starts, ends), firsts, sizes, shared.value)
            own, n = np.unique(found, return_counts=True)
            yield pa.record_batch([pa.array(own.view(np.int64)), pa.array(n)], names=["hash", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "hash long, n long")
    return found.groupBy("hash").agg(F.sum("n").alias("n"))


def hits(
    docs: DataFrame, bits: np.ndarray, sizes: list[int], window: int, id_col: str, text_col: str, most: int = SLICE
) -> DataFrame:
    """(doc_id, n_words, hits) of each row; a hit is a shingle that passes the filter, with the words around it.

    ``at`` is the number of its first word, ``first`` that of the first word in ``around``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    kind = docs.schema[id_col].dataType.simpleString()
    struct = pa.struct(
        [("hash", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("around", pa.list_(pa.string()))]
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", most)):
            small, starts, ends, firsts = _words(batch, "text")
            found, doc, at = _all_shingles(hash_spans(small, starts, ends), firsts, sizes, shared.value)
            counts = np.diff(firsts)
            low, high = np.maximum(at - window, 0), np.minimum(at + window, counts[doc])
            around = [
                [bytes(small[s:e]).decode() for s, e in zip(starts[b + lo : b + hi], ends[b + lo : b + hi], strict=True)]
                for b, lo, hi in zip(firsts[doc], low, high, strict=True)
            ]
            columns = [found.view(np.int64), at, low, pa.array(around, pa.list_(pa.string()))]
            rows = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(struct))
            offsets = np.searchsorted(doc, np.arange(len(firsts))).astype(np.int32)
            yield pa.record_batch(
                [batch.column("id"), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), rows)],
                names=["doc_id", "n_words", "hits"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, n_words long, hits array<struct<hash:long,at:long,first:long,around:array<string>>>"
    return rows.mapInArrow(look, schema)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    share: int = 20,
    most: int = SLICE,
) -> DataFrame:
    """One row per document row: its words, the words inside benchmark windows, the items, and the verdict.

    ``contaminated`` if at least one word in ``share`` is inside a window. Whole
    texts are read. A null or empty text has no words and is clean; a null or
    empty item has no windows; items with a null id count as one item without a
    name (it marks words but isn't listed); repeated rows each get their result;
    equal windows of several items are looked for once. Other columns are left
    out, whatever their names. Without items all documents are clean. About
    ``most`` bytes of text are worked on at once.
    """
    cut = windows_of(items, window, shingle, item_id, item_text)
    small_batches(docs.sparkSession)
    folder = new_dir(docs.sparkSession, "decontaminate")
    longest = F.least(F.size("words"), F.lit(shingle)).alias("size")
    sizes = sorted(r["size"] for r in cut.select(longest).distinct().collect()) or [shingle]
    bits = bitmap(cut.select(F.explode("shingles").alias("hash")), "hash")
    counts = shingle_counts(docs, bits, sizes, text_col, most)
    # each distinct window by its rarest shingle; of equally rare ones the first
    distinct = cut.groupBy("words").agg(F.first("shingles").alias("shingles"))
    places = distinct.select("words", F.posexplode("shingles").alias("offset", "hash"))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "hash")
    prefixes = (
        places.join(counts, "hash", "left")
        .groupBy("words")
        .agg(F.min(rarity).alias("rarest"))
        .filter("rarest.n > 0")
        .select("words", F.col("rarest.offset").alias("offset"), F.col("rarest.hash").alias("hash"))
    )
    prefixes = _written(prefixes, f"{folder}/prefixes")
    found = hits(docs, bitmap(prefixes, "hash"), sizes, window, id_col, text_col, most)
    # written with a number for each row, so that the texts are read once and the numbers can't change
    found = _written(found.withColumn("row", F.monotonically_increasing_id()), f"{folder}/hits")
    candidates = found.select("row", F.explode("hits").alias("hit")).select("row", "hit.*").join(prefixes, "hash")
    start, size = F.col("at") - F.col("offset"), F.size("words")
    inside = (start >= F.col("first")) & (start - F.col("first") + size <= F.size("around"))
    same = F.slice("around", (start - F.col("first") + 1).cast("int"), size) == F.col("words")
    matches = candidates.filter(inside).filter(same).select("row", start.alias("start"), size.alias("size"), "words")
    return _report(found.select("row", "doc_id", "n_words"), matches, cut, share)


def _written(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _report(rows: DataFrame, matches: DataFrame, cut: DataFrame, share: int) -> DataFrame:
    ordered = Window.partitionBy("row").orderBy("start", "size")
    reached = F.max(F.col("start") + F.col("size")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("size")
    covered = matches.select("row", "start", "size").distinct().withColumn("reached", F.coalesce(reached, F.lit(0)))
    words = covered.groupBy("row").agg(
        F.sum(F.greatest(end - F.greatest("start", "reached"), F.lit(0))).alias("n_hit")
    )
    named = cut.select("words", F.col("item_id").cast("string").alias("item")).filter("item is not null").distinct()
    items = (
        matches.select("row", "words").distinct().join(named, "words").groupBy("row")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(words, "row", "left").join(items, "row", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )
