"""Removal of long passages that occur in an earlier document, by suffix automata of reference shards.

A window of ``window`` consecutive words is repeated if an earlier document, one
with a smaller id, holds it too. Windows are told apart by their *anchor* first:
the least hash of the shingles in the window, which all its copies share. Only
windows whose anchor occurs in several documents can be repeated; of these each
distinct one is looked up for the first document that has it. The stretches of
the first documents are the references.

References are dealt into shards by anchor, as are the documents' stretches, so
that a stretch meets every reference it can match in one shard. A shard is split
into parts of a bounded number of reference words; each part goes to as many tasks
as its stretches need. There it becomes a suffix automaton, the stretches are
streamed through it for their matching statistics, and runs that reach the
window's length and occur in an earlier document are cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.sources.workdir import new_dir

from .automaton import SuffixAutomaton
from .words import BLANK_SEPARATED, column_bytes, hash_spans, shingles, slices, small_batches, spans

WINDOW, ANCHOR = 50, 8
#: Words of references in one automaton, and of stretches that a task streams through it.
SHARD_WORDS, STREAM_WORDS = 1 << 16, 1 << 20


class Texts(NamedTuple):
    """The words of a batch: raw bytes, starts and ends of words, each text's first word (one more)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Texts:
        data, offsets = column_bytes(texts)
        return cls(data, *spans(data, offsets, BLANK_SEPARATED))

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)

    def words(self, low: int, high: int) -> list[bytes]:
        return self.stretch(low, high).split() if high > low else []

    def stretch(self, low: int, high: int) -> bytes:
        return self.data[self.starts[low] : self.ends[high - 1]].tobytes()


def anchors(hashes: np.ndarray, firsts: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and each text's first window (one more)."""
    least, at = shingles(hashes, firsts, anchor, short=False)
    counts = np.maximum(np.diff(firsts) - window + 1, 0)
    windows = np.concatenate([[0], np.cumsum(counts)])
    span, width = window - anchor + 1, 1
    while width < span:
        step = min(width, span - width)
        least = np.append(np.minimum(least[:-step], least[step:]), least[-step:])
        width += step
    place = np.arange(windows[-1]) + np.repeat(at[:-1] - windows[:-1], counts)
    return least[place], windows


def described(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, key, n_words, digest, anchors) of each row; ``digest`` is that of all words joined by blanks."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts = Texts.of(batch.column("text"))
            own, windows = anchors(texts.hashes(), texts.firsts, window, anchor)
            lists = [np.unique(own[a:b]).view(np.int64) for a, b in zip(windows[:-1], windows[1:], strict=True)]
            bounds = zip(texts.firsts[:-1], texts.firsts[1:], strict=True)
            digests = [hashlib.sha256(b" ".join(texts.words(a, b))).hexdigest() for a, b in bounds]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("key"), pa.array(np.diff(texts.firsts)), pa.array(digests),
                 pa.array(lists, pa.list_(pa.int64()))],
                names=["doc_id", "key", "n_words", "digest", "anchors"],
            )

    return docs.mapInArrow(describe, f"doc_id {kind}, key long, n_words long, digest string, anchors array<long>")


def marked(hashes: np.ndarray, firsts: np.ndarray, marks: pa.ListArray, window: int, anchor: int) -> Iterator[tuple]:
    """(row, anchors, places) of the windows of each text whose anchor is in its list of ``marks``."""
    own, windows = anchors(hashes, firsts, window, anchor)
    for row, wanted in enumerate(marks):
        low, high = windows[row], windows[row + 1]
        places = np.flatnonzero(np.isin(own[low:high].view(np.int64), wanted.values.to_numpy()))
        yield row, own[low:high][places].view(np.int64), places


def windows_of(candidates: DataFrame, shards: int, window: int, anchor: int) -> DataFrame:
    """(hash, shard, doc_id, key, at): every window whose anchor is marked, with its anchor's shard.

    There are about as many rows as words, which are shuffled: the small number of
    the shard takes less room than the anchor.
    """
    kind = candidates.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", 1 << 22)):
            texts = Texts.of(batch.column("text"))
            hashes = texts.hashes()
            all_windows, first = shingles(hashes, texts.firsts, window, short=False)
            rows, found, places = zip(*marked(hashes, texts.firsts, batch.column("marks"), window, anchor), strict=True)
            row = np.repeat(rows, [len(p) for p in places])
            at = np.concatenate(places)
            own = all_windows[first[row] + at].view(np.int64)
            taken = pa.array(row)
            ids, keys = batch.column("doc_id").take(taken), batch.column("key").take(taken)
            shard = np.mod(np.concatenate(found), shards).astype(np.int32)
            columns = [pa.array(own), pa.array(shard), ids, keys, pa.array(at.astype(np.int32))]
            yield pa.record_batch(columns, names=["hash", "shard", "doc_id", "key", "at"])

    return candidates.mapInArrow(cut, f"hash long, shard int, doc_id {kind}, key long, at int")


def runs(places: np.ndarray, groups: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(group, first, last) of the runs of consecutive places of one group; places rise."""
    if not len(places):
        return
    new = np.flatnonzero((np.diff(places) != 1) | (np.diff(groups) != 0)) + 1
    begins = np.concatenate([[0], new])
    ends = np.concatenate([new, [len(places)]]) - 1
    yield from zip(groups[begins].tolist(), places[begins].tolist(), places[ends].tolist(), strict=True)


def stretches(candidates: DataFrame, shards: int, window: int, anchor: int) -> DataFrame:
    """(shard, reference, doc_id, key, at, words): what is streamed and, of first documents, what it is matched with.

    ``at`` is the number of the first word.
    """
    kind = candidates.schema["doc_id"].dataType.simpleString()
    names = ["shard", "reference", "doc_id", "key", "at", "words"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", 1 << 20)):
            texts = Texts.of(batch.column("text"))
            rows, found = [], []
            for row, own, places in marked(texts.hashes(), texts.firsts, batch.column("marks"), window, anchor):
                shard = np.mod(own, shards)
                first = batch.column("firsts")[row]
                is_first = np.isin(places, first.values.to_numpy()) if first.is_valid else np.zeros(len(places), bool)
                for reference, some in ((True, is_first), (False, slice(None))):
                    for group, low, high in runs(places[some], shard[some]):
                        begin = texts.firsts[row] + low
                        rows.append(row)
                        found.append((group, reference, low, texts.stretch(begin, begin + high - low + window)))
            shard, reference, at, words = zip(*found, strict=True) if found else ((),) * 4
            taken = pa.array(rows, pa.int64())
            ids, keys = batch.column("doc_id").take(taken), batch.column("key").take(taken)
            columns = [pa.array(shard, pa.int64()), pa.array(reference, pa.bool_()), ids, keys]
            yield pa.record_batch([*columns, pa.array(at, pa.int32()), pa.array(words, pa.binary())], names=names)

    return candidates.mapInArrow(cut, f"shard long, reference boolean, doc_id {kind}, key long, at int, words binary")


def streamed(pieces: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, first, last): words to be removed, of pieces ordered by task with references ahead."""
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, automaton, closed = None, SuffixAutomaton(), False
        for batch in batches:
            place = zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "copy")), strict=True)
            columns = (batch.column(c).to_pylist() for c in ("reference", "doc_id", "at", "words"))
            rows, out = [], []
            for row, (where, reference, doc, at, words) in enumerate(zip(place, *columns, strict=True)):
                if where != here:
                    here, automaton, closed = where, SuffixAutomaton(), False
                if reference:
                    automaton.add(words.split(), doc)
                    continue
                if not closed:
                    automaton.close()
                    closed = True
                first = last = -1
                for n, (length, least) in enumerate(automaton.matches(words.split(), window)):
                    if length == window and least < doc:
                        if n - window + 1 > last + 1 or last < 0:
                            if last >= 0:
                                rows.append(row)
                                out.append((at + first, at + last))
                            first = n - window + 1
                        last = n
                if last >= 0:
                    rows.append(row)
                    out.append((at + first, at + last))
            low, high = zip(*out, strict=True) if out else ((), ())
            taken = pa.array(rows, pa.int64())
            ids, keys = batch.column("doc_id").take(taken), batch.column("key").take(taken)
            yield pa.record_batch([ids, keys, pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["doc_id", "key", "first", "last"])

    return pieces.mapInArrow(stream, f"doc_id {kind}, key long, first long, last long")


def cut_out(candidates: DataFrame) -> DataFrame:
    """(doc_id, key, removed, kept): the maximal removed spans of words, and the other words joined by blanks."""
    kind = candidates.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts = Texts.of(batch.column("text"))
            removed, kept = [], []
            for row, found in enumerate(batch.column("found").to_pylist()):
                base = texts.firsts[row]
                merged, words, at = [], [], 0
                for low, high in sorted((f["first"], f["last"]) for f in found):
                    if merged and low <= merged[-1][1] + 1:
                        merged[-1][1] = max(merged[-1][1], high)
                    else:
                        merged.append([low, high])
                for low, high in merged:
                    words += texts.words(base + at, base + low)
                    at = high + 1
                words += texts.words(base + at, texts.firsts[row + 1])
                removed.append([{"first": a, "last": b} for a, b in merged])
                kept.append(b" ".join(words).decode())
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("key"), pa.array(removed, span), pa.array(kept, pa.string())],
                names=["doc_id", "key", "removed", "kept"],
            )

    schema = f"doc_id {kind}, key long, removed array<struct<first:long,last:long>>, kept string"
    return candidates.mapInArrow(cut, schema)


class Removal(NamedTuple):
    """``rows`` (doc_id, key, n_words, digest) has every row, ``cut`` (doc_id, key, removed, kept) the shortened texts."""

    rows: DataFrame
    cut: DataFrame

    def summary(self) -> DataFrame:
        """(doc_id, n_words, n_removed, removed, kept_sha256) of every row."""
        cut = self.cut.select(
            "doc_id",
            "key",
            "removed",
            F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1).alias("n_removed"),
            F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
        )
        return self.rows.join(cut, ["doc_id", "key"], "left").select(
            "doc_id",
            "n_words",
            F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
            F.coalesce("removed", F.array().cast("array<struct<first:long,last:long>>")).alias("removed"),
            F.coalesce("kept_sha256", "digest").alias("kept_sha256"),
        )

    def texts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The given documents with what is left of each text; texts of which nothing goes stay as they are."""
        names = [f"c{i}" for i in range(len(docs.columns))]
        renamed = docs.toDF(*names)
        own, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
        cut = self.cut.select(F.col("doc_id").alias("own"), F.col("key").alias("own_key"), "kept")
        here = (F.col(own) == F.col("own")) & (F.xxhash64(text) == F.col("own_key"))
        both = renamed.join(cut, here, "left").withColumn(text, F.coalesce("kept", text))
        return both.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def remove(
    docs: DataFrame,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_words: int = SHARD_WORDS,
    stream_words: int = STREAM_WORDS,
) -> Removal:
    """What is left of the texts without the words inside windows that start in a document with a smaller id.

    Words are what stands between blanks, unchanged. Windows are judged on the
    input. Whole texts are read and no window is left out. Anchors and windows are
    grouped by 64-bit hashes to find references; what is removed matched word by
    word.

    A null or empty text has no words; one with fewer words than a window keeps
    them all. A row without an id is left whole and is nobody's earlier document.
    Rows that share an id are no earlier documents of each other, so repeated rows
    stay alike. An empty table gives an empty one. Other columns are left out,
    whatever their names. The session is set to hand at most 1000 rows to Python
    at once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_dir(spark, "repeats")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    rows = _written(described(docs, window, anchor), f"{folder}/rows")
    own = rows.filter("doc_id is not null").select("doc_id", "key", F.explode("anchors").alias("anchor"))
    shared = own.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    shared = _written(shared.filter("low < high").select("anchor", "n"), f"{folder}/shared")
    # a window's anchor changes about every half window, so a stretch has about so many words
    usual = window * 3 // 2
    shards = max(1, -(-shared.count() * usual // shard_words))
    marks = own.join(shared, "anchor", "left_semi").groupBy("doc_id", "key").agg(F.collect_set("anchor").alias("marks"))
    candidates = _written(docs.join(marks, ["doc_id", "key"]), f"{folder}/candidates")

    found = windows_of(candidates, shards, window, anchor).groupBy("hash").agg(
        F.min(F.struct("doc_id", "key", "at")).alias("first"), F.max("doc_id").alias("last"), F.first("shard").alias("shard")
    )
    found = found.filter(F.col("first.doc_id") < F.col("last")).select("first.*", F.col("shard").cast("long").alias("shard"))
    found = _written(found, f"{folder}/firsts")
    shard = F.pmod("anchor", F.lit(shards)).alias("shard")
    parts = found.groupBy("shard").agg(F.ceil(F.count("*") * 4 / shard_words).cast("int").alias("parts"))
    copies = shared.groupBy(shard).agg(F.ceil(F.sum("n") * usual / stream_words).cast("int").alias("copies"))
    loads = _written(parts.join(copies, "shard"), f"{folder}/loads")

    firsts = found.groupBy("doc_id", "key").agg(F.collect_list("at").alias("firsts"))
    pieces = stretches(candidates.join(firsts, ["doc_id", "key"], "left"), shards, window, anchor).join(loads, "shard")
    part = F.pmod(F.xxhash64("doc_id", "key", "at"), F.col("parts")).cast("int")
    copy = F.pmod(F.xxhash64("doc_id", "key", "at"), F.col("copies")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pieces = (
        pieces.withColumn("part", F.explode(F.when(F.col("reference"), F.array(part)).otherwise(every("parts"))))
        .withColumn("copy", F.explode(F.when(F.col("reference"), every("copies")).otherwise(F.array(copy))))
        .drop("parts", "copies")
    )
    place = ["shard", "part", "copy"]
    pieces = pieces.repartition(*place).sortWithinPartitions(*place, F.desc("reference"))
    removed = streamed(pieces, window).groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "last")).alias("found"))
    cut = _written(cut_out(candidates.dropDuplicates(["doc_id", "key"]).join(removed, ["doc_id", "key"])), f"{folder}/cut")
    return Removal(rows.drop("anchors"), cut)


def _written(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
