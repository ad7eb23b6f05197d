"""Ranked lexical search of a set of items by presence masks.

The terms of the items are looked for in all documents at once. Then each task
takes its documents in segments. For an item, the segment's postings become
bitmaps, a bit for each of the item's terms, and documents with equal bitmaps
form a group. No document scores more than the terms of its mask do at their best
in the segment, so groups are evaluated by descending bound until the next one's
can't reach the item's worst place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.workdir import new_dir

from .words import ALPHANUMERIC, slices, small_batches, word_hashes

#: Items are asked in blocks of about so many terms, which bounds what is broadcast.
BLOCK_TERMS = 1 << 20
#: A segment's masks take at most so many words of 64 bits.
SEGMENT_MASKS = 1 << 20
#: The best of a task are merged in so many parts of an item first.
PARTS = 64


def terms_of(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term): the distinct terms, as hashes, of each item with an id."""
    kind = items.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            hashes, firsts = word_hashes(batch.column("text"), ALPHANUMERIC)
            ids = batch.column("item_id").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(firsts))))
            yield pa.record_batch([ids, pa.array(hashes.view(np.int64))], names=["item_id", "term"])

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).filter("item_id is not null")
    return rows.mapInArrow(cut, f"item_id {kind}, term long").distinct()


def matches(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of each row with a term: its length and its terms in ``vocabulary``, a rising array."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in (part for whole in batches for part in slices(whole, "text")):
            hashes, firsts = word_hashes(batch.column("text"), ALPHANUMERIC)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(firsts))
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            there = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
            found, tfs = np.unique(doc[there] * len(known) + at[there], return_counts=True)
            owner, term = np.divmod(found, max(len(known), 1))
            offsets = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tfs)]
            out = [batch.column("doc_id"), pa.array(np.diff(firsts)), *lists]
            yield pa.record_batch(out, names=["doc_id", "n", "terms", "tfs"]).filter(pa.array(np.diff(firsts) > 0))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(look, "doc_id long, n long, terms array<int>, tfs array<int>")


@dataclass
class Asked:
    """The items of a block: each one's terms (places in the vocabulary) and their weights, those above 0."""

    terms: list[np.ndarray]
    weights: list[np.ndarray]
    documents: int
    length: int

    def middles(self, n: np.ndarray) -> np.ndarray:
        """m of documents of ``n`` terms."""
        if len(n) and int(n.max()) * 50 * self.documents >= 1 << 62:
            return np.array([50 + 50 * int(x) * self.documents // self.length for x in n], np.int64)
        return 50 + 50 * n * self.documents // self.length


class Segment:
    """Documents of a task with the impact of each of their terms, by document and by term."""

    def __init__(self, n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray, asked: Asked):
        self.offsets, self.terms = offsets, terms
        doc = np.repeat(np.arange(len(n)), np.diff(offsets))
        tfs = tfs.astype(np.int64)
        self.impacts = 1_000_000_000 * tfs // (1000 * tfs + 20 * asked.middles(n)[doc])
        order = np.argsort(terms, kind="stable")
        self.holders = doc[order]
        self.present, starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(starts, len(terms))
        self.best = np.maximum.reduceat(self.impacts[order], starts) if len(starts) else np.zeros(0, np.int64)

    def masks(self, places: np.ndarray) -> np.ndarray:
        """For each document the bits of the terms, given by their places among those present, that it holds."""
        out = np.zeros((len(self.offsets) - 1, -(-len(places) // 64)), np.uint64)
        for bit, place in enumerate(places):
            out[self.holders[self.ends[place] : self.ends[place + 1]], bit >> 6] |= np.uint64(1 << (bit & 63))
        return out

    def scores(self, docs: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
        """The exact scores of documents that hold some term."""
        sizes = np.diff(self.offsets)[docs]
        begins = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) - np.repeat(begins - self.offsets[docs], sizes)
        return np.add.reduceat(weight_of[self.terms[at]] * self.impacts[at], begins)


def grouped(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct masks, the rows ordered by mask, and where each mask's rows begin (one more)."""
    order = np.lexsort(masks.T)
    rows = masks[order]
    new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
    begins = np.flatnonzero(new)
    return rows[begins], order, np.append(begins, len(rows))


class Ranking:
    """The best places of each item so far; places that are still free have score 0."""

    def __init__(self, asked: Asked, vocabulary: int, k: int):
        self.asked, self.k = asked, k
        self.scores = np.zeros((len(asked.terms), k), np.int64)
        self.ids = np.full((len(asked.terms), k), np.iinfo(np.int64).max)
        self.weight_of = np.zeros(vocabulary, np.int64)
        self.evaluated = self.left_out = 0

    def add(self, segment: Segment, ids: np.ndarray) -> None:
        for item, (terms, weights) in enumerate(zip(self.asked.terms, self.asked.weights, strict=True)):
            at = np.minimum(np.searchsorted(segment.present, terms), max(len(segment.present) - 1, 0))
            there = segment.present[at] == terms if len(segment.present) else np.zeros(len(terms), bool)
            most = weights[there] * segment.best[at[there]]
            if not there.any() or most.sum() < max(self.scores[item, -1], 1):
                continue
            self.weight_of[terms] = weights
            self.search(item, segment, ids, at[there], most)
            self.weight_of[terms] = 0

    def search(self, item: int, segment: Segment, ids: np.ndarray, places: np.ndarray, most: np.ndarray) -> None:
        masks = segment.masks(places)
        holders = np.flatnonzero(masks.any(axis=1))
        distinct, order, begins = grouped(masks[holders])
        bits = np.unpackbits(distinct.view(np.uint8), axis=1, bitorder="little")[:, : len(most)]
        bounds = (bits.astype(np.float64) @ most.astype(np.float64)) * (1 + 1e-9) + 1
        by_bound = np.argsort(-bounds, kind="stable")
        docs = holders[order]
        at = 0
        while at < len(by_bound):
            if bounds[by_bound[at]] < max(self.scores[item, -1], 1):
                self.left_out += len(by_bound) - at
                break
            upto, taken = at, 0
            while upto < len(by_bound) and taken < 4 * self.k:
                taken += begins[by_bound[upto] + 1] - begins[by_bound[upto]]
                upto += 1
            own = np.concatenate([docs[begins[g] : begins[g + 1]] for g in by_bound[at:upto]])
            self.evaluated += len(own)
            self.keep(item, segment.scores(own, self.weight_of), ids[own])
            at = upto

    def keep(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = scores >= max(self.scores[item, -1], 1)
        scores = np.concatenate([self.scores[item], scores[fit]])
        ids = np.concatenate([self.ids[item], ids[fit]])
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores[item], self.ids[item] = scores[best], ids[best]


def best_of_tasks(found: DataFrame, asked: Asked, item_ids: pa.Array, vocabulary: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): each task's best ``k`` of each item among its rows of ``found``."""
    shared = found.sparkSession.sparkContext.broadcast((asked, item_ids))
    kind = {"int64": "long", "int32": "int", "string": "string", "large_string": "string"}.get(str(item_ids.type), "string")
    wide = max([1, *(-(-len(t) // 64) for t in asked.terms)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = shared.value
        ranking = Ranking(own, vocabulary, k)
        for whole in batches:
            for low in range(0, whole.num_rows, max(SEGMENT_MASKS // wide, 1)):
                batch = whole.slice(low, max(SEGMENT_MASKS // wide, 1))
                batch = batch.filter(pc.is_valid(batch.column("doc_id")))
                if not batch.num_rows:
                    continue
                terms, tfs = batch.column("terms"), batch.column("tfs")
                offsets = terms.offsets.to_numpy().astype(np.int64)
                n = batch.column("n").to_numpy()
                flat = [x.flatten().to_numpy() for x in (terms, tfs)]
                ranking.add(Segment(n, offsets - offsets[0], *flat, own), batch.column("doc_id").to_numpy())
        item, place = np.nonzero(ranking.scores)
        columns = [names.take(pa.array(item)), pa.array(ranking.ids[item, place]), pa.array(ranking.scores[item, place])]
        yield pa.record_batch(columns, names=["item_id", "doc_id", "score"])

    return found.mapInArrow(search, f"item_id {kind}, doc_id long, score long")


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest scores above 0, ties to the smaller ``doc_id``.

    Terms are runs of ASCII letters and digits and of all characters beyond
    ASCII, capital A-Z made small, and are told apart by 64-bit hashes. A term's
    weight is ``floor(1000 ln((2 N + 2) / (2 df + 1)))``, its part of a document's
    score ``w * (10^9 tf div (1000 tf + 20 m))`` with ``m = 50 + (50 n N) div L``.
    Whole texts are read; statistics cover all documents.

    A null or empty text has no terms and doesn't count as a document. A row
    without an id counts in the statistics and is not ranked. Repeated rows each
    take a place. Items without an id are left out; rows that share an item's id
    are one item with all their terms; an item without terms, or whose terms occur
    nowhere, gives no rows. Ids of documents are integers, those of items integers
    or strings. Items are asked in blocks of about ``block_terms`` terms, each with
    a pass over the documents. Other columns are left out, whatever their names.
    The session is set to hand at most 1000 rows to Python at once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_dir(spark, "lexical")
    asked_terms = _written(terms_of(items, item_id, item_text), f"{folder}/terms")
    blocks = max(1, -(-asked_terms.count() // block_terms))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    best = None
    for number in range(blocks):
        table = asked_terms.filter(block == number).toArrow().combine_chunks()
        found = _block(docs, table, k, id_col, text_col, f"{folder}/{number}")
        best = found if best is None else best.unionByName(found)
    order = [F.desc("score"), F.asc("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part")
    first = F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))
    best = best.select("*", part).withColumn("rank", first).filter(F.col("rank") <= k).drop("part", "rank")
    last = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return best.withColumn("rank", last).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, table: pa.Table, k: int, id_col: str, text_col: str, folder: str) -> DataFrame:
    encoded = pa.array([], table.schema.field("item_id").type).dictionary_encode()
    if table.num_rows:
        encoded = table.column("item_id").combine_chunks().dictionary_encode()
    owner, terms = encoded.indices.to_numpy(), table.column("term").to_numpy().view(np.uint64)
    vocabulary = np.unique(terms)
    found = _written(matches(docs, vocabulary, id_col, text_col), f"{folder}/matches")
    counts = found.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[held.column("term").to_numpy()] = held.column("df").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * counts.documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    place = np.searchsorted(vocabulary, terms)
    useful = (df[place] > 0) & (weight[place] > 0)
    owner, place = owner[useful], place[useful]
    order = np.lexsort((place, owner))
    cuts = np.searchsorted(owner[order], np.arange(1, len(encoded.dictionary)))
    own_terms = np.split(place[order], cuts)
    asked = Asked(own_terms, [weight[t] for t in own_terms], counts.documents, counts.length or 1)
    return best_of_tasks(found, asked, encoded.dictionary, len(vocabulary), k)


def _written(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
