"""Similarity self-join on word shingles by T-occurrence search.

A document of n shingles has a partner of Jaccard 3/4 or more only among those
that occur on at least T of its n inverted lists. The lists are divided as
DivideSkip does: T - 1 of them, the longest, may be left unmerged, so that a
partner must occur on one of the n - T + 1 short lists. Only short lists are
built (all lists of all documents would be many times the size of the input),
their merge is a shuffle on the shingle, and what comes out is a set of
candidates; those that meet on too few short lists go, and the others' sets are
searched in blocks: the block's short lists are merged and counted, its long ones
are probed by binary search.

:func:`components` needs links up to their transitive closure only. So the members
of a list are first compared with one of them, the hub: the one that has the fewest
rarer shingles, so of a group of near copies the one closest to what they share.
Lists whose members then are in one component are done. The pairs of members of
different components of the other lists are all compared within bounds on lengths
and positions.

:func:`join` finds all links between different sets. They lie within components,
so each component's sets are dealt into blocks, and pairs of blocks are searched:
the inverted lists of one block are made once and searched by DivideSkip with the
sets of the other. What leaves a task are numbers of links, a row per set and pair
of blocks and not one per link; :meth:`Join.pairs` gives the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from tickloom.sources.workdir import new_dir

from .components import components as connected
from .words import BLANK_SEPARATED, append_columns, mix, shingles, slices, small_batches, word_hashes

SHINGLE = 5
#: Jaccard 3/4, i.e. overlap o of sets of a and b with 4 o >= 3 (a + b - o).
NEED_OVERLAP, NEED_SIZES = 7, 3
#: Lists counted with this length or more are ordered by it, the longest so many of them at most:
#: a passage of some documents otherwise comes first in many of them, and all their pairs meet on it.
LEAST_LONG, MOST_LONG = 2, 1 << 20
#: A round of hubs that leaves more than this part of the members on open lists is the last.
FEWER = 0.9
#: Members of a long list, and the sets of a component, are dealt into blocks of about
#: this many, of sets with about so many shingles.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Shingles counted at once, and bytes of text that are worked on at once.
STRETCH, PART = 1 << 20, 1 << 21


def _written(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def sets_of(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles in rising order."""
    hashes, firsts = shingles(*word_hashes(texts, BLANK_SEPARATED), size)
    for low, high in zip(firsts[:-1], firsts[1:], strict=True):
        yield np.unique(hashes[low:high])


def prefix_size(n: int) -> int:
    """n - T + 1 for T = ceil(3 n / 4)."""
    return n - -(-3 * n // 4) + 1


def identity(own: np.ndarray) -> tuple[np.int64, np.int64]:
    """128 bits that depend on the set alone."""
    a = mix(own).sum(dtype=np.uint64)
    b = mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return a.astype(np.int64), b.astype(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, a, b) of each document and (token, count) of the shingles that repeat within a task.

    Counted are stretches of about a million shingles of a task, and what occurs
    once in a stretch is left out, which most shingles do. So the sums fall a
    little short of the lists' lengths; any order serves that all documents share.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def frequent(seen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        tokens, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64),) * 2
        often = n > 1
        return tokens[often].view(np.int64), n[often].astype(np.int64)

    def said(ids: pa.Array, rows: list, tokens: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
        some = lambda x: pa.array([*x, *[None] * len(tokens)], pa.int64())
        none = [None] * len(rows)
        return pa.record_batch(
            [
                pa.concat_arrays([ids, pa.nulls(len(tokens), ids.type)]),
                some(n), some(a), some(b),
                pa.array([*none, *tokens.tolist()], pa.int64()), pa.array([*none, *counts.tolist()], pa.int64()),
            ],
            names=["doc_id", "n", "a", "b", "token", "count"],
        )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        held, kind_ = 0, None
        for batch in (part for whole in batches for part in slices(whole, "text", PART)):
            own = list(sets_of(batch.column("text"), size))
            seen += own
            held += sum(map(len, own))
            found = (np.zeros(0, np.int64),) * 2
            if held > STRETCH:
                found, seen, held = frequent(seen), [], 0
            kind_ = batch.column("doc_id").type
            yield said(batch.column("doc_id"), [(len(s), *identity(s)) for s in own], *found)
        if kind_ is not None:
            yield said(pa.nulls(0, kind_), [], *frequent(seen))

    return docs.mapInArrow(sign, f"doc_id {kind}, n long, a long, b long, token long, count long")


def short_lists(docs: DataFrame, size: int, tokens: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(list, token, doc_id, place): each document's n - T + 1 rarest shingles.

    ``list`` stands for the shingle or, of a long list, for a block of it; only
    then ``token`` is the shingle. ``place`` holds the set's size in its upper
    and the shingle's place in the order in its lower 32 bits.

    The order that decides is the same for all documents: shingles that are not
    among the long lists by their hash, then the others by length of their list.
    ``tokens`` are the long lists' in rising order. What a task meets again
    within itself, exact copies, is left out: copies are known by their identity.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((tokens, counts))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, length = shared.value
        met: set[tuple] = set()
        for batch in (part for whole in batches for part in slices(whole, "text", PART)):
            rows, chosen, lists_, places = [], [], [], []
            for row, own in enumerate(sets_of(batch.column("text"), size)):
                who = (len(own), *identity(own))
                if not len(own) or who in met or not batch.column("doc_id")[row].is_valid:
                    continue
                met.add(who)
                p = prefix_size(len(own))
                split = np.zeros(p, np.int64)
                if len(long):
                    at = np.minimum(np.searchsorted(long, own), len(long) - 1)
                    is_long = long[at] == own
                    if is_long.any():
                        rest = own[is_long]
                        order = np.lexsort((rest, length[at[is_long]]))
                        lengths = np.concatenate([np.zeros((~is_long).sum(), np.int64), length[at[is_long]][order]])
                        own = np.concatenate([own[~is_long], rest[order]])
                        split = -(-lengths[:p] // BLOCK) * (lengths[:p] > BLOCK)
                block = (int(who[1] & 0x7FFFFFFF) % np.maximum(split, 1)).astype(np.uint64)
                rows.append(np.full(p, row))
                chosen.append(pa.array(own[:p].view(np.int64), mask=split == 0))
                lists_.append(np.where(split > 0, mix(own[:p] + block * np.uint64(0x9E3779B97F4A7C15)), own[:p]))
                places.append((who[0] << 32) + np.arange(p))
            if rows:
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate(lists_).view(np.int64)),
                        pa.concat_arrays(chosen),
                        batch.column("doc_id").take(pa.array(np.concatenate(rows))),
                        pa.array(np.concatenate(places)),
                    ],
                    names=["list", "token", "doc_id", "place"],
                )

    return docs.mapInArrow(lists, f"list long, token long, doc_id {kind}, place long")


class Lists:
    """The inverted lists of some sets, which come as rising arrays."""

    def __init__(self, members: list[np.ndarray]):
        self.sizes = np.array([len(m) for m in members])
        tokens, who = np.concatenate(members), np.repeat(np.arange(len(members)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.who = tokens[order], who[order]

    def similar(self, query: np.ndarray) -> np.ndarray:
        """Which members overlap the query enough.

        Of the query's lists over these members the L longest are not merged. The
        others are merged and counted; who occurs on T - L of them is looked for on
        the long lists by binary search.
        """
        m = len(self.sizes)
        need = -(-NEED_SIZES * (self.sizes + len(query)) // NEED_OVERLAP)
        least = int(need.min(initial=len(query) + 1))
        low, high = np.searchsorted(self.tokens, query, "left"), np.searchsorted(self.tokens, query, "right")
        by_length = np.argsort(high - low, kind="stable")
        longest = int((high - low).max(initial=1))
        skipped = min(least - 1, int(least / (0.01 * np.log2(max(longest, 2)) + 1)))
        short, long = np.split(by_length, [len(query) - max(skipped, 0)])
        merged = [self.who[low[i] : high[i]] for i in short]
        found = np.bincount(np.concatenate(merged) if merged else np.zeros(0, np.int64), minlength=m)
        candidates = np.flatnonzero(found >= np.maximum(need - len(long), 1))
        if len(candidates) and len(long):
            # all long lists behind each other; a probe is a binary search for (list, member)
            keys = np.concatenate([k * m + self.who[low[i] : high[i]] for k, i in enumerate(long)])
            probes = (np.arange(len(long)) * m)[:, None] + candidates[None, :]
            at = np.minimum(np.searchsorted(keys, probes), max(len(keys) - 1, 0))
            found[candidates] += (keys[at] == probes).sum(axis=0) if len(keys) else 0
        out = np.zeros(m, bool)
        out[candidates] = found[candidates] >= need[candidates]
        return out


def divide_skip(query: np.ndarray, members: list[np.ndarray]) -> np.ndarray:
    """Which members overlap the query enough."""
    return Lists(members).similar(query)


def short_of(lists: DataFrame) -> DataFrame:
    """(doc_id, tokens): the short lists that each document is on, at most a quarter of its shingles."""
    return lists.groupBy("doc_id").agg(F.collect_set("token").alias("tokens"))


def merged(pairs: DataFrame, short: DataFrame) -> DataFrame:
    """The pairs (a, b, a_n, b_n) that meet on enough short lists.

    The short lists of both are those of the first shingles in the common order.
    All shingles that they share up to the place where the first of the two has
    its last short list are counted, and beyond it that one has T - 1 shingles
    left. So a pair that meets on fewer than its needed overlap less T - 1, the
    number of lists that need not be merged, isn't similar enough.
    """
    left = short.select(F.col("doc_id").alias("a"), F.col("tokens").alias("left"))
    right = short.select(F.col("doc_id").alias("b"), F.col("tokens").alias("right"))
    met = pairs.join(left, "a").join(right, "b").withColumn("met", F.size(F.array_intersect("left", "right")))
    need = F.ceil((F.col("a_n") + F.col("b_n")) * NEED_SIZES / NEED_OVERLAP)
    unmerged = F.greatest(F.ceil(F.col("a_n") * 3 / 4), F.ceil(F.col("b_n") * 3 / 4)) - 1
    return met.filter(F.col("met") >= F.greatest(need - unmerged, F.lit(1))).select("a", "b")


def links(
    pairs: DataFrame, short: DataFrame, docs: DataFrame, size: int, folder: str, known: list[DataFrame]
) -> DataFrame:
    """The pairs (a, b) that are similar enough, of candidates (a, b, a_n, b_n).

    Pairs of one ``a`` come in a row and are searched as a block. Sets are made
    anew from the texts of the documents that are left after the merge: all
    documents' sets would be larger than their texts. ``known`` are the tables of
    sets of earlier calls; that of this call is added.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    candidates = _written(merged(pairs, short), f"{folder}/candidates")
    if candidates.isEmpty():
        return candidates
    ids = candidates.select(F.col("a").alias("doc_id")).union(candidates.select("b")).distinct()
    ids = _written(ids, f"{folder}/ids")
    new = ids
    for earlier in known:
        new = new.join(earlier.select("doc_id"), "doc_id", "left_anti")
    if known:
        new = _written(new, f"{folder}/new-ids")
    packed = lambda t: [pa.array([s.tobytes() for s in sets_of(t, size)], pa.binary())]
    sets = append_columns(docs.join(new, "doc_id", "left_semi"), "text", ["doc_id"], packed, "own binary")
    known.append(_written(sets, f"{folder}/sets"))
    sets = reduce(DataFrame.unionByName, known).join(ids, "doc_id", "left_semi")
    left = sets.select(F.col("doc_id").alias("a"), F.col("own").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("own").alias("right"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "right", 1 << 22)):
            lefts = batch.column("left").to_pylist()
            rights = [np.frombuffer(x, np.uint64) for x in batch.column("right").to_pylist()]
            similar, low = np.zeros(len(lefts), bool), 0
            while low < len(lefts):
                high = low + 1
                while high < len(lefts) and lefts[high] == lefts[low]:
                    high += 1
                similar[low:high] = divide_skip(np.frombuffer(lefts[low], np.uint64), rights[low:high])
                low = high
            yield pa.record_batch(
                [batch.column("a").filter(pa.array(similar)), batch.column("b").filter(pa.array(similar))],
                names=["a", "b"],
            )

    both = candidates.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return _written(both.mapInArrow(search, f"a {kind}, b {kind}"), f"{folder}/links")


def _lengths_fit(n: str | Column, m: str | Column) -> Column:
    return F.least(n, m) * 4 >= F.greatest(n, m) * 3


def _rest_fits(n: str, place: str, m: str, at: str) -> Column:
    """Whether two sets may overlap enough if what they meet on is the first that they share."""
    overlap = F.least(F.col(n) - F.col(place), F.col(m) - F.col(at))
    return overlap * NEED_OVERLAP >= (F.col(n) + F.col(m)) * NEED_SIZES


def _hub_pairs(members: DataFrame) -> DataFrame:
    """Pairs of members and the hub of their list within the bounds on lengths and places."""
    fits = (F.col("doc_id") != F.col("hub.doc_id")) & _lengths_fit("n", "hub.n")
    fits &= _rest_fits("n", "place", "hub.n", "hub.place")
    return members.filter(fits).select(
        F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("hub.n").alias("a_n"), F.col("n").alias("b_n")
    ).distinct()


class Join(NamedTuple):
    """All links between the sets of ``rows`` (row, doc_id, n_shingles, class_id, component).

    A class holds the rows of equal sets; all of them link with each other and
    with all rows of the classes that theirs links with. ``class_id`` is null for
    a row without shingles, and for one without an id whose set no row with an id
    has. ``classes`` (class_id, component, n, size) counts the rows with an id;
    ``texts`` (class_id, text) has one text of each.
    """

    rows: DataFrame
    classes: DataFrame
    texts: DataFrame
    size: int
    folder: str

    def pairs(self) -> DataFrame:
        """The links between different classes: (a, b), a < b, each once."""
        return _searched(self._blocks(), self.size, pairs=True)

    def counts(self) -> DataFrame:
        """(class_id, around): the number of rows in the classes that each class links with, if any."""
        found = _searched(self._blocks(), self.size, pairs=False)
        return found.groupBy("class_id").agg(F.sum("around").alias("around"))

    def linked(self) -> DataFrame:
        """One row per document row: ``doc_id``, ``n_shingles``, ``class_id``, ``n_links``.

        ``n_links`` counts the other rows, with an id, that the row links with.
        """
        return self._with_links(self.rows).select("doc_id", "n_shingles", "class_id", "n_links")

    def components(self) -> DataFrame:
        """What :func:`components` gives, from the same search."""
        return self._with_roots(self.rows).select("doc_id", "n_shingles", "component_id")

    def documents(self) -> DataFrame:
        """One row per document row: ``doc_id``, ``n_shingles``, ``component_id``, ``class_id``, ``n_links``."""
        both = self._with_links(self._with_roots(self.rows))
        return both.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")

    def _with_links(self, rows: DataFrame) -> DataFrame:
        sizes = self.classes.select("class_id", "size").join(self.counts(), "class_id", "left")
        links = F.col("size") - 1 + F.coalesce("around", F.lit(0))
        rows = rows.join(sizes.select("class_id", links.alias("links")), "class_id", "left")
        own = F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0)
        return rows.withColumn("n_links", own.cast("long"))

    def _with_roots(self, rows: DataFrame) -> DataFrame:
        """Adds ``component_id``, the smallest id that is reachable: rows that share an id are one document."""
        least = rows.filter("doc_id is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
        rows = rows.join(least, "component", "left").withColumn("least", F.coalesce("least", "doc_id"))
        if self.rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
            return rows.withColumn("component_id", F.col("least"))
        roots = connected(rows.select(F.col("least").alias("a"), F.col("doc_id").alias("b")), f"{self.folder}/ids")
        rows = rows.join(roots.withColumnRenamed("node", "least"), "least", "left")
        return rows.withColumn("component_id", F.coalesce("root", "least"))

    def _blocks(self) -> DataFrame:
        """(component, band, next, i, j, side, class_id, size, text): each class for each pair of blocks it is in.

        Bands of lengths are wider than those of two sets that link may differ, so
        that links are within a band or between neighbours. A band's classes are
        dealt into blocks of bounded number and length. Within a band, block i
        meets the blocks from i on; of the next band, it meets all.
        """
        band = F.floor(F.log("n") / F.log(F.lit(1.34))).cast("int")
        classes = self.classes.filter(F.col("n") > 0).withColumn("band", band)
        several = classes.groupBy("component").agg(F.count("*").alias("of")).filter("of > 1").select("component")
        cells = classes.join(several, "component").groupBy("component", "band").agg(
            F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
        )
        cells = _written(cells, f"{new_dir(cells.sparkSession, 'jaccard-cells')}")
        above = cells.select("component", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
        below = cells.select("component", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
        cells = cells.join(above, ["component", "band"], "left").join(below, ["component", "band"], "left")
        own = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
        dealt = classes.join(cells, ["component", "band"]).withColumn("own", own)
        last = F.col("blocks") - 1

        def meetings(many: Column, of: Column, next_: bool, i: Column | None, side: int) -> Column:
            """The pairs of blocks with each of ``many``, as (band, next, i, j, side)."""
            entry = lambda k: F.struct(
                of.alias("band"), F.lit(next_).alias("next"), (k if i is None else i).alias("i"),
                (F.col("own") if i is None else k).alias("j"), F.lit(side).alias("side"),
            )
            return F.transform(many, entry)

        none = F.array().cast("array<int>")
        upto = lambda n: F.when(F.col(n).isNotNull(), F.sequence(F.lit(0), F.col(n) - 1)).otherwise(none)
        before = F.when(F.col("own") > 0, F.sequence(F.lit(0), F.col("own") - 1)).otherwise(none)
        here = F.col("band")
        met = F.concat(
            meetings(F.sequence("own", last), here, False, F.col("own"), 0),
            meetings(before, here, False, None, 1),
            meetings(upto("above"), here, True, F.col("own"), 0),
            meetings(upto("below"), here - 1, True, None, 1),
        )
        folder = new_dir(cells.sparkSession, "jaccard-blocks")
        # the ids as a table of its own: as long as it is small, other texts go before any shuffle
        wanted = _written(dealt.select("class_id"), f"{folder}/classes")
        dealt = dealt.select("component", "class_id", "size", F.explode(met).alias("met"))
        dealt = _written(dealt.select("component", "met.*", "class_id", "size"), f"{folder}/dealt")
        return dealt.join(self.texts.join(wanted, "class_id", "left_semi"), "class_id")


def _searched(blocks: DataFrame, size: int, pairs: bool) -> DataFrame:
    """What :class:`Join` tells of the links of each pair of blocks, whose rows come in a row, side after side."""
    key = ["component", "band", "next", "i", "j"]

    def told(ids: list, rows: list[int], sides: list[int], sets: list[np.ndarray]) -> tuple[list, list]:
        first = sides.index(1) if 1 in sides else len(sides)
        own = first == len(sides)
        left, right = (slice(0, first), slice(0, first)) if own else (slice(0, first), slice(first, None))
        if first == 0 or len(sets[left]) + len(sets[right]) < 3 - (not own):
            return [], []
        lists, others, weights = Lists(sets[right]), ids[right], np.array(rows[right])
        links_a, links_b, around, back = [], [], np.zeros(first, np.int64), np.zeros(len(others), np.int64)
        for k, query in enumerate(sets[left]):
            similar = lists.similar(query)
            if own:
                similar[k] = False
            if pairs:
                found = [others[m] for m in np.flatnonzero(similar) if not own or m > k]
                links_a += [min(ids[k], x) for x in found]
                links_b += [max(ids[k], x) for x in found]
            else:
                around[k] = weights[similar].sum()
                back[similar] += rows[k]
        if pairs:
            return links_a, links_b
        said = list(zip(ids[left], around.tolist(), strict=True)) + ([] if own else list(zip(others, back.tolist(), strict=True)))
        said = [(c, n) for c, n in said if n]
        return [c for c, _ in said], [n for _, n in said]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b"] if pairs else ["class_id", "around"]
        now, held = None, ([], [], [], [])
        for batch in (part for whole in batches for part in slices(whole, "text", PART)):
            keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
            columns = [batch.column(c).to_pylist() for c in ("class_id", "size", "side")]
            for k, *row in zip(keys, *columns, sets_of(batch.column("text"), size), strict=True):
                if k != now:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in told(*held)], names=names)
                    now, held = k, ([], [], [], [])
                for kept, value in zip(held, row, strict=True):
                    kept.append(value)
        yield pa.record_batch([pa.array(x, pa.int64()) for x in told(*held)], names=names)

    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = blocks.select(*key, "side", "class_id", "size", "text").repartition(tasks, *key)
    in_order = in_order.sortWithinPartitions(*key, "side", "class_id")
    return in_order.mapInArrow(search, "a long, b long" if pairs else "class_id long, around long")


def join(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> Join:
    """All links between different sets of shingles, and which rows have which set.

    Texts and sets are taken as :func:`components` does. Rows which share an id are
    told apart: each has its links, while in ``component_id`` they are one document.
    So rows are numbered and written once, but where every row has a whole number
    of its own as its id; that number serves, and ``docs`` is read where it lies. A row without an id links with nothing;
    it is in the class and component of an equal text, if there is one. Other
    columns are left out, whatever their names. An empty table gives empty ones.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_dir(spark, "jaccard-join")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own_numbers = _own_numbers(docs)
    if own_numbers:
        docs = docs.withColumn("row", F.col("id").cast("long"))
    else:
        docs = _written(docs.withColumn("row", F.monotonically_increasing_id()), f"{folder}/rows")
    named = docs.filter("id is not null").select(F.col("row").alias("doc_id"), "text")
    grouped = _grouped(named, size, f"{folder}/groups", 3).withColumnRenamed("doc_id", "row")
    grouped = _written(grouped, f"{folder}/grouped")
    classes = grouped.filter("n > 0").groupBy("n", "a", "b").agg(
        F.min("row").alias("class_id"), F.count("*").alias("size"), F.min("component_id").alias("component")
    )
    classes = _written(classes, f"{folder}/classes")
    own = grouped.select("row", "n", "a", "b", F.col("component_id").alias("alone"))
    if not own_numbers:
        nameless = signatures(docs.filter("id is null").select(F.col("row").alias("doc_id"), "text"), size)
        nameless = nameless.filter("n is not null").select(F.col("doc_id").alias("row"), "n", "a", "b")
        own = own.unionByName(nameless.withColumn("alone", F.lit(None).cast("long")))
    rows = own.join(classes.drop("size"), ["n", "a", "b"], "left")
    if own_numbers:
        rows = rows.withColumn("id", F.col("row").cast(docs.schema["id"].dataType))
    else:
        rows = rows.join(docs.select("row", "id"), "row")
    rows = rows.select(
        "row", F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "class_id",
        F.coalesce("component", "alone").alias("component"),
    )
    rows = _written(rows, f"{folder}/members")
    texts = docs.select(F.col("row").alias("class_id"), "text")
    return Join(rows, classes.select("class_id", "component", "n", "size"), texts, size, folder)


def _own_numbers(docs: DataFrame) -> bool:
    """Whether every row has an id, a whole number, that no other has."""
    if not isinstance(docs.schema["id"].dataType, (ByteType, ShortType, IntegerType, LongType)):
        return False
    return docs.groupBy("id").count().filter("id is null or count > 1").isEmpty()


def components(
    docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", hub_rounds: int = 3
) -> DataFrame:
    """One row per document row: ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    This mode gives components only, without counting links: those are :func:`join`'s.

    Documents link if their sets of ``size``-word shingles have a Jaccard
    similarity of 3/4 or more; a text with fewer words has one shingle. Whole
    texts are read, and no partner is left out. Sets are compared by 64-bit
    hashes of their shingles.

    A null or empty text, or one without words, has no shingles and links with
    nothing. Repeated rows are copies of each other. Rows that share an id are
    one document. A null id is nobody's: the row has its own n_shingles, links
    nothing, and its component is that of an equal text, if there is one. Other
    columns are left out, whatever their names. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _grouped(docs, size, new_dir(docs.sparkSession, "jaccard"), hub_rounds)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, size: int, folder: str, hub_rounds: int) -> DataFrame:
    """(doc_id, n, a, b, component_id) of the rows (doc_id, text): size and identity of its set, and its component."""
    signed = _written(signatures(docs, size), f"{folder}/signed")
    own = signed.filter("n is not null").select("doc_id", "n", "a", "b")
    classes = own.filter("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = _written(classes.filter("copies > 1").drop("copies"), f"{folder}/classes")
    copies = own.join(classes, ["n", "a", "b"]).filter("doc_id <> rep").select("doc_id", "rep").distinct()
    copies = _written(copies, f"{folder}/copies")

    counted = signed.filter("token is not null").groupBy("token").agg(F.sum("count").alias("n"))
    long = counted.filter(F.col("n") >= LEAST_LONG).orderBy(F.desc("n"), "token").limit(MOST_LONG).toArrow()
    tokens = long.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    short = short_lists(docs, size, tokens[order], long.column("n").to_numpy()[order])
    of_list = Window.partitionBy("list")
    short = (
        short.withColumn("hub", F.min(F.struct(F.col("place").bitwiseAND(0xFFFFFFFF).alias("at"), "doc_id", "place")).over(of_list))
        .withColumn("first", F.min("doc_id").over(of_list))
        .withColumn("last", F.max("doc_id").over(of_list))
        .filter((F.col("first") != F.col("last")) | F.col("token").isNotNull())
    )
    n = lambda place: F.shiftright(place, 32).cast("int")
    at = lambda place: F.col(place).bitwiseAND(0xFFFFFFFF).cast("int")
    lists = short.select(
        F.coalesce("token", "list").alias("token"),
        F.col("token").isNotNull().alias("split"),
        "doc_id",
        n(F.col("place")).alias("n"),
        at("place").alias("place"),
        F.struct(at("hub.place").alias("place"), F.col("hub.doc_id").alias("doc_id"), n(F.col("hub.place")).alias("n")).alias("hub"),
    )
    lists = _written(lists, f"{folder}/lists")
    tokens_of = _written(short_of(lists), f"{folder}/short")

    # the first round: each member with the hub of its block, and these with the list's
    split = lists.filter("split")
    tops = split.groupBy("token").agg(F.min("hub").alias("top"))
    hubs = split.select("token", "hub").distinct().join(tops, "token")
    hubs = hubs.select("hub.doc_id", "hub.n", "hub.place", F.col("top").alias("hub"))
    pairs = _hub_pairs(lists.select("doc_id", "n", "place", "hub").unionByName(hubs))
    known: list[DataFrame] = []
    found = links(pairs, tokens_of, docs, size, f"{folder}/0", known)
    roots = _roots(found, copies, f"{folder}/0/components")
    reps = lists.join(copies, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    rest = reps.select("token", "doc_id", "rep", "n", "place")
    before = None
    for number in range(1, hub_rounds + 1):
        # a list whose members are in one component stays so
        rest = _open_lists(rest, roots)
        if before is None and own.groupBy("doc_id").count().filter("count > 1").isEmpty():
            # copies of different tasks are on the same lists, at the same places: one of them does
            some = [F.min(c).alias(c) for c in ("doc_id", "n", "place", "label")]
            rest = rest.groupBy("token", "rep").agg(*some)
        rest = _written(rest, f"{folder}/{number}/open")
        members = rest.count()
        if not members:
            break
        # rounds of hubs end when one has closed few lists
        last = number == hub_rounds or before is not None and members > FEWER * before
        before = members
        if last:
            pairs = _remaining_pairs(rest)
        else:
            # another hub each time; only who is not in its component is compared with it
            by = F.struct(F.xxhash64("doc_id", F.lit(number)).alias("hash"), "place", "doc_id", "n", "label")
            chosen = rest.groupBy("token").agg(F.max(by).alias("hub"))
            pairs = _hub_pairs(rest.join(chosen, "token").filter("label <> hub.label"))
        more = links(pairs, tokens_of, docs, size, f"{folder}/{number}", known)
        if not more.isEmpty():
            stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            roots = _roots(more.unionByName(stars), copies, f"{folder}/{number}/components")
        if last:
            break

    of_class = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n", "a", "b", F.coalesce("root", "rep").alias("of_copies")
    )
    of_class = _written(of_class, f"{folder}/class-roots")
    return (
        own.join(of_class, ["n", "a", "b"], "left")
        .join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select(
            *("doc_id", "n", "a", "b"),
            F.coalesce(F.least("of_copies", "root"), "doc_id").alias("component_id"),
        )
    )


def _roots(found: DataFrame, copies: DataFrame, folder: str) -> DataFrame:
    """Components of the links between copies' representatives."""
    a, b = (copies.select(F.col("doc_id").alias(c), F.col("rep").alias(f"{c}_rep")) for c in "ab")
    ends = found.join(a, "a", "left").join(b, "b", "left")
    return connected(ends.select(F.coalesce("a_rep", "a").alias("a"), F.coalesce("b_rep", "b").alias("b")), folder)


def _open_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (token, doc_id, rep, n, place), with their component, of lists that hold more than one component."""
    labelled = lists.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = labelled.select("token", "doc_id", "rep", "n", "place", F.coalesce("root", "rep").alias("label"))
    mixed = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return labelled.join(mixed.filter("low <> high").select("token"), "token")


def _remaining_pairs(rest: DataFrame) -> DataFrame:
    """All pairs of members in different components that the bounds don't rule out.

    If the token they meet on is the first that they share, what follows it in
    the shorter rest bounds their overlap.
    """
    left = rest.select("token", *[F.col(c).alias(f"{c}1") for c in ("doc_id", "n", "place", "label")])
    right = rest.select("token", *[F.col(c).alias(f"{c}2") for c in ("doc_id", "n", "place", "label")])
    enough = _rest_fits("n1", "place1", "n2", "place2")
    apart = (F.col("doc_id1") < F.col("doc_id2")) & (F.col("label1") != F.col("label2"))
    met = left.join(right, "token").filter(apart & enough & _lengths_fit("n1", "n2"))
    return met.select(
        F.col("doc_id1").alias("a"), F.col("doc_id2").alias("b"), F.col("n1").alias("a_n"), F.col("n2").alias("b_n")
    ).distinct()
