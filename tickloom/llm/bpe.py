"""Byte-level BPE: texts to token ids and back, long texts in overlapping chunks.

A long text is cut into chunks that overlap. Each chunk is pre-tokenised by
itself, wherever its cut fell. Where two neighbours agree on the start of a
pre-token in their overlap, they have fallen into step: from there on both see
what a pass over the whole text sees. The text is cut anew at these points and
the pieces, which lie within a chunk each, are encoded side by side.

Two neighbours that share no such start are joined and pre-tokenised together,
with more chunks if need be, until they fall into step with the next one; behind
that the cuts are the usual ones again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import small_batches

CHUNK, OVERLAP = 16_384, 512


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoder of a rank file and the bytes of each id, once a Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), tokens


def encode(text: str, path: str, pattern: str) -> np.ndarray:
    return np.array(encoding(path, pattern)[0].encode_ordinary(text), "<u4")


def decode(ids: np.ndarray, path: str, pattern: str) -> bytes:
    """The raw bytes of the ids in a row."""
    return b"".join(map(encoding(path, pattern)[1].__getitem__, ids.tolist()))


def boundaries(text: str, pattern: str) -> np.ndarray:
    """Starts of the pre-tokens of a chunk."""
    return np.fromiter((m.start() for m in regex.finditer(pattern, text)), np.int64)


def borders(text: str, start: int, chunk: int, overlap: int, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of pre-tokens in the overlap with the chunk before and in that with the one behind.

    They are numbered by characters of the whole text. Not counted are the last
    ones, which the chunk's end may have broken off, and of the first ones those
    after white space: a piece that begins there would need to look across the
    cut, since a run of white space gives its last blank to the word that follows.
    """
    found = boundaries(text, pattern)
    tails = found[(found > chunk) & (found < len(text) - 2)] + start
    heads = [p for p in found[(found > 0) & (found < overlap)].tolist() if not text[p - 1].isspace()]
    return np.array(heads, np.int64) + start, tails


def stitch(starts: list[int], sizes: list[int], heads: list[np.ndarray], tails: list[np.ndarray], chunk: int) -> list[tuple]:
    """(start, low, high, apart) of each chunk: the part of the text that is cut out of it.

    A text is cut at the first place in an overlap where both neighbours start a
    pre-token. From the first chunk on that shares none with the next, ``apart``
    is true: those are cut by :func:`rejoin`, since what is known of a chunk says
    nothing of the whole text unless the one before is in step with it.
    """
    out, low = [], 0
    for i, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        if i + 1 == len(starts):
            out.append((start, low, start + size, False))
            break
        both = np.intersect1d(tails[i], heads[i + 1])
        if not len(both):
            rest = list(zip(starts[i:], sizes[i:], strict=True))
            out += [(s, max(low, s), s + (n if k + 1 == len(rest) else chunk), True) for k, (s, n) in enumerate(rest)]
            break
        out.append((start, low, int(both[0]), False))
        low = int(both[0])
    return out


def rejoin(chunks: Iterator[tuple], chunk: int, pattern: str) -> Iterator[tuple[int, int, str]]:
    """(row, low, piece): the cuts of chunks that follow each other, where neighbours may be out of step.

    ``chunks`` are (row, start, low, text, heads, tails), the first of a row in
    step with the whole text from ``low`` on. Held is the text from the last cut
    on; ``known`` are starts of pre-tokens of the whole text in it. A chunk that
    shares one of them is in step, and so what it knows is right. Any other is
    added to what is held, and that is pre-tokenised, up to its last certain start
    put out, and the rest kept. So no more is held than two chunks and a run
    without a cut; while such a run grows it is gone through at each doubling.
    """
    of, at, held, end, known, tried = None, 0, "", 0, np.zeros(0, np.int64), 0
    for row, start, low, text, heads, tails in chunks:
        if row != of:
            if held:
                yield of, at, held
            of, at, held, known, tried = row, low, text[low - start :], tails, 0
            end = start + chunk
            continue
        both = np.intersect1d(known, heads)
        if len(both):
            cut = int(both[0])
            yield of, at, held[: cut - at]
            at, held, known, tried = cut, text[cut - start :], tails, 0
        else:
            held = held[: end - at] + text
            known = np.zeros(0, np.int64)
            if len(held) >= 2 * tried:
                found = boundaries(held, pattern)
                found = found[(found > 0) & (found < len(held) - 2)]
                known, tried = found + at, len(held)
                certain = found[found <= start + chunk - at]
                cut = next((p for p in certain[::-1].tolist() if not held[p - 1].isspace()), 0)
                if cut:
                    yield of, at, held[:cut]
                    at, held, known, tried = at + cut, held[cut:], known[found > cut], 0
        end = start + chunk
    if held:
        yield of, at, held


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [encode(t or "", path, pattern) for t in batch.column("piece").to_pylist()]
        yield pa.record_batch(
            [*batch.columns[:-1], pa.array([x.tobytes() for x in ids], pa.binary())],
            names=[*batch.schema.names[:-1], "ids"],
        )


def encode_texts(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """Adds ``ids`` (little-endian unsigned 32-bit numbers) of the whole text to the rows of ``docs``.

    Texts of at most ``chunk`` characters are encoded where they are. Longer
    ones are cut into chunks, which are dealt out and pre-tokenised; what is
    stitched per text are the starts of pre-tokens in the overlaps alone. From a
    border on whose neighbours are out of step, a text's chunks pass one task in
    order, which holds a few of them and pre-tokenises only those out of step; its
    pieces are dealt out again. A pre-token longer than a chunk is one piece.

    A null or empty text has no ids; rows that repeat stay; all columns of
    ``docs`` are kept (but for one called ``ids``, which is replaced). An empty
    table gives an empty one.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "ids"]
    names = [f"c{i}" for i in range(len(kept))]  # free of clashes with the columns made here
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(kept, names, strict=True)])
    text = names[kept.index(text_col)]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    is_long = F.coalesce(F.length(text) > chunk, F.lit(False))

    listed = ", ".join(f"{n} {kinds[n]}" for n in names)
    here = rows.filter(~is_long).withColumn("piece", F.col(text))
    short = here.mapInArrow(lambda b: _encoded(b, path, pattern), f"{listed}, ids binary")

    # A text and the other columns of its row travel under a number made at the scan.
    numbered = rows.filter(is_long).withColumn("row", F.monotonically_increasing_id())
    # The last chunk is longer than the overlap, so that it has its share of starts.
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1 - overlap, F.lit(0)), F.lit(chunk))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = numbered.select("row", text, F.explode(starts).alias("start")).select(
        "row", "start", F.expr(f"substring({text}, start + 1, {chunk + overlap})").alias("chunk")
    )
    # dealt out once: both the pre-tokens and the pieces are made of these partitions
    dealt = chunks.repartition(tasks, "row", "start")

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, texts = b.column("start").to_pylist(), b.column("chunk").to_pylist()
            found = [borders(t, s, chunk, overlap, pattern) for s, t in zip(starts, texts, strict=True)]
            sides = [pa.array([f[k].astype("<i8").tobytes() for f in found], pa.binary()) for k in (0, 1)]
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.record_batch([*b.columns[:2], sizes, *sides], names=["row", "start", "size", "heads", "tails"])

    def stitched(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start")
        heads, tails = ([np.frombuffer(x, "<i8") for x in group[c]] for c in ("heads", "tails"))
        parts = stitch(group["start"].tolist(), group["size"].tolist(), heads, tails, chunk)
        out = pd.DataFrame(parts, columns=["start", "low", "high", "apart"])
        told = {c: group[c].where(out["apart"].to_numpy(), None).to_numpy() for c in ("heads", "tails")}
        return out.assign(row=key[0], **told)

    def rejoined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks_of() -> Iterator[tuple]:
            for b in batches:
                for *known, heads, tails in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield *known, np.frombuffer(heads, "<i8"), np.frombuffer(tails, "<i8")

        for row, low, piece in rejoin(chunks_of(), chunk, pattern):
            yield pa.record_batch([pa.array([row]), pa.array([low]), pa.array([piece])], names=["row", "number", "piece"])

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [key[0]], "ids": [b"".join(group.sort_values("number")["ids"])]})

    plan = (
        dealt.mapInArrow(pretokenise, "row long, start int, size long, heads binary, tails binary")
        .groupBy("row")
        .applyInPandas(stitched, "row long, start int, low long, high long, apart boolean, heads binary, tails binary")
    )
    parts = dealt.join(plan, ["row", "start"])
    part = F.expr("substring(chunk, cast(low - start + 1 as int), cast(high - low as int))").alias("piece")
    in_step = parts.filter("not apart").select("row", F.col("low").alias("number"), part)
    in_order = parts.filter("apart").repartition(tasks, "row").sortWithinPartitions("row", "start")
    out_of_step = in_order.select("row", "start", "low", "chunk", "heads", "tails")
    out_of_step = out_of_step.mapInArrow(rejoined, "row long, number long, piece string")
    pieces = in_step.unionByName(out_of_step.repartition(tasks, "row", "number"))
    ids = (
        pieces.mapInArrow(lambda b: _encoded(b, path, pattern), "row long, number long, ids binary")
        .groupBy("row")
        .applyInPandas(join, "row long, ids binary")
    )
    long = numbered.join(ids, "row").select(*names, "ids")
    both = short.unionByName(long)
    return both.select(*[both[n].alias(c) for c, n in zip(kept, names, strict=True)], "ids")


def with_digests(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds number and digest of the ids, and the digest of what they decode to."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, "<u4") for x in b.column("ids").to_pylist()]
            said = [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(decode(x, path, pattern)).hexdigest() for x in ids], pa.string()),
            ]
            names = [*b.schema.names, "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.record_batch([*b.columns, *said], names=names)

    return encoded.mapInArrow(digest, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string")
