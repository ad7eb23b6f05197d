"""Words and word shingles of whole Arrow batches, hashed to 64 bits in numpy.

Words are cut and hashed on the UTF-8 bytes of a batch at once. Temporary memory
is a small multiple of one piece, whatever the length of a text or a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 18
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits of the result."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, powers, inverse powers, factors by the place in a shingle."""
    inverse = pow(_MULT, -1, 1 << 64)
    one = np.ones(PIECE + 1, np.uint64)
    powers, inverses = one.copy(), one.copy()
    powers[1:], inverses[1:] = np.uint64(_MULT), np.uint64(inverse)
    byte_values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    places = mix(np.arange(1001, 1001 + 64, dtype=np.uint64)) | np.uint64(1)
    return byte_values, np.cumprod(powers), np.cumprod(inverses), places


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_ascii()


def byte_class(separators: bytes) -> np.ndarray:
    """True for the bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words between blanks.
BLANK_SEPARATED = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Digits, small letters and everything beyond ASCII (capital letters are made small first).
ALPHANUMERIC = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


#: Bytes of text that are worked on at once; temporary arrays take some twenty times as much.
SLICE = 1 << 23


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each (one row at least)."""
    column_at = batch.schema.get_field_index(column)
    _, offsets = column_bytes(batch.column(column_at))
    at, n = 0, batch.num_rows
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, min(upto, n) - at)
        at = upto


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let the session hand texts to Python in batches of at most so many rows: they may be long."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= rows:
        spark.conf.set(setting, rows)


def spans(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's first word (n + 1 numbers). ``data`` is in small letters."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = in_word[data]
    first = np.empty(len(data), bool)
    first[0] = inside[0]
    np.logical_and(inside[1:], ~inside[:-1], out=first[1:])
    last = np.empty(len(data), bool)
    last[-1] = inside[-1]
    np.logical_and(inside[:-1], ~inside[1:], out=last[:-1])
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, in order and without overlap."""
    byte_values, powers, inverses, _ = _tables()
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        upto = int(np.searchsorted(ends, base + PIECE, "right"))
        if upto <= at:  # one word longer than a piece
            total, shift = 0, 1
            for k in range(base, ends[at], PIECE):
                part = data[k : min(k + PIECE, ends[at])]
                total += int((byte_values[part] * powers[: len(part)]).sum(dtype=np.uint64)) * shift
                shift = shift * pow(_MULT, PIECE, 1 << 64) & _MASK
            out[at] = np.uint64(total & _MASK)
            at += 1
            continue
        part = data[base : ends[upto - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(byte_values[part] * powers[: len(part)], out=sums[1:])
        s, e = starts[at:upto] - base, ends[at:upto] - base
        out[at:upto] = (sums[e] - sums[s]) * inverses[s]
        at = upto
    return mix(out ^ ((ends - starts).astype(np.uint64) * np.uint64(_MULT)))


def shingles(words: np.ndarray, firsts: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a text, and each text's first one (n + 1 numbers).

    With ``short`` a text of fewer than ``k`` words has one: the run of all its
    words. A text without words has none.
    """
    places = _tables()[3]
    counts = np.diff(firsts)
    own = np.where(counts >= k, counts - k + 1, (counts > 0) & short)
    out_firsts = np.concatenate([[0], np.cumsum(own)])
    if not out_firsts[-1]:
        return np.zeros(0, np.uint64), out_firsts
    text = np.repeat(np.arange(len(counts)), own)
    at = firsts[text] + np.arange(out_firsts[-1]) - out_firsts[text]
    total = np.full(len(at), np.uint64(k))
    length = np.minimum(counts[text], k)
    for j in range(k):
        if short:
            there = j < length
            total[there] += words[at[there] + j] * places[j]
        else:
            total += words[at + j] * places[j]
    if short:
        total += (k - length).astype(np.uint64) << np.uint64(8)
    return mix(total), out_firsts


def word_hashes(texts: pa.Array, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in small letters, and each text's first one."""
    data, offsets = column_bytes(texts)
    data = LOWER[data]
    starts, ends, firsts = spans(data, offsets, in_word)
    return hash_spans(data, starts, ends), firsts


def append_columns(
    docs: DataFrame,
    text_col: str,
    kept: Sequence[str],
    describe: Callable[[pa.Array], list[pa.Array]],
    added: str,
    most: int = SLICE,
) -> DataFrame:
    """The columns ``kept`` and those that ``describe`` makes of the texts; ``added`` is their schema.

    Kept columns travel under names of their own, so they may be called what
    they like; one that is called like an added column is replaced by it.
    """
    small_batches(docs.sparkSession)
    new = [part.strip().split(" ", 1)[0] for part in added.split(";")]
    kept = [c for c in kept if c not in new]
    names = ["text" if c == text_col else f"c{i}" for i, c in enumerate(kept)]
    others = [(c, n) for c, n in zip(kept, names, strict=True) if c != text_col]
    rows = docs.select(docs[text_col].alias("text"), *[docs[c].alias(n) for c, n in others])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), *added.split(";")])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", most)):
            columns = [*(batch.column(n) for n in names), *describe(batch.column("text"))]
            yield pa.record_batch(columns, names=[*names, *new])

    out = rows.mapInArrow(described, schema)
    return out.select(*[out[n].alias(c) for c, n in zip(kept, names, strict=True)], *new)
