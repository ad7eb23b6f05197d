"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

Only documents are labelled. Each sentence gets a chance p from its words, and
the document's is the noisy-or 1 - prod(1 - p). The document's error flows back
to its sentences in proportion to their part in it, so the fit finds out by
itself which sentences offend, and these are reported.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .sample import Adam, fit_in_one_task, labelled_sample, run_firsts, sigmoid, sum_by
from .words import ALPHANUMERIC, LOWER, SLICE, append_columns, column_bytes, hash_spans, spans

BITS = 18
#: A word counts by itself and by its first bytes, which stand for its stem.
STEMS = (5, 4)
ENDS = np.isin(np.arange(256), list(b".!?\n"))


def sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of each word (words x 3), each sentence's first word and each text's first sentence
    (one more number each), and the sentences' first and last bytes within their texts.

    A sentence ends at . ! ? or a line's end and has a word at least.
    """
    data, offsets = column_bytes(texts)
    small = LOWER[data]
    starts, ends, firsts = spans(small, offsets, ALPHANUMERIC)
    columns = [hash_spans(small, starts, ends)]
    for k in STEMS:
        columns.append(hash_spans(small, starts, np.minimum(ends, starts + k)) + np.uint64(k))
    places = np.stack([(c >> np.uint64(64 - BITS)).astype(np.int64) for c in columns], axis=1)
    stops = np.flatnonzero(ENDS[data])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    number = np.searchsorted(stops, starts)
    new = np.ones(len(starts), bool)
    new[1:] = (number[1:] != number[:-1]) | (text[1:] != text[:-1])
    first_words = np.append(np.flatnonzero(new), len(starts))
    first_sentences = np.searchsorted(first_words[:-1], firsts)
    own = offsets[text[first_words[:-1]]]
    return places, first_words, first_sentences, starts[first_words[:-1]] - own, ends[first_words[1:] - 1] - own


def described(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    places, words, firsts, _, _ = sentences(batch.column("text"))
    return {
        "places": places.astype(np.int32),
        "words": np.diff(words),
        "sentences": np.diff(firsts),
        "label": np.array(batch.column("label"), np.float64),
        "weight": np.array(batch.column("weight"), np.float64),
    }


def noisy_or(logits: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """S of 1 - exp(-S): the sum of -log(1 - p) over a document's sentences."""
    return sum_by(np.logaddexp(0, logits), firsts)


def fit(parts: list[dict[str, np.ndarray]], rounds: int = 80, shrink: float = 3e-4) -> dict[str, np.ndarray]:
    """Weights of the hashed words and stems, by gradient steps on all sampled documents at once.

    Weights are never negative: a sentence offends by what is in it, and no
    amount of harmless words makes up for that. Features of fewer than three
    sampled documents get no weight: what one document has says nothing about
    others.
    """
    n = 1 << BITS
    weights = {"w": np.zeros(n), "b": np.full(1, -6.0)}
    if not parts:
        return {"w": weights["w"].astype(np.float32), "b": weights["b"]}
    places, words, counts, label, weight = (
        np.concatenate([p[k] for p in parts]) for k in ("places", "words", "sentences", "label", "weight")
    )
    weight = weight / weight.sum()
    firsts = run_firsts(counts)
    document = np.repeat(np.arange(len(counts)), counts)
    sentence = np.repeat(np.repeat(np.arange(len(words)), words), places.shape[1])
    place = places.ravel()
    pairs = np.unique(document[sentence].astype(np.int64) * n + place)
    common = np.bincount(pairs % n, minlength=n) > 2
    place, sentence = place[common[place]], sentence[common[place]]
    steps = Adam(weights, 0.1)
    for _ in range(rounds):
        z = np.bincount(sentence, weights["w"][place], len(words)) + weights["b"]
        s = np.maximum(noisy_or(z, firsts), 1e-9)
        by_document = weight * ((1 - label) - label * np.exp(-s) / -np.expm1(-s))
        by_sentence = by_document[document] * sigmoid(z)
        g = np.bincount(place, by_sentence[sentence], n) + shrink * np.sign(weights["w"])
        steps.apply({"w": g, "b": np.array([by_sentence.sum()])})
        weights["w"][weights["w"] < 0.02] = 0
    return {"w": weights["w"].astype(np.float32), "b": weights["b"]}


def train(
    docs: DataFrame, labels: DataFrame, learnable: Column, rows: int = 6_000, most_bytes: int = 1 << 19
) -> dict[str, np.ndarray]:
    """Fits on ``labels.toxic`` of at most ``rows`` documents of at most ``most_bytes``; ``learnable`` picks the ids."""
    return fit_in_one_task(labelled_sample(docs, labels, "toxic", learnable, rows, most_bytes), described, fit)


def score(
    docs: DataFrame,
    model: dict[str, np.ndarray],
    kept: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    bound: float = 0.5,
    most: int = SLICE,
) -> DataFrame:
    """The columns ``kept`` of each row with ``score`` and ``offending``, the sentences whose own chance
    reaches ``bound`` (first and last byte within the UTF-8 text, chance).

    Whole texts are scored. Null and empty texts and texts without words have
    score 0 and offend nowhere; repeated rows and null ids stay; kept columns
    called ``score`` or ``offending`` are replaced. The model has a fixed size.
    About ``most`` bytes of text are worked on at once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spot = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def scored(texts: pa.Array) -> list[pa.Array]:
        places, words, firsts, begins, ends = sentences(texts)
        z = sum_by(shared.value["w"][places].sum(axis=1, dtype=np.float64), words) + shared.value["b"][0]
        own = sigmoid(z)
        found = np.flatnonzero(own >= bound)
        columns = [pa.array(begins[found]), pa.array(ends[found]), pa.array(own[found])]
        spots = pa.StructArray.from_arrays(columns, fields=list(spot))
        offsets = np.searchsorted(found, firsts).astype(np.int32)
        return [pa.array(-np.expm1(-noisy_or(z, firsts))), pa.ListArray.from_arrays(pa.array(offsets), spots)]

    added = "score double;offending array<struct<start:long,end:long,score:double>>"
    return append_columns(docs, text_col, kept, scored, added, most)
