"""Quality by attention-based multiple-instance learning over the passages of a document.

Every passage is encoded, a gated attention learned from the documents' labels
weighs the passages, and a logistic unit scores the weighted representation.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .sample import Adam, fit_in_one_task, labelled_sample, run_firsts, sigmoid, sum_by
from .words import BLANK_SEPARATED, LOWER, SLICE, append_columns, column_bytes, hash_spans, spans

PASSAGE = 64
HIDDEN, GATE = 16, 8


def _class(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


CLASSES = (
    _class(bytes(range(65, 91))),
    _class(bytes(range(97, 123))),
    _class(bytes(range(48, 58))),
    _class(bytes(range(128, 256))),
    _class(b".,;:'\"?-()"),
    _class(b"!"),
    _class(b"#$%&*@^~=+<>/\\_"),
    _class(b"|{}[]"),
    _class(b"\n"),
)
FEATURES = len(CLASSES) + 7


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (runs of PASSAGE words, the last one shorter) and each text's first one.

    A text without words has one passage with no words.
    """
    data, offsets = column_bytes(texts)
    starts, ends, firsts = spans(data, offsets, BLANK_SEPARATED)
    counts = np.diff(firsts)
    own = np.maximum(-(-counts // PASSAGE), 1)
    passage_firsts = run_firsts(own)
    text = np.repeat(np.arange(len(own)), own)
    number = np.arange(len(text)) - passage_firsts[text]
    low = firsts[text] + number * PASSAGE
    words = np.append(low, len(starts))  # of each passage the first word
    n = np.diff(words)
    # bytes from a passage's first word to the next one's, or to the text's end
    at = np.append(starts, len(data))
    begin = np.where(n > 0, at[words[:-1]], offsets[text])
    last = number == own[text] - 1
    end = np.where(last, offsets[text + 1], at[words[1:]])
    size = np.maximum(end - begin, 1).astype(np.float64)
    out = np.zeros((len(text), FEATURES))
    kinds = np.full(256, len(CLASSES), np.uint8)
    for k, members in enumerate(CLASSES):
        kinds[members] = k
    kind = kinds[data]
    for k in range(len(CLASSES)):
        before = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        out[:, k] = (before[end] - before[begin]) / size
    hashes = hash_spans(LOWER[data], starts, ends)
    passage = np.repeat(np.arange(len(text)), n)
    repeated = np.zeros(len(hashes))
    repeated[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    length = (ends - starts).astype(np.float64)
    per_word = np.stack([repeated, length / 8, (length == 1).astype(float), (length <= 3).astype(float)], axis=1)
    many = np.maximum(n, 1)[:, None]
    k = len(CLASSES)
    out[:, k : k + 4] = sum_by(per_word, words) / many
    order = np.lexsort((hashes, passage))
    ph, pp = hashes[order], passage[order]
    fresh = np.ones(len(ph))
    fresh[1:] = (ph[1:] != ph[:-1]) | (pp[1:] != pp[:-1])
    out[:, k + 4] = np.bincount(pp, fresh, len(text)) / many[:, 0]
    out[:, k + 5] = n / PASSAGE
    out[:, k + 6] = np.minimum(np.log1p(own[text]), 5) / 5
    return out, passage_firsts


def described(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    x, firsts = passages(batch.column("text"))
    return {
        "x": x,
        "passages": np.diff(firsts),
        "label": np.array(batch.column("label"), np.float64),
        "weight": np.array(batch.column("weight"), np.float64),
    }


def forward(m: dict[str, np.ndarray], x: np.ndarray, firsts: np.ndarray) -> dict[str, np.ndarray]:
    """Encoding, gates, attention and score of bags of passages (every bag has one at least)."""
    h = np.tanh((x - m["centre"]) / m["scale"] @ m["w"] + m["wb"])
    v, u = np.tanh(h @ m["v"] + m["vb"]), sigmoid(h @ m["u"] + m["ub"])
    e = (v * u) @ m["a"]
    bag = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    e = np.exp(e - np.maximum.reduceat(e, firsts[:-1])[bag])
    attention = e / sum_by(e, firsts)[bag]
    z = sum_by(attention[:, None] * h, firsts)
    return {"h": h, "v": v, "u": u, "bag": bag, "attention": attention, "z": z, "p": sigmoid(z @ m["c"] + m["d"])}


def fit(parts: list[dict[str, np.ndarray]], rounds: int = 300, seed: int = 5) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    m = {
        "centre": np.zeros(FEATURES),
        "scale": np.ones(FEATURES),
        "w": random.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)),
        "wb": np.zeros(HIDDEN),
        "v": random.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "vb": np.zeros(GATE),
        "u": random.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "ub": np.zeros(GATE),
        "a": random.normal(0, GATE**-0.5, GATE),
        "c": random.normal(0, HIDDEN**-0.5, HIDDEN),
        "d": np.zeros(1),
    }
    if not parts:
        return m
    x, counts, label, weight = (np.concatenate([p[k] for p in parts]) for k in ("x", "passages", "label", "weight"))
    m["centre"], m["scale"] = x.mean(axis=0), x.std(axis=0) + 0.02
    weight, firsts = weight / weight.sum(), run_firsts(counts)
    inputs = (x - m["centre"]) / m["scale"]
    steps = Adam({k: m[k] for k in ("w", "wb", "v", "vb", "u", "ub", "a", "c", "d")}, 0.02)
    for _ in range(rounds):
        f = forward(m, x, firsts)
        error = weight * (f["p"] - label)
        g = {"c": f["z"].T @ error + 1e-4 * m["c"], "d": np.array([error.sum()])}
        to_z = error[:, None] * m["c"]
        h, v, u, bag, attention = f["h"], f["v"], f["u"], f["bag"], f["attention"]
        to_attention = (to_z[bag] * h).sum(axis=1)
        mean = sum_by(attention * to_attention, firsts)
        to_e = attention * (to_attention - mean[bag])
        gate = v * u
        g["a"] = gate.T @ to_e
        to_v = to_e[:, None] * m["a"] * u * (1 - v * v)
        to_u = to_e[:, None] * m["a"] * v * u * (1 - u)
        g["v"], g["vb"], g["u"], g["ub"] = h.T @ to_v, to_v.sum(axis=0), h.T @ to_u, to_u.sum(axis=0)
        to_h = attention[:, None] * to_z[bag] + to_v @ m["v"].T + to_u @ m["u"].T
        to_in = to_h * (1 - h * h)
        g["w"], g["wb"] = inputs.T @ to_in + 1e-4 * m["w"], to_in.sum(axis=0)
        steps.apply(g)
    return m


def train(
    docs: DataFrame, labels: DataFrame, learnable: Column, rows: int = 6_000, most_bytes: int = 1 << 19
) -> dict[str, np.ndarray]:
    """Fits on ``labels.quality`` of at most ``rows`` documents of at most ``most_bytes``; ``learnable`` picks the ids."""
    return fit_in_one_task(labelled_sample(docs, labels, "quality", learnable, rows, most_bytes), described, fit)


def score(
    docs: DataFrame,
    model: dict[str, np.ndarray],
    kept: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    most: int = SLICE,
) -> DataFrame:
    """The columns ``kept`` of each row with ``score`` (chance of good quality), the number of passages and
    the one that weighed most.

    Whole texts are scored. A null or empty text, or one without words, is a
    document with one empty passage; repeated rows and null ids stay; kept
    columns called like the added ones are replaced. The model has a fixed size.
    About ``most`` bytes of text are worked on at once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: pa.Array) -> list[pa.Array]:
        x, firsts = passages(texts)
        if not len(x):
            return [pa.array([], pa.float64()), pa.array([], pa.int64()), pa.array([], pa.int64())]
        f = forward(shared.value, x, firsts)
        top = np.lexsort((np.arange(len(x)), -f["attention"], f["bag"]))[firsts[:-1]]
        return [pa.array(f["p"]), pa.array(np.diff(firsts)), pa.array(top - firsts[:-1])]

    return append_columns(docs, text_col, kept, scored, "score double;n_passages long;top_passage long", most)
