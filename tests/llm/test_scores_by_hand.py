"""Scores of both models recomputed document by document with plain loops."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import quality, toxicity
from tickloom.llm.words import hash_spans

TEXTS = [
    "One sentence. Another! And a third?\nThe fourth line", "", "..!\n", "word", None, "É, ñandú élan. Zorg ZORG zorg\n\nx",
    "a" * 3000 + ". b", "longer words everywhere, internationalisation! short", " ".join(f"w{n}" for n in range(300)),
    "same " * 200, "tabs\tand\x0bothers  here . . .",
]


def hashed(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(hash_spans(data, np.array([0]), np.array([len(word)]))[0])


def toxic_by_hand(text, w, b):
    small = re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())
    innocent = 1.0
    for sentence in re.split(rb"[.!?\n]", small):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", sentence)
        if not words:
            continue
        z = b
        for word in words:
            z += w[hashed(word) >> (64 - toxicity.BITS)]
            for k in toxicity.STEMS:
                z += w[(hashed(word[:k]) + k) % (1 << 64) >> (64 - toxicity.BITS)]
        innocent *= 1 - 1 / (1 + math.exp(-z))
    return 1 - innocent


def test_noisy_or_of_sentences(spark):
    drawn = np.random.default_rng(1)
    model = {"w": drawn.normal(0, 0.3, 1 << toxicity.BITS).astype(np.float32), "b": np.array([-1.5])}
    df = spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.score, r.offending) for r in toxicity.score(df, model).collect()}
    for n, text in enumerate(TEXTS):
        w = model["w"].astype(float)
        assert got[n][0] == pytest.approx(toxic_by_hand(text, w, -1.5), abs=1e-6)
        for s in got[n][1]:
            own = text.encode()[s.start : s.end].decode()
            assert s.score == pytest.approx(toxic_by_hand(own, w, -1.5), abs=1e-6) and s.score >= 0.5


def quality_by_hand(x, m):
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    dot = lambda a, b: sum(float(i) * float(j) for i, j in zip(a, b, strict=True))
    encoded, energy = [], []
    for row in x:
        row = [(float(a) - c) / s for a, c, s in zip(row, m["centre"], m["scale"], strict=True)]
        h = [math.tanh(dot(row, m["w"][:, j]) + m["wb"][j]) for j in range(m["w"].shape[1])]
        gates = [
            math.tanh(dot(h, m["v"][:, j]) + m["vb"][j]) * sigmoid(dot(h, m["u"][:, j]) + m["ub"][j])
            for j in range(m["v"].shape[1])
        ]
        encoded.append(h)
        energy.append(math.exp(dot(gates, m["a"])))
    attention = [e / sum(energy) for e in energy]
    z = [sum(a * h[j] for a, h in zip(attention, encoded, strict=True)) for j in range(len(encoded[0]))]
    return sigmoid(dot(z, m["c"]) + float(np.ravel(m["d"])[0])), attention.index(max(attention))


def test_gated_attention_over_passages(spark):
    drawn = np.random.default_rng(2)
    n, hidden, gate = quality.FEATURES, 5, 3
    shapes = {"w": (n, hidden), "wb": hidden, "v": (hidden, gate), "vb": gate, "u": (hidden, gate), "ub": gate, "a": gate, "c": hidden, "d": 1}
    model = {k: drawn.normal(0, 1, s) for k, s in shapes.items()}
    model |= {"centre": drawn.normal(0, 0.2, n), "scale": drawn.uniform(0.5, 2, n)}
    random.seed(3)
    texts = [*TEXTS, *(" ".join(random.choices(["aa", "B!", "c", "1,2", "#"], k=random.randint(1, 400))) for _ in range(20))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    for i, text in enumerate(texts):
        x, firsts = quality.passages(pa.array([text], pa.string()))  # the features of one text alone
        score, top = quality_by_hand(x, model)
        words = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert got[i].n_passages == len(x) == max(-(-words // quality.PASSAGE), 1)
        assert got[i].score == pytest.approx(score, abs=1e-9) and got[i].top_passage == top
