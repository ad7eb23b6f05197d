from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import quality, toxicity
from tickloom.llm.sample import remainder

VOCABULARY = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("an", "el", "ir", "os", "un")]
BAD = ["zorg", "blyt", "vexom"]


def prose(n):
    words = random.choices(VOCABULARY, k=n)
    return " ".join(w + ("." if random.random() < 0.15 else "") for w in words)


@pytest.fixture(scope="module")
def tables(spark):
    random.seed(8)
    docs, labels = [], []
    for i in range(900):
        toxic, good = int(random.random() < 0.3), int(random.random() < 0.7)
        sentences = [prose(random.randint(4, 12)) + "." for _ in range(random.randint(1, 12))]
        if toxic:
            k = random.randrange(len(sentences))
            sentences[k] = f"{prose(3)} {random.choice(BAD)} {prose(2)}."
        text = " ".join(sentences)
        if not good:
            text += "\n" + random.choice(["BUY!! NOW!! ", "a | b | c | ", "same same same same "]) * 20
        docs.append((i, text, "x", 0.5))
        labels.append((i, good, toxic))
    odd = [(1000, None), (1001, ""), (1002, "..!\n"), (None, "zorg."), (1003, "word"), (1004, "long " * 60_000), (0, docs[0][1])]
    docs += [(i, t, "x", 0.5) for i, t in odd]
    labels += [(None, 1, 1), (1003, None, 0), (0, 1, None), (5000, 1, 1), (1, labels[1][1], labels[1][2])]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, weight string, score double").repartition(4),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_documents(spark, tables, module, label):
    docs, labels = tables
    seen = F.coalesce(remainder(F.col("doc_id"), 5) != 0, F.lit(True))
    model = module.train(docs, labels, seen)
    scores = module.score(docs, model).cache()
    assert scores.count() == docs.count()
    assert scores.filter("score is null or score < 0 or score > 1 or isnan(score)").count() == 0
    held = scores.filter(~seen & (F.col("doc_id") < 900)).join(labels.filter(F.col(label).isNotNull()), "doc_id")
    right = held.filter((F.col("score") >= 0.5) == (F.col(label) == 1)).count()
    assert right >= 0.95 * held.count() > 100
    again = module.score(docs, module.train(docs, labels, seen))
    assert sorted(map(repr, again.select("doc_id", "score").collect())) == sorted(
        map(repr, scores.select("doc_id", "score").collect())
    )


def test_offending_sentences_are_found(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels, F.lit(True))
    rows = toxicity.score(docs.filter("doc_id < 900"), model, ["doc_id", "text"]).join(labels, "doc_id").filter("toxic = 1").collect()
    spots = [(r.text.encode()[s.start : s.end].decode(), r) for r in rows for s in r.offending]
    assert sum(any(b in text for b in BAD) for text, _ in spots) >= 0.9 * len(spots)
    assert len({r.doc_id for _, r in spots}) >= 0.9 * len(rows)


def test_columns_that_clash_and_empty_tables(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels, F.lit(True))
    kept = toxicity.score(docs, model, docs.columns)
    assert kept.columns == ["doc_id", "text", "weight", "score", "offending"]
    assert toxicity.score(docs.filter("false"), model).collect() == []
    none = labels.filter("false")
    for module in (toxicity, quality):
        untrained = module.score(docs, module.train(docs, none, F.lit(True)))
        assert untrained.filter("score between 0 and 1").count() == docs.count()


def test_noisy_or():
    texts = pa.array(["One two. Three!", None, "..", "a"])
    places, words, firsts, starts, ends = toxicity.sentences(texts)
    assert places.shape == (4, 3)
    assert firsts.tolist() == [0, 2, 2, 2, 3]
    assert (starts.tolist(), ends.tolist()) == ([0, 9, 0], [7, 14, 1])


def test_passages():
    x, firsts = quality.passages(pa.array(["a " * 130, None, "A!"]))
    assert firsts.tolist() == [0, 3, 4, 5]
    assert x[:, len(quality.CLASSES) + 5].round(3).tolist() == [1.0, 1.0, round(2 / 64, 3), 0.0, round(1 / 64, 3)]
