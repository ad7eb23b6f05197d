"""The registered queries against their SQL, and the pipeline against its parts done by hand."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm.test_decontaminate import brute_force as contaminated
from tests.llm.test_jaccard import shingle_set
from tickloom.llm import bpe, quality, toxicity
from tickloom.llm.queries import ORACLE, PATTERN, QUALITY_HELD_OUT, QUERIES, RANKS, TOXIC_HELD_OUT, held_out, read
from workload.oracle_check import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_as_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), QUERIES[name], ORACLE[name], sf_dir) is None


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    docs = {r.doc_id: r.text for r in read(spark, sf_dir, "documents").collect()}
    labels = read(spark, sf_dir, "labels")
    items = [tuple(r) for r in read(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    frame = lambda: spark.createDataFrame(list(kept.items()), "doc_id long, text string")

    kept = dict(docs)
    model = toxicity.train(frame(), labels, ~held_out(TOXIC_HELD_OUT))
    bad = {r.doc_id for r in toxicity.score(frame(), model).filter("score >= 0.5").collect()}
    kept = {i: t for i, t in kept.items() if i not in bad}
    model = quality.train(frame(), labels, ~held_out(QUALITY_HELD_OUT))
    good = {r.doc_id for r in quality.score(frame(), model).filter("score >= 0.5").collect()}
    kept = {i: t for i, t in kept.items() if i in good}

    sets, group = {i: shingle_set(t) for i, t in kept.items()}, {i: i for i in kept}
    ids, changed = sorted(kept), True
    links = [(i, j) for i in ids for j in ids if i < j and sets[i] & sets[j] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            if group[i] != group[j]:
                group[i] = group[j] = min(group[i], group[j])
                changed = True
    kept = {i: t for i, t in kept.items() if group[i] == i}
    dirty = {r[0] for r in contaminated(list(kept.items()), items) if r[5]}
    kept = {i: t for i, t in kept.items() if i not in dirty}

    result = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert result == {i: bpe.encode(t, RANKS, PATTERN).tobytes() for i, t in kept.items()}
    assert bad and dirty and len(docs) > len(kept) + len(bad) + len(dirty)


def test_rows_without_an_id_and_rows_that_share_one(spark, sf_dir):
    """Each row is judged by itself: copies go whatever their ids, and no clean row goes with a bad one."""
    item = read(spark, sf_dir, "benchmark").first().text
    good = " ".join(f"word{n}" for n in range(60))
    other = " ".join(f"other{n}" for n in range(60))
    kind = read(spark, sf_dir, "documents").schema
    frame = lambda *rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], kind)
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda name, *rows: sorted(((r.doc_id, r.text) for r in stages[name](spark, frame(*rows), sf_dir).collect()), key=str)
    copies = [(None, good), (None, good), (7, good), (7, good), (9, good + " end"), (7, other), (None, None), (None, ""), (8, None)]
    left = [(7, good), (7, other), (None, None), (None, ""), (8, None)]
    assert kept("ngram_jaccard", *copies) == sorted(left, key=str)
    assert kept("ngram_jaccard", (None, good), (None, good)) == [(None, good)]
    dirty = [(None, item), (7, item), (7, good), (None, other), (None, None)]
    assert kept("decontamination", *dirty) == sorted([(7, good), (None, other), (None, None)], key=str)


@pytest.mark.parametrize("number", range(4))
def test_stages_return_documents(spark, sf_dir, number):
    """Odd rows pass through every stage: null ids stay, columns are those of documents."""
    docs = read(spark, sf_dir, "documents").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (9_000, "", "en", "s", 0), (9_001, "two words", "en", "s", 9)], docs.schema)
    _, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, docs.unionByName(odd).unionByName(odd.limit(1)), sf_dir)
    assert out.columns == docs.columns
    assert out.count() <= 64
    assert stage(spark, docs.filter("false"), sf_dir).count() == 0
