from __future__ import annotations

import itertools

import pytest

from tests.llm.test_jaccard import brute_force, rows, shingle_set
from tickloom.llm import jaccard


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string").repartition(4)


def degrees(data):
    sets = [(i, shingle_set(t)) for i, t in data]
    similar = lambda a, b: bool(a) and 4 * len(a & b) >= 3 * len(a | b)
    out = []
    for x, (i, a) in enumerate(sets):
        others = [y for y, (j, b) in enumerate(sets) if y != x and j is not None and similar(a, b)]
        out.append((i, len(a), len(others) if i is not None else 0))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "shingles_"), [(8, 1 << 20), (1024, 1 << 20), (1024, 700)])
def test_every_link_is_found(spark, monkeypatch, block, shingles_):
    monkeypatch.setattr(jaccard, "LEAST_LONG", 2)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", shingles_)
    data = rows()
    found = jaccard.join(frame(spark, data))
    all_ = found.documents().collect()
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in all_), key=repr) == degrees(data)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in all_), key=repr) == brute_force(data)


def test_pairs_and_the_parts_of_the_answer(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    data = rows()
    found = jaccard.join(frame(spark, data))
    got = sorted(((r.doc_id, r.n_shingles, r.n_links) for r in found.linked().collect()), key=repr)
    assert got == degrees(data)
    assert sorted(map(tuple, found.components().collect()), key=repr) == brute_force(data)
    pairs = [tuple(r) for r in found.pairs().collect()]
    sets = {frozenset(shingle_set(t)) for i, t in data if i is not None} - {frozenset()}
    links = sum(4 * len(a & b) >= 3 * len(a | b) for a, b in itertools.combinations(sets, 2))
    assert len(pairs) == len(set(pairs)) == links
    assert all(a < b for a, b in pairs)


def test_no_rows(spark):
    found = jaccard.join(spark.createDataFrame([], "doc_id long, text string"))
    assert found.linked().collect() == found.components().collect() == found.pairs().collect() == []
    assert found.documents().collect() == []


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_ids_that_no_two_rows_share(spark, monkeypatch, kind):
    monkeypatch.setattr(jaccard, "LEAST_LONG", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    texts = [t for i, t in rows() if i is not None]
    data = [(k - 50 if kind != "string" else f"{k:04}", t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(data, f"doc_id {kind}, text string").repartition(4)
    found = jaccard.join(df)
    assert found.rows.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    all_ = found.documents().collect()
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in all_), key=repr) == degrees(data)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in all_), key=repr) == brute_force(data)
