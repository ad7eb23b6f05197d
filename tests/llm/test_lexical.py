from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from tickloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(SMALL) for t in TERM.findall(text or "")]


def brute_force(docs, items, k):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n_docs, length = len(tf), sum(c.total() for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        found = []
        for doc, c in tf:
            m = 100 - 50 + (50 * c.total() * n_docs) // length
            score = 0
            for t in own & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0 and doc is not None:
                found.append((-score, doc))
        out += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def corpus():
    random.seed(11)
    words = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 3))) for _ in range(150)]
    odds = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(random.choices(words, odds, k=random.randint(1, 60)))) for i in range(500)]
    docs += [(500 + i, docs[3][1]) for i in range(80)]  # ties
    docs += [(700, None), (701, ""), (702, "-- !!"), (None, docs[3][1]), docs[3], docs[3]]
    docs += [(703, "ÀB,Cd_e1 " + " ".join(words) * 40), (704, "zz")]
    items = [(i, " ".join(random.choices(words, odds, k=random.choice([2, 10, 120])))) for i in range(30)]
    items += [(30, None), (31, "..."), (32, "nowhere_at-all"), (None, "a b"), (33, "ZZ zz"), (33, "àb Àb"), items[0]]
    return docs, items


def frames(spark, docs, items):
    docs = [(i, t, "x", 1) for i, t in docs]
    items = [(i, t, 2) for i, t in items]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, item_id string, score int").repartition(5),
        spark.createDataFrame(items, "item_id int, text string, doc_id int"),
    )


def test_as_all_scores(spark):
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    expected = brute_force(docs, items, 10)
    assert sorted(map(tuple, lexical.rank(d, i, 10).collect())) == expected
    blocks = lexical.rank(d, i, 10, block_terms=200)
    assert sorted(map(tuple, blocks.collect())) == expected


def test_empty_tables(spark):
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    assert lexical.rank(d.filter("false"), i).collect() == []
    assert lexical.rank(d, i.filter("false")).collect() == []
    one = lexical.rank(d.filter("doc_id = 704"), i.filter("item_id = 33")).collect()
    assert sorted(map(tuple, one)) == brute_force([(704, "zz")], [(33, "ZZ zz"), (33, "àb Àb")], 50)


def test_long_text(spark):
    docs = [(1, "a b " * 300_000 + "rare"), (2, "a b"), (3, "c"), (4, "rare c"), (5, "c c")]
    items = [(1, "rare b")]
    d, i = frames(spark, docs, items)
    assert sorted(map(tuple, lexical.rank(d, i, 3).collect())) == brute_force(docs, items, 3)


def test_masks_are_left_out():
    """Groups below the worst place are not evaluated, and nothing is lost."""
    drawn = np.random.default_rng(5)
    n, vocabulary = 3000, 100
    held = [np.sort(drawn.choice(vocabulary, 8, replace=False)) for _ in range(n)]
    offsets, flat = np.arange(0, 8 * n + 1, 8), np.concatenate(held)
    tfs = drawn.integers(1, 4, len(flat))
    asked = lexical.Asked([np.arange(0, 70)], [np.arange(1, 71) ** 2], n, 8 * n)
    segment = lexical.Segment(np.full(n, 8), offsets, flat, tfs, asked)
    ranking = lexical.Ranking(asked, vocabulary, 5)
    ranking.add(segment, np.arange(n))
    weight = np.append(asked.weights[0], np.zeros(30, np.int64))
    full = np.add.reduceat(weight[flat] * segment.impacts, offsets[:-1])
    best = np.lexsort((np.arange(n), -full))[:5]
    assert ranking.ids[0].tolist() == best.tolist() and ranking.scores[0].tolist() == full[best].tolist()
    assert ranking.left_out > 0 and ranking.evaluated < n / 2
