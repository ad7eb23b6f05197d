from __future__ import annotations

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import jaccard
from tickloom.llm.components import components as connected
from tickloom.sources.workdir import new_dir


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_force(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            same = i is not None and i == j
            if same or (a and i is not None and j is not None and 4 * len(a & b) >= 3 * len(a | b)):
                parent[find(x)] = find(y)
    out = []
    for x, (i, a) in enumerate(sets):
        ids = [sets[y][0] for y in range(len(sets)) if find(y) == find(x) and sets[y][0] is not None]
        if i is None:  # nobody's: an equal text's component, if there is one
            equal = [y for y, (j, b) in enumerate(sets) if j is not None and a and a == b]
            ids = [sets[y][0] for e in equal for y in range(len(sets)) if find(y) == find(e) and sets[y][0] is not None]
        out.append((i, len(a), min(ids) if ids else None))
    return sorted(out, key=repr)


def rows():
    random.seed(5)
    vocabulary = [f"w{k}" for k in range(400)]
    say = lambda n: random.choices(vocabulary, k=n)

    def edited(words, k):
        words = list(words)
        for _ in range(k):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        return words

    passage, base, other = say(60), say(150), say(80)
    docs = [" ".join(say(random.randint(1, 120))) for _ in range(60)]
    docs += [" ".join(edited(base, random.randint(0, 4))) for _ in range(90)]  # a large group of near copies
    docs += [" ".join(edited(other, random.randint(1, 2))) for _ in range(15)]
    docs += [" ".join([*passage, *say(random.randint(5, 90))]) for _ in range(60)]  # a passage that many share
    chain = say(100)
    for _ in range(12):
        docs.append(" ".join(chain))
        chain = [*chain[3:], *say(3)]
    docs += [docs[0]] * 20 + ["", None, "  \n", "one", "One", "one two three four", "a b c d e", "A b c d E"]
    out = list(enumerate(docs))
    random.shuffle(out)
    return [*out, (3, docs[3]), (None, docs[0]), (None, None), (None, "nobody else says this at all")]


def test_components_are_those_of_all_pairs(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "doc_id long, text string, n int, token string").repartition(5)
    found = sorted(map(tuple, jaccard.components(df).collect()), key=repr)
    assert found == brute_force(data)


def test_every_path_finds_the_same(spark, monkeypatch):
    """Without hub rounds all pairs go through the bounds; with small blocks long lists are split."""
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "LEAST_LONG", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    found = sorted(map(tuple, jaccard.components(df, hub_rounds=1).collect()), key=repr)
    assert found == brute_force(data)


def test_empty_table(spark):
    assert jaccard.components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.lists(st.sets(st.integers(0, 60), min_size=1), min_size=1, max_size=8))
def test_divide_skip(query, members):
    array = lambda s: np.array(sorted(s), np.uint64)
    found = jaccard.divide_skip(array(query), [array(m) for m in members])
    assert found.tolist() == [4 * len(query & m) >= 3 * len(query | m) for m in members]


def test_connected(spark):
    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 480)]
    df = spark.createDataFrame([*edges, (None, 3), (5, None)], "a long, b long")
    roots = {r.node: r.root for r in connected(df, new_dir(spark, "test")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {x: roots.get(x, x) for x in label} == label


def test_near_copies_and_a_passage_make_few_pairs(spark, monkeypatch):
    """What hubs leave to be compared pair by pair follows the rows of a group, not their square."""
    random.seed(8)
    say = lambda n: [f"w{random.randrange(5000)}" for _ in range(n)]
    base, passage, docs = say(150), say(60), []
    for _ in range(150):  # few are near enough to a copy that is chosen blindly
        words = list(base)
        for k in random.sample(range(150), random.randint(0, 8)):
            words[k] = say(1)[0]
        docs.append(" ".join(words))
    docs += [" ".join([*passage, *say(random.randint(40, 120))]) for _ in range(20)]
    data = list(enumerate(docs))
    random.shuffle(data)
    made, remaining = [], jaccard._remaining_pairs
    monkeypatch.setattr(jaccard, "_remaining_pairs", lambda rest: made.append(remaining(rest)) or made[-1])
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, jaccard.components(df).collect()), key=repr) == brute_force(data)
    many = sum(pairs.count() for pairs in made)
    assert many <= 2 * len(data), many
