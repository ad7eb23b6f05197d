from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tickloom.llm import repeats
from tickloom.llm.automaton import SuffixAutomaton

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(docs, window):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                run = tuple(w[k : k + window])
                first[run] = min(first.get(run, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(removal):
    return sorted(map(tuple, removal.summary().drop("removed").collect()), key=str)


def corpus():
    random.seed(13)
    word = lambda: random.choice(["ab", "Ab", "çd", "e,", "f", "g", "h", "i", "j", "k"])
    text = lambda n: [word() for _ in range(n)]
    passages = [text(random.choice([10, 11, 15, 40])) for _ in range(12)]
    docs = []
    for i in range(150):
        parts = []
        for _ in range(random.randint(0, 4)):
            parts += text(random.randint(0, 12))
            p = random.choice(passages)
            low = random.randint(0, 5)
            parts += p[low : random.randint(low, len(p))] if random.random() < 0.5 else p
        docs.append((i, random.choice([" ", "\n", " \t "]).join(parts)))
    docs += [(200 + i, docs[3][1]) for i in range(20)]
    docs += [(300, None), (301, ""), (302, " \n "), (None, docs[3][1]), docs[5], docs[5], (7, docs[9][1])]
    docs += [(400, " ".join(["aa"] * 500)), (401, "x " + " ".join(["aa"] * 30)), (402, " ".join(text(5000) + passages[0]))]
    return docs


@pytest.mark.parametrize(("window", "anchor", "shard", "stream"), [(10, 3, 1 << 16, 1 << 20), (10, 8, 60, 200), (4, 1, 300, 50)])
def test_as_all_windows(spark, window, anchor, shard, stream):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, key int, marks string").repartition(4)
    removal = repeats.remove(df, window, anchor, shard_words=shard, stream_words=stream)
    assert got(removal) == brute_force(docs, window)
    texts = {(r.doc_id, r.text) for r in removal.texts(df).collect()}
    assert removal.texts(df).columns == df.columns and len(texts) <= len(docs)
    again = {r.doc_id: r.removed for r in removal.summary().collect() if r.n_removed}
    by_id = dict(docs)
    for doc, spans in again.items():
        words = WORD.findall(by_id[doc])
        for s in reversed(spans):
            assert s["last"] - s["first"] + 1 >= window
            del words[s["first"] : s["last"] + 1]
        assert (doc, " ".join(words)) in texts or doc in (5, 7)


def test_empty(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert got(repeats.remove(df.filter("false"))) == []
    single = df.filter("doc_id = 400")
    assert got(repeats.remove(single)) == brute_force([d for d in corpus() if d[0] == 400], 50)


def test_matching_statistics():
    random.seed(3)
    pieces = [[random.choice([b"a", b"b", b"c"]) for _ in range(random.randint(1, 30))] for _ in range(40)]
    automaton = SuffixAutomaton()
    for n, piece in enumerate(pieces):
        automaton.add(piece, 100 - n)
    automaton.close()
    holds = {}
    for n, piece in enumerate(pieces):
        for a in range(len(piece)):
            for b in range(a + 1, len(piece) + 1):
                run = tuple(piece[a:b])
                holds[run] = min(holds.get(run, 100 - n), 100 - n)
    asked = [random.choice([b"a", b"b", b"c", b"d"]) for _ in range(400)]
    for most in (3, 6, 1000):
        for n, (length, least) in enumerate(automaton.matches(asked, most)):
            longest = max((k for k in range(min(most, n + 1) + 1) if k == 0 or tuple(asked[n + 1 - k : n + 1]) in holds))
            assert length == longest
            if length:
                assert least == holds[tuple(asked[n + 1 - length : n + 1])]


def test_windows_carry_the_shard_of_their_anchor(spark):
    """Not the anchor itself, which takes eight bytes a word in the shuffle; a window's shard is its stretch's."""
    docs = [(i, i, t) for i, t in corpus() if i is not None and t]
    frame = spark.createDataFrame(docs, "doc_id long, key long, text string")
    marks = repeats.described(frame, 8, 3).withColumnRenamed("anchors", "marks").drop("n_words", "digest")
    candidates = frame.dropDuplicates(["doc_id", "key"]).join(marks.dropDuplicates(["doc_id", "key"]), ["doc_id", "key"])
    found = repeats.windows_of(candidates, 7, 8, 3)
    assert dict(found.dtypes) == {"hash": "bigint", "shard": "int", "doc_id": "bigint", "key": "bigint", "at": "int"}
    windows = {(r.doc_id, r.key, r.at): r.shard for r in found.collect()}
    assert set(windows.values()) == set(range(7))
    pieces = repeats.stretches(candidates.withColumn("firsts", F.lit(None).cast("array<int>")), 7, 8, 3)
    for r in pieces.collect():
        for n in range(len(bytes(r.words).split()) - 7):
            assert windows[(r.doc_id, r.key, r.at + n)] == r.shard
