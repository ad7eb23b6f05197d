from __future__ import annotations

import hashlib
import random
import re

from tickloom.llm.decontaminate import contamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for window, of in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found |= of
        listed = sorted(str(x) for x in found if x is not None)
        digest = hashlib.sha256(",".join(listed).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(listed), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def data():
    random.seed(11)
    vocabulary = ["Of", "the", "Haus", "été", "9", "on", "ne", "zu"]
    say = lambda n: " ".join(random.choices(vocabulary, k=n))
    items = [(i, say(n)) for i, n in enumerate([20, 13, 14, 40, 2, 4, 5, 7])]
    items += [(20, None), (21, "?!"), (22, items[0][1]), (None, say(15)), (23, "rare"), (24, items[3][1].upper())]
    docs = [(i, say(random.randint(0, 60))) for i in range(40)]
    docs += [(50, items[0][1]), (51, f"x {items[3][1]}, y " + say(900)), (52, None), (53, ""), (54, "..."), (None, items[1][1])]
    docs += [(55, "is rare"), (56, "RARE"), (50, items[0][1]), (57, items[3][1].replace(" ", ",\n"))]
    return docs, items


def test_as_by_hand(spark):
    docs, items = data()
    left = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, words string, row int")
    right = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, contamination(left, right).collect()), key=repr) == brute_force(docs, items)


def test_empty_sides(spark):
    docs, items = data()
    none = spark.createDataFrame([], "item_id long, text string")
    left = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, contamination(left, none).collect()), key=repr) == brute_force(docs, [])
    right = spark.createDataFrame(items, "item_id long, text string")
    assert contamination(left.filter("false"), right).collect() == []
