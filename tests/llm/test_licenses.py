from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tickloom.llm import licenses as lic


def best(line, weights):
    counts = Counter(lic.tokens_of(line))
    norm = math.sqrt(sum((k * weights.idf.get(t, weights.unknown)) ** 2 for t, k in counts.items()))
    found = []
    for name, vector in weights.vectors.items():
        dot = sum(k * weights.idf.get(t, 0) * vector.get(t, 0) for t, k in counts.items())
        found.append((-round(dot / norm, 6) if norm else 0.0, name))
    return min(found)


def brute_force(rows):
    weights, own, given = lic.Weights(lic.TEMPLATES), [], {}
    for path, text, gives, _ in rows:
        found = [best(line, weights) for line in (text or "").split("\n") if re.search(lic.HINT, line)]
        found = [f for f in found if -f[0] >= lic.BOUND]
        own.append(min(found) if found else None)
        if gives and own[-1] and path is not None:
            d = path.rpartition("/")[0]
            given[d] = min(given.get(d, own[-1]), own[-1])
    out = []
    for (path, *_), o in zip(rows, own, strict=True):
        if o:
            out.append((path, o[1], o[1], "header", None))
            continue
        d = path.rpartition("/")[0] if path is not None else None
        while d and d not in given:
            d = d.rpartition("/")[0]
        out.append((path, None, given[d][1], "inherited", d) if d in given else (path, None, None, None, None))
    return sorted(out, key=repr)


def files():
    random.seed(9)
    notices = [*lic.TEMPLATES.values(), "Licensed under the apache license version 2.0", "a licence of no kind", "(c) Copyright me"]
    rows = []
    for k in range(300):
        path = "/".join(random.choices("abc", k=random.randint(0, 4)) + [f"{k}.txt"])
        text = "\n".join(random.choices(["some words here", "x" * 40, ""], k=3) + random.choices(notices, k=random.randint(0, 2)) * (k % 4 == 0))
        rows.append((path, text, k % 8 == 0, "x"))
    rows += [("a/b/LICENSE", lic.TEMPLATES["MIT"], True, "x"), ("a/b/COPYING", lic.TEMPLATES["GPL-3.0"], True, "x")]
    rows += [(None, lic.TEMPLATES["MIT"], True, "x"), (None, None, None, "x"), ("a/b/z", None, None, "x"), ("", "", True, "x")]
    return [*rows, rows[0], ("a/b/c/long", "license " * 20_000, False, "x")]


def test_as_by_hand(spark):
    rows = files()
    df = spark.createDataFrame(rows, "path string, text string, gives boolean, license string").repartition(3)
    found = lic.scan(df, F.col("gives"), kept=("path", "license"))
    got = [(r.path, r.own_license, r.license, r.origin, r.inherited_from) for r in found.collect()]
    assert sorted(got, key=repr) == brute_force(rows)
    assert {g[3] for g in got} == {None, "header", "inherited"}


def test_absolute_paths_and_empty_table(spark):
    rows = [("/a/LICENSE", lic.TEMPLATES["MIT"], True), ("/a/b/x", "none", False), ("/x", "none", False)]
    df = spark.createDataFrame(rows, "path string, text string, gives boolean")
    got = {r.path: r.inherited_from for r in lic.scan(df, F.col("gives")).collect()}
    assert got == {"/a/LICENSE": None, "/a/b/x": "/a", "/x": None}
    assert lic.scan(df.filter("false"), F.col("gives")).collect() == []


def test_full_texts_titles_and_wrapped_notices(spark):
    comment = lambda text, mark: "\n".join(f"{mark} {line}" for line in text.split("\n"))
    code = "\nint main() { return 0; }" * 40
    cases = [(f"full/{n}/LICENSE", text, True, n) for n, text in lic.TEXTS.items()] + [
        ("mit/LICENSE", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + lic.TEXTS["MIT"], True, "MIT"),
        ("bsd.c", comment(lic.TEXTS["BSD-3-Clause"], " *") + code, False, "BSD-3-Clause"),
        ("mit.c", comment(lic.TEXTS["MIT"], "//") + code, False, "MIT"),
        ("title", "# The MIT License (MIT)\n\nwords", False, "MIT"),
        ("gpl", "GNU GENERAL PUBLIC LICENSE\n    Version 3, 29 June 2007\n", False, "GPL-3.0"),
        ("spdx.c", "// SPDX-License-Identifier: MIT" + code, False, "MIT"),
        ("later.c", "/* SPDX-License-Identifier: GPL-3.0-or-later */", False, "GPL-3.0"),
        ("wrapped", "# This is licensed under the Apache\n# License, Version\n# 2.0. Nothing else" + code, False, "Apache-2.0"),
        ("inline", "a b c d e f g. Licensed under the Apache License, Version 2.0 and so on " + "more " * 40, False, "Apache-2.0"),
        ("zlib.c", "/* SPDX-License-Identifier: Zlib */", False, None),
        ("old", " Apache License\n Version 1.1\n", False, None),
        ("gpl1", "Licensed under the GNU General Public License, version 1.", False, None),
        ("prose", "the right to use a license of any kind is subject to the terms of the work " * 50, True, None),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "path string, text string, gives boolean")
    got = {r.path: r.own_license for r in lic.scan(df, F.col("gives")).collect()}
    assert got == {path: name for path, _, _, name in cases}
