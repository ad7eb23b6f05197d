"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

DataFrame functions only. A file's header lines and windows of its words around
hints, and a licence file's words as a whole, are compared with the templates
within the row, so the texts are never shuffled; only directories, which are few
beside files, meet in joins.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Mapping
from functools import partial
from pathlib import Path
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.sources.workdir import new_dir

#: Short forms of notices by identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
}
#: A line with one of these may be a notice.
HINT = r"(?i)licen[sc]e|copyright|spdx|redistribution|public domain"
TOKEN = "[a-z0-9]+"
BOUND = 0.8
#: Full texts by identifier; those of CC BY, CC BY-NC and CC BY-SA aren't there.
TEXTS = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
#: Texts of at most this many words also stand in headers.
HEADER_WORDS = 400
_GNU = (
    "This {it} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public"
    " License as published by the Free Software Foundation; either version {version} of the License, or (at your"
    " option) any later version."
)
#: Notices of headers; they may be wrapped or stand within a line.
NOTICES = [
    *TEMPLATES.items(),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in"
     " compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This file is distributed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("GPL-2.0", _GNU.format(it="program", kind="General", version="2")),
    ("GPL-3.0", _GNU.format(it="program", kind="General", version="3")),
    ("LGPL-2.1", _GNU.format(it="library", kind="Lesser General", version="2.1")),
    ("LGPL-3.0", _GNU.format(it="library", kind="Lesser General", version="3")),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]
#: Titles fill a line, or a line and the next one. Without a version they decide only where there is but one.
TITLES = [
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "License: MIT"),
    ("ISC", "ISC License"),
    ("Apache-2.0", "Apache License"),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: Words that lead to a notice; each is the anchor of the templates in which it is the rarest.
ANCHORS = "license licence licensed copyright redistribution redistribute domain permission".split()
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([^\r\n]*)"


def tokens_of(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


class Weights:
    """TF-IDF of the templates: idf = 1 + ln((1 + N) / (1 + df)), vectors of length 1."""

    def __init__(self, templates: Mapping[str, str]):
        counts = {name: Counter(tokens_of(text)) for name, text in templates.items()}
        n = len(counts)
        df = Counter(t for c in counts.values() for t in c)
        self.idf = {t: 1 + math.log((1 + n) / (1 + k)) for t, k in sorted(df.items())}
        self.unknown = 1 + math.log(1 + n)
        self.vectors = {}
        for name, c in sorted(counts.items()):
            raw = {t: k * self.idf[t] for t, k in sorted(c.items())}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            self.vectors[name] = {t: v / norm for t, v in raw.items()}


class Table:
    """A fixed map of tokens to lists of numbers, as a literal that is hashed: a map is searched from its start.

    Bind ``column`` by :func:`_let`, so that the plan holds it once.
    """

    def __init__(self, values: Mapping[str, list[float]]):
        self.slots = 2 * len(values) + 1
        slots: list[dict[str, list[float]]] = [{} for _ in range(self.slots)]
        for token, numbers in values.items():
            slots[crc32(token.encode()) % self.slots][token] = numbers
        self.column = F.from_json(F.lit(json.dumps(slots)), "array<map<string,array<double>>>")

    def of(self, token: Column, bound: Column) -> Column:
        """The token's numbers or null."""
        return bound[F.crc32(F.encode(token, "UTF-8")) % self.slots][token]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _squares(tokens: Column, idf: Callable[[Column], Column]) -> Column:
    """Squared length of the tokens' vector."""
    # runs of the sorted tokens: k equal ones add (k idf)^2, one after the other (2 k - 1) idf^2
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))

    def step(s: Column, t: Column) -> Column:
        run = F.when(s["last"] == t, s["run"] + 1).otherwise(1)
        return F.struct(t.alias("last"), run.alias("run"), (s["sum"] + (2 * run - 1) * idf(t) * idf(t)).alias("sum"))

    return F.aggregate(F.array_sort(tokens), start, step, lambda s: s["sum"])


def _scores(tokens: Column, names: list[str], weights: Weights) -> Column:
    """(loss, license) for each of many templates; ``weights`` are those of templates named by number."""
    of_token: dict[str, list[float]] = {}
    for t, idf in weights.idf.items():
        of_token[t] = [idf, *[weights.vectors[str(i)].get(t, 0.0) * idf for i in range(len(names))]]
    table = Table(of_token)

    def counted(bound: Column) -> Column:
        squares = _squares(tokens, lambda t: F.coalesce(table.of(t, bound)[0], F.lit(weights.unknown)))
        known = F.filter(F.transform(tokens, lambda t: table.of(t, bound)), lambda x: x.isNotNull())
        return F.struct(known.alias("known"), squares.alias("squares"))

    def score(x: Column) -> Column:
        def of(name: Column, i: Column) -> Column:
            dot = F.aggregate(x["known"], F.lit(0.0), lambda so_far, v: so_far + v[i + 1])
            cosine = F.when(x["squares"] > 0, F.round(dot / F.sqrt(x["squares"]), 6)).otherwise(0.0)
            return F.struct((-cosine).alias("loss"), name.alias("license"))

        return F.transform(F.array(*map(F.lit, names)), of)

    return _let(_let(table.column, counted), score)


def numbered(templates: Iterable[tuple[str, str]]) -> tuple[list[str], Weights]:
    names, texts = zip(*templates, strict=True)
    return list(names), Weights({str(i): text for i, text in enumerate(texts)})


class Notices:
    """Short templates, several of them of one licence."""

    KIND = "array<struct<license string, anchor string, before int, size int, numbers array<string>, weights map<string,double>>>"

    def __init__(self, templates: Iterable[tuple[str, str]]):
        names, weights = numbered(templates := list(templates))
        self.unknown = weights.unknown
        self.idf = Table({t: [v] for t, v in weights.idf.items()})
        rows = []
        for i, (name, text) in enumerate(templates):
            words = tokens_of(text)
            anchor = max((w for w in words if w in ANCHORS), key=lambda w: (weights.idf[w], w))
            numbers = sorted({w for w in words if w.isdigit()}) if len(words) < 100 else []
            product = {t: v * weights.idf[t] for t, v in weights.vectors[str(i)].items()}
            rows.append((name, anchor, words.index(anchor), len(words), numbers, product))
        keys = ("license", "anchor", "before", "size", "numbers", "weights")
        self.column = F.from_json(F.lit(json.dumps([dict(zip(keys, r, strict=True)) for r in rows])), self.KIND)

    def _each(self, use: Callable[[Column, Column], Column]) -> Column:
        """What ``use`` makes of each template and the weights of tokens."""
        return F.flatten(_let(self.idf.column, lambda bound: F.transform(self.column, lambda t: use(t, bound))))

    def _score(self, template: Column, tokens: Column, bound: Column) -> Column:
        """(loss, license); of templates that aren't full texts all numbers, the versions, must be there."""
        dot = F.aggregate(tokens, F.lit(0.0), partial(_add, template["weights"]))
        squares = _squares(tokens, lambda t: F.coalesce(self.idf.of(t, bound)[0], F.lit(self.unknown)))
        there = (F.size(F.array_except(template["numbers"], tokens)) == 0) & (F.size(tokens) > 0)
        cosine = F.when(there, F.round(dot / F.sqrt(squares), 6)).otherwise(0.0)
        return F.struct((-cosine).alias("loss"), template["license"].alias("license"))

    def titles(self, lines: Column) -> Column:
        """(loss, license) of lines with a hint and of each with the next line that isn't blank.

        A line before one that opens with a version counts only together with it.
        """
        full = F.filter(lines, lambda x: x.rlike("[A-Za-z0-9]"))
        both = lambda x, then: F.when(then.isNotNull(), F.concat_ws(" ", x, then))
        alone = lambda x, then: F.when(~F.coalesce(then, F.lit("")).rlike(r"(?i)^[^a-z0-9]*version\b"), x)

        def of_lines(full: Column) -> Column:
            then = lambda i: F.get(full, i + 1)
            some = F.transform(
                full, lambda x, i: F.when(x.rlike(HINT), F.array(alone(x, then(i)), both(x, then(i))))
            )
            some = F.flatten(F.filter(some, lambda x: x.isNotNull()))
            return F.transform(F.array_distinct(F.filter(some, lambda x: x.isNotNull())), line_tokens)

        return _let(
            _let(full, of_lines),
            lambda all_: self._each(lambda t, bound: F.transform(all_, lambda tokens: self._score(t, tokens, bound))),
        )

    def windows(self, tokens: Column) -> Column:
        """(loss, license) of the windows that lie around an anchor as one of the templates does.

        Each template is laid over the text at its anchor, the rarest of ANCHORS in
        it: the window has the template's number of words and the anchor at the same
        place, so line breaks and the words around don't matter. Equal windows are
        compared once.
        """
        mark = lambda t, i: F.when(t.isin(ANCHORS), F.struct(t.alias("t"), i.alias("at")))
        places = lambda t: F.filter(F.transform(t, mark), lambda x: x.isNotNull())

        def laid(x: Column, template: Column, bound: Column) -> Column:
            before, size = template["before"], template["size"]

            def cut(p: Column) -> Column:
                low = F.greatest(p["at"] - before, F.lit(0))
                return F.array_join(F.slice(x["tokens"], low + 1, p["at"] - before + size - low), " ")

            found = F.array_distinct(F.transform(F.filter(x["places"], lambda p: p["t"] == template["anchor"]), cut))
            return F.transform(found, lambda window: self._score(template, F.split(window, " "), bound))

        both = lambda t: F.struct(t.alias("tokens"), places(t).alias("places"))
        return _let(_let(tokens, both), lambda x: self._each(partial(laid, x)))


def spdx(text: Column, names: Iterable[str]) -> Column:
    """(loss, license) of the known identifiers in SPDX lines; -only, -or-later and + are no other licence."""
    known = F.create_map(*[F.lit(x) for name in names for x in (name.lower(), name)])
    said = F.regexp_extract_all(text, F.lit(SPDX), F.lit(1))
    ids = F.flatten(F.transform(said, lambda x: F.split(F.lower(x), "[^a-z0-9.+-]+")))
    plain = lambda x: F.regexp_replace(x, r"(-only|-or-later|\+)$", "")
    found = F.filter(F.transform(ids, lambda x: F.element_at(known, plain(x))), lambda x: x.isNotNull())
    return F.transform(found, lambda x: F.struct(F.lit(-1.0).alias("loss"), x.alias("license")))


def _literal(values: Mapping[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])


def _add(values: Column, so_far: Column, token: Column) -> Column:
    return so_far + F.coalesce(F.element_at(values, token), F.lit(0.0))


def line_tokens(line: Column) -> Column:
    """Runs of ASCII letters and digits, in small letters."""
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda t: t != "")


def best_template(line: Column, weights: Weights) -> Column:
    """(score, license) of the template with the highest cosine; of equal ones the first by name."""
    tokens = line_tokens(line)
    known = _literal(weights.idf)
    of = lambda t: F.coalesce(F.element_at(known, t), F.lit(weights.unknown))
    squares = _squares(tokens, of)
    scores = []
    for name, vector in weights.vectors.items():
        product = _literal({t: v * weights.idf[t] for t, v in vector.items()})
        dot = F.aggregate(tokens, F.lit(0.0), partial(_add, product))
        cosine = F.when(squares > 0, F.round(dot / F.sqrt(squares), 6)).otherwise(0.0)
        scores.append(F.struct((-cosine).alias("loss"), F.lit(name).alias("license")))
    best = F.array_min(F.array(*scores)) if len(scores) > 1 else scores[0]
    return F.struct((-best["loss"]).alias("score"), best["license"].alias("license"))


def headers(text: Column) -> Column:
    """The lines that may be notices; of a text without any, none."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(HINT))
    return F.when(whole.rlike(HINT), lines).otherwise(F.array().cast("array<string>"))


def found_in(
    text: Column,
    best: Callable[[Column], Column],
    gives: Column,
    bound: float,
    notices: list[tuple[str, str]],
    titles: list[tuple[str, str]],
    texts: Mapping[str, str],
) -> Column:
    """(loss, license) of a licence file's whole text or else of the best header; null without one."""
    enough = lambda found: F.array_min(F.filter(found, lambda x: x["loss"] <= -bound))
    loss = lambda f: F.struct((-f["score"]).alias("loss"), f["license"].alias("license"))
    short = [(name, t) for name, t in texts.items() if len(tokens_of(t)) <= HEADER_WORDS]
    known = sorted({name for name, _ in [*notices, *titles, *texts.items()]})
    around, above = Notices([*notices, *short]), Notices(titles)
    whole = F.coalesce(text, F.lit(""))
    header = F.flatten(F.array(
        F.transform(headers(text), lambda line: loss(best(line))),
        spdx(whole, known),
        above.titles(F.split(whole, "\n")),
        around.windows(line_tokens(whole)),
    ))
    header = F.when(whole.rlike(HINT), enough(header))
    if not texts:
        return header
    all_words = F.when(gives, enough(_let(line_tokens(whole), lambda t: _scores(t, *numbered(texts.items())))))
    return F.coalesce(all_words, header)


def directory(path: Column) -> Column:
    """What is before the last slash; the top directory is the empty string."""
    above = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    return F.when(path.isNotNull(), above)


def ancestors(folder: Column) -> Column:
    """The directory and all above it, the nearest first, as (up, directory)."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    lead = F.when(folder.startswith("/"), "/").otherwise("")
    up = lambda k: F.concat(lead, F.array_join(F.slice(parts, 1, F.size(parts) - k), "/"))
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda k: F.struct(k.alias("up"), F.when(k == 0, folder).otherwise(up(k)).alias("directory")),
    )


def scan(
    files: DataFrame,
    is_license_file: Column,
    templates: Mapping[str, str] = TEMPLATES,
    bound: float = BOUND,
    kept: tuple[str, ...] = ("path",),
    path_col: str = "path",
    text_col: str = "text",
    notices: Iterable[tuple[str, str]] = NOTICES,
    titles: Iterable[tuple[str, str]] = TITLES,
    texts: Mapping[str, str] = TEXTS,
) -> DataFrame:
    """One row per file: the columns ``kept``, its own notice and the licence that holds for it.

    A line with a hint is a header; its best template counts if the cosine
    reaches ``bound``, and of a file's headers the best (of equal ones the first
    by name). Headers are also SPDX lines (whose identifiers are compared as such),
    titles, and windows of the text that lie around a hint as one of ``notices``,
    or a short one of ``texts``, would. A licence file's words as a whole are
    compared with ``texts``; if one reaches ``bound``, it goes before the file's
    headers, as licences quote each other. A title without a version, of a licence
    of several, decides nothing. A file for which ``is_license_file`` holds, and which has a
    licence, gives it to its directory (of several the best, then the first by
    name). Files without an own licence get that of the nearest directory at or
    above theirs. ``origin`` is ``header``, ``inherited`` or null, and
    ``inherited_from`` the directory.

    Whole texts are searched. Null and empty texts have no header; a file with
    a null path inherits nothing; repeated rows stay; an empty table gives an
    empty one. Kept columns called like the added ones are replaced.
    """
    spark = files.sparkSession
    added = ("own_license", "own_score", "license", "origin", "inherited_from")
    names = {c: f"k{i}" for i, c in enumerate(c for c in kept if c not in added)}
    weights = Weights(templates)
    best = lambda line: best_template(line, weights)
    gives = F.coalesce(is_license_file, F.lit(False))
    rows = files.select(
        *[files[c].alias(n) for c, n in names.items()],
        directory(files[path_col]).alias("directory"),
        gives.alias("gives"),
        found_in(files[text_col], best, gives, bound, list(notices), list(titles), texts).alias("top"),
    )
    rows = rows.select(
        *names.values(), "directory", "gives", F.col("top.license").alias("own_license"), (-F.col("top.loss")).alias("own_score")
    )
    folder = new_dir(spark, "licenses")
    rows.write.parquet(f"{folder}/files")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/files")
    giving = rows.filter("gives and own_license is not null and directory is not null")
    holders = giving.groupBy("directory").agg(
        F.min(F.struct((-F.col("own_score")).alias("loss"), F.col("own_license").alias("license"))).alias("given")
    )
    needy = rows.filter("own_license is null and directory is not null").select("directory").distinct()
    paths = needy.select("directory", F.explode(ancestors(F.col("directory"))).alias("a"))
    near = (
        paths.select(F.col("directory").alias("of"), "a.up", "a.directory")
        .join(holders, "directory")
        .groupBy("of")
        .agg(F.min(F.struct("up", "directory", "given")).alias("nearest"))
        .select(F.col("of").alias("directory"), F.col("nearest.directory").alias("giver"), "nearest.given.license")
    )
    near.write.parquet(f"{folder}/directories")
    near = spark.read.schema(near.schema).parquet(f"{folder}/directories")
    own = F.col("own_license").isNotNull()
    return rows.join(near, "directory", "left").select(
        *[F.col(n).alias(c) for c, n in names.items()],
        "own_license",
        "own_score",
        F.when(own, F.col("own_license")).otherwise(F.col("license")).alias("license"),
        F.when(own, "header").when(F.col("license").isNotNull(), "inherited").alias("origin"),
        F.when(~own, F.col("giver")).alias("inherited_from"),
    )
