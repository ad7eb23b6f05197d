from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest

from tickloom.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def plain(text):
    return np.array(bpe.encoding(RANKS, PATTERN)[0].encode_ordinary(text or ""), "<u4").tobytes()


def texts():
    random.seed(3)
    pieces = ["word", " ", "  ", "\n", "\n\n", "'ll", "'", "42", "é", "—", "日本", "...", "\t", "we're", " \n x", " "]
    made = ["".join(random.choices(pieces, k=random.randint(1, 400))) for _ in range(60)]
    return [None, "", "x" * 2000, " " * 1500 + "end", "\n" * 700, "'" * 900 + "ll", *made]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (97, 40)])
def test_chunks_give_the_ids_of_the_whole_text(spark, chunk, overlap):
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts())] + [(1, "twice " * 40, "a", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, row int")
    found = bpe.encode_texts(df, RANKS, PATTERN, chunk=chunk, overlap=overlap)
    assert found.columns == ["doc_id", "text", "row", "ids"]
    got = sorted((r.doc_id, r.text or "", r.row, bytes(r.ids)) for r in found.collect())
    assert got == sorted((i, t or "", n, plain(t)) for i, t, _, n in rows)
    for r in bpe.with_digests(found, RANKS, PATTERN).collect():
        assert bpe.decode(np.frombuffer(r.ids, "<u4"), RANKS, PATTERN) == (r.text or "").encode()
        assert r.n_tokens * 4 == len(r.ids)


def test_cuts_fall_where_the_neighbours_agree():
    text = "ab cd ef gh ij kl mn op qr st uv wx yz " * 20
    starts = list(range(0, len(text) - 30, 50))
    chunks = [text[s : s + 80] for s in starts]
    heads, tails = zip(*[bpe.borders(c, s, 50, 30, PATTERN) for s, c in zip(starts, chunks, strict=True)], strict=True)
    parts = bpe.stitch(starts, list(map(len, chunks)), heads, tails, 50)
    assert "".join(text[low:high] for _, low, high, _ in parts) == text
    assert len(parts) == len(starts) and not any(apart for *_, apart in parts)
    assert {low for _, low, *_ in parts} <= set(bpe.boundaries(text, PATTERN).tolist())


def cut(text, chunk, overlap):
    """Pieces of a text as (low, piece), and how many chunks were taken for out of step."""
    starts = list(range(0, max(len(text) - overlap, 1), chunk))
    chunks = [text[s : s + chunk + overlap] for s in starts]
    heads, tails = zip(*[bpe.borders(c, s, chunk, overlap, PATTERN) for s, c in zip(starts, chunks, strict=True)], strict=True)
    parts = bpe.stitch(starts, list(map(len, chunks)), heads, tails, chunk)
    apart = [(0, s, low, *rest) for (s, low, _, a), *rest in zip(parts, chunks, heads, tails, strict=True) if a]
    whole = [(low, text[low:high]) for _, low, high, a in parts if not a]
    return whole + [(low, piece) for _, low, piece in bpe.rejoin(iter(apart), chunk, PATTERN)], len(apart)


@pytest.mark.parametrize("run", ["x" * 10_000, "7" * 10_000, " " * 10_000, "\n" * 9_999, "'" * 10_000, "é" * 10_001])
def test_a_long_run_is_joined_and_the_cuts_go_on_behind_it(run):
    prose = "".join(random.Random(5).choices(["some ", "words ", "it's ", "42 ", "\n", "é, "], k=20_000))
    text = prose[:3001] + run + prose + run + prose
    pieces, apart = cut(text, 2048, 128)
    assert apart > 40
    assert "".join(p for _, p in pieces) == text
    assert [low for low, _ in pieces] == np.cumsum([0, *[len(p) for _, p in pieces[:-1]]]).tolist()
    assert b"".join(plain(p) for _, p in pieces) == plain(text)
    # nothing but a run that can't be cut is longer than a few chunks, and behind it the pieces are chunks again
    long = [p for _, p in pieces if len(p) > 3 * 2048]
    assert len(long) <= 2 and all(run in p for p in long)
    assert len(pieces) > len(text) / (3 * 2048) - 2 * len(run) / 2048


def test_drawn_texts_of_runs():
    draw = random.Random(11)
    for _ in range(150):
        runs = ["a", "7", " ", "\n", "'", "é", "!", "\t", "a b", "'s ", " \n"]
        text = "".join(draw.choice(runs) * draw.choice([1, 2, 3, 5, 50, 400]) for _ in range(draw.randint(1, 40)))
        pieces, _ = cut(text, draw.choice([32, 64, 99, 300]), draw.choice([4, 8, 31]))
        assert "".join(p for _, p in pieces) == text
        assert b"".join(plain(p) for _, p in pieces) == plain(text)


def test_a_run_in_a_table(spark):
    prose = "some words, it's 42\n" * 3000
    rows = [(1, prose + "x" * 40_000 + prose), (2, prose), (3, "7" * 50_000 + prose), (3, "7" * 50_000 + prose)]
    found = bpe.encode_texts(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, PATTERN)
    assert sorted((r.doc_id, bytes(r.ids)) for r in found.collect()) == sorted((i, plain(t)) for i, t in rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_texts(df, RANKS, PATTERN).collect() == []
