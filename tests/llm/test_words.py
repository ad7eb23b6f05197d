from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm.words import ALPHANUMERIC, BLANK_SEPARATED, PIECE, column_bytes, shingles, slices, word_hashes

TEXTS = st.lists(st.none() | st.text("aB c\t\n.9é!", max_size=30), max_size=8)
PATTERNS = {"blank": (BLANK_SEPARATED, r"[^\x20\x09-\x0D]+"), "alnum": (ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_shingles_are_those_of_the_pattern(texts):
    for table, pattern in PATTERNS.values():
        hashes, firsts = word_hashes(pa.array(texts, pa.string()), table)
        expected = [re.findall(pattern, ascii_lower(t)) for t in texts]
        assert np.diff(firsts).tolist() == [len(w) for w in expected]
        flat = [w for ws in expected for w in ws]
        assert len(dict(zip(flat, hashes.tolist(), strict=True))) == len(set(hashes.tolist())) == len(set(flat))
        for k in (1, 2, 5):
            found, at = shingles(hashes, firsts, k)
            wanted = [
                [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else [] for w in expected
            ]
            assert np.diff(at).tolist() == [len(w) for w in wanted]
            flat = [s for w in wanted for s in w]
            assert len(set(flat)) == len(set(zip(flat, found.tolist(), strict=True))) == len(set(found.tolist()))


def test_a_word_longer_than_a_piece_and_its_neighbours():
    long = "x" * (2 * PIECE + 17)
    hashes, firsts = word_hashes(pa.array([f"a {long} b", long, long[:-1]]), BLANK_SEPARATED)
    assert firsts.tolist() == [0, 3, 4, 5]
    assert hashes[1] == hashes[3] != hashes[4]


def test_slices_of_a_batch_keep_all_rows():
    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "", "b" * 50, "c"])})
    parts = list(slices(batch, "text", most=12))
    assert [p.num_rows for p in parts] == [3, 1, 1]
    assert column_bytes(batch.slice(1).column(0))[1].tolist() == [0, 0, 0, 50, 51]
