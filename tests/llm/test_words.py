"""Hashes of words and windows, also of sequences made to cancel out in sums of powers."""

import random

import numpy as np
import pytest
from tests.llm import brute

from lodestar.llm import near_duplicates as N
from lodestar.llm import substrings as S
from lodestar.llm import words as W

ROWS = "doc_id bigint, text string"


def thue_morse(n, a, b):
    return [(a, b)[bin(i).count("1") & 1] for i in range(n)]


def test_words_are_those_of_the_pattern():
    data = "a  b\tc\nd\x0be\x0cf\rg\x1ch\x85i\xa0j é".encode()
    starts, ends = W.spans(data)
    assert [data[a:b] for a, b in zip(starts, ends, strict=True)] == data.split() == [x.encode() for x in brute.WORD.findall(data.decode())]
    assert len(W.word_hashes(data)) == len(starts)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 6, 7, 20, 33])
def test_equal_windows_alone_have_equal_hashes(size):
    random.seed(size)
    words = [random.choice("ab") for _ in range(400)]
    hashes = W.word_hashes(" ".join(words).encode())
    found = W.window_hashes(hashes, size)
    by = {}
    for i, h in enumerate(found.tolist()):
        assert by.setdefault(h, tuple(words[i : i + size])) == tuple(words[i : i + size])
    assert len(set(found.tolist())) == len({tuple(words[i : i + size]) for i in range(len(found))})
    at = np.arange(len(found))
    again = W.stretch_hashes(hashes, at, at + size).tolist()
    assert len(set(zip(again, found.tolist(), strict=True))) == len(set(again)) == len(set(found.tolist()))
    assert len(W.window_hashes(hashes[: size - 1], size)) == 0


def test_stretches_of_many_lengths():
    words = W.word_hashes(b"x y " * 60)
    starts = np.array([0, 2, 1, 0, 3, 90])
    ends = np.array([7, 9, 8, 120, 35, 120])
    got = W.stretch_hashes(words, starts, ends).tolist()
    assert got[0] == got[1] != got[2] and len(set(got)) == 5
    pairs = W.stretch_pairs(W.word_pairs(b"x y " * 60), starts, ends)
    assert pairs.shape == (6, 2) and len(set(map(tuple, pairs.tolist()))) == 5
    assert len(W.stretch_hashes(words, starts[:0], ends[:0])) == len(W.stretch_pairs(words, starts[:0], ends[:0])) == 0


@pytest.mark.parametrize("n", [1024, 4096])
def test_thue_morse_letters_and_words(spark, n):
    """Polynomials with powers of any odd base, modulo 2**64, take these strings for equal."""
    one, other = "".join(thue_morse(n, "a", "b")), "".join(thue_morse(n, "b", "a"))
    tail = " ".join(f"w{i}" for i in range(19))
    docs = {1: f"{one} {tail}", 2: f"{other} {tail}", 3: one, 4: other, 5: " ".join(thue_morse(n, "x", "y")), 6: " ".join(thue_morse(n, "y", "x"))}
    frame = spark.createDataFrame(list(docs.items()), ROWS)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.substring_dedup(frame).collect()} == brute.substring(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(frame, 85).collect()} == brute.near(docs)
