"""Numpy kernels against the plain definitions."""

import re

import numpy as np
import pyarrow as pa
import pytest

from textmill.llm import kernels as K
from textmill.llm.induced import END, SHIFT, Sorter

TEXTS = ["", " ", "one", " a  b\tc\n", "é ü x y", "x" * 300, "the cat " * 40, "a\x0bb\x0cc\r\nd"]


def test_words_match_the_pattern():
    data, offsets = K.buffers(pa.array([*TEXTS, None]))
    start, end, rows = K.words(data, offsets)
    for i, text in enumerate([*TEXTS, ""]):
        want = re.findall(rb"[^\x20\x09-\x0d]+", text.encode())
        assert [data[a:b].tobytes() for a, b in zip(start[rows[i] : rows[i + 1]], end[rows[i] : rows[i + 1]])] == want


def test_buffers_take_slices_and_nulls():
    data, offsets = K.buffers(pa.array(["ab", None, "c", "dd"]).slice(1, 3))
    assert [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])] == [b"", b"c", b"dd"]
    assert list(K.buffers(pa.array([], pa.string()))[1]) == [0]


@pytest.mark.parametrize("letters", [1, 2, 20])
def test_equal_windows_share_their_gram(letters):
    rng = np.random.default_rng(letters)
    rows = [rng.integers(0, letters, n).astype(np.uint8) for n in (0, 5, 19, 20, 21, 200, 333)]
    data, offsets = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    g = K.super_grams(data, offsets, 20, 8)
    seen, covered = {}, []
    for row, first, n, gram in zip(g["row"], g["first"], g["n"], g["gram"]):
        for p in range(first, first + n):
            covered.append((row, p))
            assert seen.setdefault(rows[row][p : p + 20].tobytes(), gram) == gram
    assert sorted(covered) == [(i, p) for i, r in enumerate(rows) for p in range(len(r) - 19)]
    wholes = {}
    for row, first, n, whole in zip(g["row"], g["first"], g["n"], g["whole"]):
        assert wholes.setdefault(whole, rows[row][first : first + n + 19].tobytes()) == rows[row][first : first + n + 19].tobytes()


def test_merged_ranges():
    a, b = K.merged(np.array([5, 0, 2, 9]), np.array([7, 3, 5, 10]))
    assert list(zip(a, b)) == [(0, 7), (9, 10)]


@pytest.mark.parametrize("memory", [64, 1 << 28])
@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_induced_sorting_gives_suffix_array_and_prefixes(letters, memory, tmp_path):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 3, 50, 400):
        text = np.append(rng.integers(0, letters, n) + SHIFT, END).astype(np.uint16)
        order, prefix = Sorter(text, 30, memory, str(tmp_path)).run()
        keys = [tuple(text[i : i + 30].tolist()) for i in order]
        assert sorted(order.tolist()) == list(range(n + 1)) and keys == sorted(keys)
        for i in range(1, n + 1):
            same = next((k for k, (x, y) in enumerate(zip(keys[i - 1], keys[i])) if x != y), min(len(keys[i - 1]), len(keys[i])))
            assert prefix[i] == min(same, 30)
