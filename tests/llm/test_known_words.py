"""Words of a batch are coded once each, and 16-bit sums give the same fingerprints."""

import numpy as np
import pytest

from sparkalogue.llm import decontaminate as d

TEXTS = ["One  two\tTWO\n", None, "", " \x0b\x0c\r ", "İstanbul été x  y\x1cz\x85q", "a" * 5000 + " b"]


def test_coded_words_are_the_words():
    coded, sizes = d.coded_words(TEXTS)
    want = [d.words_of(t) for t in TEXTS]
    assert sizes.tolist() == [len(w) for w in want]
    assert [w.encode() for w in coded.to_pylist()] == [w for ws in want for w in ws]


def test_known_words_keep_their_rows():
    known = d.KnownWords()
    coded, _ = d.coded_words(["x y z", "z w"])
    rows = known.numbered(coded.dictionary)
    assert np.array_equal(known.table[rows], d.bit_table([w.encode() for w in coded.dictionary.to_pylist()]))
    assert np.array_equal(known.numbered(coded.dictionary), rows)


@pytest.mark.parametrize("window", [1, 40, 2730])
def test_sixteen_bits_suffice(window):
    rows = np.full((9000, 64), 12, dtype=np.int8)
    rows[::3, :32] = -12
    starts = np.arange(0, len(rows) - window, 7)
    small, large = d.running_sums(rows, window), d.running_sums(rows)
    assert (small.dtype, large.dtype) == (np.int16, np.int32)
    assert np.array_equal(d.fingerprints(small, window, starts), d.fingerprints(large, window, starts))
