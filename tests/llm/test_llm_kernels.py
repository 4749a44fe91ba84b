"""The array kernels under the repeat operators against plain loops."""

import numpy as np

from palimpsest.llm.common import hashed_words
from palimpsest.llm.repeats import smallest


def test_hashed_words_follow_split():
    texts = [b"a b", b"", b" ab a\tb\x0b\x0c\r\n", b"x" * 70_000 + b" a", b"   ", b"y z " * 40_000]
    hashes, offsets = hashed_words(texts)
    words = [t.split() for t in texts]
    assert np.diff(offsets).tolist() == [len(w) for w in words]
    flat = [w for own in words for w in own]
    by_word = {}
    for word, h in zip(flat, hashes.tolist()):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert [len(x) for x in hashed_words([])] == [0, 1]


def test_smallest_is_leftmost_by_upper_bits():
    g = np.random.default_rng(1).integers(0, 9, 300, dtype=np.uint64) << np.uint64(20)
    for width in (1, 2, 5, 9):
        brute = [i + int(np.argmin(g[i : i + width])) for i in range(len(g) - width + 1)]
        assert smallest(g, width).tolist() == brute
