import numpy as np

from lodestar.llm.suffixes import suffix_array


def test_equals_sorted_suffixes():
    r = np.random.default_rng(2)
    for k in range(400):
        t = r.integers(1, r.integers(2, 6), r.integers(0, 60))
        b = bytes(t.astype(np.uint8).tolist())
        assert suffix_array(t).tolist() == sorted(range(len(b)), key=lambda i: b[i:]), b


def test_large_symbols_and_long_repeats():
    r = np.random.default_rng(3)
    t = np.tile(r.integers(1, 1 << 40, 50), 40)
    assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
