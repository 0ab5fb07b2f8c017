"""Signatures of gram sets: bounds that never lose a link, at every length."""

import numpy as np
import pytest

from loomwright.llm.ngram_join import SIGNATURE_LONGS, Threshold, folded, signature, unlike


@pytest.mark.parametrize(("size", "changed"), [(1, 0), (40, 3), (1024, 1024), (1030, 90), (1500, 300), (9000, 800), (70000, 7000)])
def test_signatures_never_count_more_than_the_difference(size, changed):
    random = np.random.default_rng(size)
    one = random.integers(0, 1 << 63, size, dtype=np.uint64)
    other = np.concatenate([one[changed:], random.integers(0, 1 << 63, 2 * changed, dtype=np.uint64)])
    apart = len(np.setxor1d(one, other))
    x, y = signature(one), signature(other)
    assert unlike(x.tobytes(), y.tobytes()) <= apart
    assert np.bitwise_count(folded(x) ^ folded(y)).sum() <= apart
    assert len(folded(x)) == SIGNATURE_LONGS and 64 * len(x) >= 2 * size


def test_long_sets_without_common_grams_are_told_apart():
    random = np.random.default_rng(1)
    one, other = (random.integers(0, 1 << 63, 20000, dtype=np.uint64) for _ in range(2))
    room = 40000 - 2 * Threshold(80).overlap(20000, 20000)
    assert np.bitwise_count(folded(signature(one)) ^ folded(signature(other))).sum() <= room
    assert unlike(signature(one).tobytes(), signature(other).tobytes()) > room
