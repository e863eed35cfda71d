"""Pairs of near hashes against all pairs, and how many candidates there are."""

import random

import pytest

from reelsift.operators import catalog


@pytest.mark.parametrize("n", [40, 3_000, 200_000, 10**7, 10**9])
def test_masks_miss_no_pair(n):
    masks = [m & (1 << 64) - 1 for m in catalog.band_masks(n, 5)]
    r = random.Random(n)
    for _ in range(2000):
        turned = sum(1 << b for b in r.sample(range(64), r.randint(0, 5)))
        assert any(turned & m == 0 for m in masks)
    assert n * len(masks) + n * n / 2 * len(masks) / 2 ** min(m.bit_count() for m in masks) <= 400 * n


def test_pairs_are_those_of_all_pairs(spark):
    r = random.Random(5)
    bits = [r.getrandbits(64) for _ in range(150)]
    bits += [b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 7))) for b in bits for _ in range(2)]
    rows = [(i, b - (1 << 64) if b >> 63 else b) for i, b in enumerate(bits)] + [(999, None)]
    first = {}
    for i, b in enumerate(bits):
        first.setdefault(b, i)
    names = sorted((i, b) for b, i in first.items())
    want = {(i, j, (b ^ c).bit_count()) for x, (i, b) in enumerate(names) for j, c in names[x + 1 :] if (b ^ c).bit_count() <= 5}
    got = catalog.hamming_pairs(spark.createDataFrame(rows, "id long, bits long"))
    assert {tuple(x) for x in got.collect()} == want and want
