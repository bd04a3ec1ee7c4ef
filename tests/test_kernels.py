import math

import numpy as np
import pytest

from pulsewright.functions import kernels


def brute_bins(mjds, width, pad):
    """Masks over what remains, as the rule is stated."""
    out, rest = [], np.sort(mjds)
    while len(rest):
        low = rest.min() - pad
        low -= 1e-11
        right = low + width + pad
        right += 1e-11
        high = rest[(low <= rest) & (rest <= right)].max() + pad
        high += 1e-11
        out.append((low, high))
        rest = rest[rest > high]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_greedy_bins(seed):
    rng = np.random.default_rng(seed)
    mjds = np.unique(50000 + np.round(rng.uniform(0, 300, 200), rng.integers(0, 5)))
    for width, pad in ((1.0, 0.0), (6.5, 0.05), (0.5, 0.3)):
        assert kernels.greedy_bins(mjds, width, pad).tolist() == [list(b) for b in brute_bins(mjds, width, pad)]


def test_greedy_edges():
    assert len(kernels.greedy_bins(np.array([50000.0, 50001.0]), 1.0, 0.0)) == 1  # exactly the width apart
    assert len(kernels.greedy_bins(np.array([50000.0, 50001.1]), 1.0, 0.0)) == 2
    assert len(kernels.greedy_bins(np.array([50000.0, 50001.0, 50001.04]), 1.0, 0.05)) == 1  # inside the right pad
    assert len(kernels.greedy_bins(np.array([]), 1.0, 0.0)) == 0


def test_epoch_count():
    assert kernels.epoch_count(np.array([0.0, 6.5, 6.6, 13.0, 13.2]), 6.5) == 3
    assert kernels.epoch_count(np.array([]), 6.5) == 0


def test_expand_bins():
    bins = np.array([[10.0, 12.0], [20.0, 22.0]])
    got, left = kernels.expand_bins(bins, np.array([12.5, 9.0, 16.0, 30.0]), 5.0, 0.1)
    assert got[0] == pytest.approx([8.9, 12.6]) and got[1] == pytest.approx([20.0, 22.0])
    assert left.tolist() == [16.0, 30.0]
    again, left = kernels.expand_bins(bins, np.array([12.05, 12.1]), 5.0, 0.1)  # the first covers the second
    assert again[0, 1] == pytest.approx(12.15) and not len(left)


def by_looking_at_all_edges(bins, times, width, pad):
    """The rule as it is stated: the closest edge of all decides, the first of equal ones."""
    bins, none = sorted([list(b) for b in bins]), []
    for t in times:
        d, k, side = min((abs(t - e), k, side) for k, b in enumerate(bins) for side, e in enumerate(b))
        if bins[k][0] < t < bins[k][1]:
            continue
        if bins[k][1] - bins[k][0] + d < width:
            bins[k][side] += (d + pad + 1e-11) * (1 if side else -1)
        else:
            none.append(t)
    return bins, none


@pytest.mark.parametrize("seed", range(12))
def test_expand_bins_asks_the_closest_edge(seed):
    rng = np.random.default_rng(seed)
    low = 50000 + np.sort(rng.choice(300, 15, replace=False)).astype(float)
    bins = np.stack([low, low + rng.uniform(0.2, 8, 15)], axis=1)  # some overlap
    times = np.round(50000 + rng.uniform(-20, 320, 150), int(rng.integers(0, 4)))
    got, left = kernels.expand_bins(bins, times, 7.0, 0.05)
    want, none = by_looking_at_all_edges(bins, times.tolist(), 7.0, 0.05)
    assert np.abs(got - np.array(want)).max() < 1e-9 and left.tolist() == none


def test_tails_at_known_values():
    assert kernels.f_sf(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-5)
    assert kernels.f_sf(3.3258, 5, 10) == pytest.approx(0.05, abs=1e-5)
    assert kernels.chi2_sf(3.8415, 1) == pytest.approx(0.05, abs=1e-5)
    assert kernels.chi2_sf(124.342, 100) == pytest.approx(0.05, abs=1e-5)
    assert kernels.chi2_sf(np.array([2.0, 9.0]), 2) == pytest.approx([math.exp(-1), math.exp(-4.5)])
    assert kernels.beta_inc(2.0, 3.0, np.array([0.0, 0.5, 1.0])) == pytest.approx([0, 0.6875, 1])
