"""Sequential and special-function kernels in numpy; each works on one source's (or one session's) few numbers."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np

EDGE = 1e-11  # days; kept in the same place and order wherever a bin's edge is made


def greedy_bins(mjds: np.ndarray, width: float, pad: float, strict: bool = True) -> np.ndarray:
    """(low, high) of bins over sorted times: each starts at the first time left and takes all within the width."""
    out, at, edge = [], 0, EDGE if strict else 0.0
    while at < len(mjds):
        low = mjds[at] - pad
        low -= edge
        right = low + width + pad
        right += edge
        last = np.searchsorted(mjds, right, side="right") - 1
        high = mjds[last] + pad
        high += edge
        out.append((low, high))
        at = np.searchsorted(mjds, high, side="right")
    return np.array(out, float).reshape(-1, 2)


def epoch_count(mjds: np.ndarray, width: float = 6.5) -> int:
    """How many epochs: a new one starts where a time is more than the width behind the epoch's first."""
    n, at = 0, 0
    while at < len(mjds):
        n += 1
        at = np.searchsorted(mjds, mjds[at] + width, side="right")
    return n


def expand_bins(bins: np.ndarray, times: np.ndarray, width: float, pad: float, strict: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bins grown to take in times, and the times that none took.

    Each time, in the order given, asks the bin that has the closest edge (the earlier bin, and its low edge, on ties).
    If that bin doesn't hold it yet, the edge moves to the time and the pad beyond, as long as the bin reaching just to
    the time would be narrower than ``width``.
    """
    grown = sorted(map(tuple, np.asarray(bins, float).tolist()), key=lambda b: b[0])
    edges = sorted((edge, k, side) for k, b in enumerate(grown) for side, edge in enumerate(b))
    slack, none = EDGE if strict else 0.0, []
    for t in map(float, times):
        above = bisect_left(edges, (t,))
        beside = edges[above : above + 1]
        if above:
            beside.append(edges[bisect_left(edges, (edges[above - 1][0],))])  # the first of equal edges below
        edge, k, side = min(beside, key=lambda e: (abs(t - e[0]), e[1:]))
        low, high = grown[k]
        if low < t < high:
            continue
        reach = abs(t - edge)
        if high - low + reach >= width:
            none.append(t)
            continue
        out = 1 if side else -1
        moved = edge + out * (reach + pad) + out * slack
        del edges[bisect_left(edges, (edge, k, side))]
        insort(edges, (moved, k, side))
        grown[k] = (low, moved) if side else (moved, high)
    return np.array(grown, float).reshape(-1, 2), np.array(none, float)


#: Rows that are factored at once.
FACTOR_ROWS = 1024
#: Scaled columns with singular values below this share of the largest are dependent.
DEPENDENT = 1e-12


def triangles(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The triangular factor R of each consecutive block of rows; no product of columns is formed.

    Blocks of like size are factored together; those of many rows piece by piece, and their factors once more.
    """
    q, sizes = rows.shape[1], np.asarray(sizes)
    while sizes.size and sizes.max() > FACTOR_ROWS:
        pieces = np.maximum(1, -(-sizes // FACTOR_ROWS))
        first = np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.arange(pieces.sum()) - first) * FACTOR_ROWS
        cut = np.minimum(FACTOR_ROWS, np.repeat(sizes, pieces) - begin)
        rows, sizes = triangles(rows, cut).reshape(-1, q), pieces * q
    out, begins = np.zeros((len(sizes), q, q)), np.cumsum(sizes) - sizes
    padded = 1 << np.ceil(np.log2(np.maximum(1, sizes))).astype(int)  # rows of zeros change no factor
    for size in np.unique(padded):
        k = np.flatnonzero((padded == size) & (sizes > 0))
        if len(k):
            at = begins[k][:, None] + np.arange(size)
            there = np.arange(size) < sizes[k][:, None]
            block = np.where(there[:, :, None], rows[np.minimum(at, len(rows) - 1)], 0.0)
            out[k, : min(size, q)] = np.linalg.qr(block, mode="r")
    return out


def merged(*factors: np.ndarray) -> np.ndarray:
    """The factor of all rows behind some factors, each (q, q) or (k, q, q)."""
    return np.linalg.qr(np.concatenate(factors, axis=-2), mode="r")


def besides_each(factors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of some factors in order: that of all before it and that of all behind it; and the one of all."""
    before, behind = np.zeros_like(factors), np.zeros_like(factors)
    for k in range(1, len(factors)):
        before[k] = merged(before[k - 1], factors[k - 1])
        behind[-k - 1] = merged(behind[-k], factors[-k])
    return before, behind, merged(before[-1], factors[-1])


def others(factors: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the factors, those of consecutive groups: the factor of all others of its group; and each group's whole.

    A tree of pairs over all groups at once: a factor's others are its neighbour and the others of their pair.
    """
    levels, sizes = [], np.asarray(sizes)
    at = factors
    while len(at) and sizes.max() > 1:
        # each group's nodes in pairs; an odd one goes up alone
        above = -(-sizes // 2)
        place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        parent = np.repeat(np.cumsum(above) - above, sizes) + place // 2
        paired = np.flatnonzero((place % 2 == 0) & (place + 1 < np.repeat(sizes, sizes)))
        up = np.empty((above.sum(), *at.shape[1:]))
        up[parent[place % 2 == 0]] = at[place % 2 == 0]
        up[parent[paired]] = merged(at[paired], at[paired + 1])
        levels.append((at, parent, paired, sizes))
        at, sizes = up, above
    whole, rest = at, np.zeros_like(at)
    for below, parent, paired, sizes in reversed(levels):
        down = rest[parent]
        top = np.repeat(sizes, sizes) == 2  # the others of a whole group are none
        for own, other in ((paired, paired + 1), (paired + 1, paired)):
            down[own] = below[other]
            more = ~top[own]
            down[own[more]] = merged(rest[parent[own[more]]], below[other[more]])
        rest = down
    return rest, whole


def projected(factors: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The factors without their first column and what it makes up of the others, and the rows that leaves.

    A column that it makes up to rounding has no content left; a first column without content takes nothing away.
    """
    rest, none = factors[:, 1:, 1:].copy(), factors[:, 0, 0] == 0
    if none.any():
        rest[none] = np.linalg.qr(factors[none][:, :, 1:], mode="r")
    made_up = np.linalg.norm(rest, axis=1) <= DEPENDENT * np.linalg.norm(factors[:, :, 1:], axis=1)
    made_up[:, -1] = False  # y is no column of the fit
    return np.where(made_up[:, None, :], 0.0, rest), n - ~none


def solved(factors: np.ndarray, n: np.ndarray, use: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """chi-squared, degrees of freedom, parameters and their errors of many fits, from the factors of [columns, y].

    Columns without content, or that others make up, count for nothing; of these the smallest parameters are taken.
    """
    p = factors.shape[-1] - 1
    use = list(range(p)) if use is None else use
    r = np.linalg.qr(factors[:, :, [*use, p]], mode="r")
    a, b, rest = r[:, : len(use), : len(use)], r[:, : len(use), len(use)], r[:, len(use), len(use)]
    scale = np.linalg.norm(a, axis=1)
    scale = np.where(scale > 0, scale, 1.0)
    u, s, vt = np.linalg.svd(a / scale[:, None, :])
    there = s > DEPENDENT * np.maximum(s[:, :1], 1e-300)
    along = np.einsum("kij,ki->kj", u, b)
    inverse = np.where(there, 1 / np.where(there, s, 1.0), 0.0)
    beta = np.einsum("kji,kj->ki", vt, along * inverse) / scale
    sigma = np.linalg.norm(vt * inverse[:, :, None], axis=1) / scale
    return rest**2 + np.where(there, 0.0, along**2).sum(axis=1), n - there.sum(axis=1), beta, sigma


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after moving the argument above seven."""
    x = np.asarray(x, float).copy()
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift[low] -= np.log(x[low])
        x[low] += 1
    z = 1 / (x * x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / x


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, on the side where that converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    a, b, x = a.copy(), b.copy(), np.clip(x, 0.0, 1.0)
    turn = x > (a + 1) / (a + b + 2)
    a2, b2, x2 = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a2 * np.log(x2) + b2 * np.log1p(-x2) + _log_gamma(a2 + b2) - _log_gamma(a2) - _log_gamma(b2)) / a2
    front = np.where((x2 <= 0) | (x2 >= 1), 0.0, front)
    tiny = 1e-300
    c = np.ones_like(x2)
    d = 1 / np.where(np.abs(1 - (a2 + b2) * x2 / (a2 + 1)) < tiny, tiny, 1 - (a2 + b2) * x2 / (a2 + 1))
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b2 - m) * x2 / ((a2 + 2 * m - 1) * (a2 + 2 * m)), -(a2 + m) * (a2 + b2 + m) * x2 / ((a2 + 2 * m) * (a2 + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h *= step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    value = front * h
    return np.where(turn, 1 - value, value)


def f_sf(f, n1, n2) -> np.ndarray:
    """Upper tail of the F distribution."""
    f = np.maximum(np.asarray(f, float), 0.0)
    return beta_inc(np.asarray(n2, float) / 2, np.asarray(n1, float) / 2, n2 / (n2 + n1 * f))


def gamma_sf(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.maximum(np.asarray(x, float), 0.0))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.where(x > 0, np.exp(a * np.log(np.where(x > 0, x, 1.0)) - x - _log_gamma(a)), 0.0)
        term, total = 1 / a, 1 / a
        for n in range(1, 2000):
            term = term * x / (a + n)
            total = total + term
            if np.all((term < total * 1e-16) | (x > a + 1)):
                break
        lower = front * total
        b = x + 1 - a
        c = np.full_like(x, 1e300)
        d = 1 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        for n in range(1, 2000):
            an = -n * (n - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
            if np.all((np.abs(d * c - 1) < 1e-15) | (x <= a + 1)):
                break
        upper = front * h
    return np.where(x <= a + 1, 1 - lower, upper)


def chi2_sf(chi2, dof) -> np.ndarray:
    return gamma_sf(np.asarray(dof, float) / 2, np.asarray(chi2, float) / 2)
