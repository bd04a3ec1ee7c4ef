"""Embedding whitening by contour integration (FEAST).

One pass sums the integer entries and their products exactly, so the covariance is known to the last bit whatever the
number of rows and however they are dealt. Its size follows the width of the vectors only, and the driver solves it: the
wanted end of the spectrum is cut into intervals at wide gaps, which inertia counts find. For each interval a quadrature
of complex shifted solves around it projects random vectors onto its eigenspace, Rayleigh-Ritz extracts the components,
and this repeats until the residuals are at rounding level. The inertia count of the interval tells how many components
there have to be, so none is missed. A second pass sums products of the whitened rows, to state how far from the identity
their covariance is; the third one writes them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewright.llm.vectors import floored, kept_vectors

FACTOR, COMPONENTS = 64, 32
#: Eigenvalues that an interval is meant to hold, and quadrature points of its half circle.
EACH, POINTS = 16, 12
#: Eigenvalues below this share of the trace are zero to double precision: nothing can be divided by their roots.
ZERO = 1e-13
#: Sums of products below this are exact as doubles.
EXACT = 1 << 52


@dataclass(frozen=True)
class Whitening:
    """``components`` has a column for each eigenvector; ``sums`` are those of floor(64 * entry)."""

    n: int
    width: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y in Python's integers."""
    most = max(1, int(np.abs(y).max(initial=0)))
    if most * most > EXACT:
        exact = y.astype(object)
        return exact.T @ exact
    total, step = np.zeros((y.shape[1],) * 2, object), EXACT // (most * most)
    for at in range(0, len(y), step):
        part = y[at : at + step].astype(float)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _moments(vectors: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """How many vectors, their sums and their sums of products, all exact."""
    upper = np.triu_indices(width)

    def add(batches):
        n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            y = floored(batch.column(0), width, FACTOR)
            n += len(y)
            sums += y.sum(axis=0).astype(object)
            products += exact_products(y)
        values = [n, *sums, *products[upper]]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(map(Decimal, values), pa.decimal128(38, 0))], ["place", "value"])

    summed = vectors.select("vector").mapInArrow(add, "place int, value decimal(38,0)").groupBy("place").agg(F.sum("value").alias("value"))
    values = [int(r.value) for r in summed.orderBy("place").collect()]  # 1 + width + width * (width + 1) / 2 rows
    products = np.zeros((width, width), object)
    products[upper] = values[1 + width :]
    products.T[upper] = values[1 + width :]
    return values[0], values[1 : 1 + width], products


def inertia(a: np.ndarray) -> tuple[int, int]:
    """How many eigenvalues of a symmetric matrix are negative and positive, by elimination with one- and two-row pivots."""
    a = a.copy()
    negative = positive = 0
    bound = (1 + np.sqrt(17)) / 8
    while len(a):
        diagonal, off = np.abs(a.diagonal()), np.abs(np.tril(a, -1))
        k = int(diagonal.argmax())
        i, j = divmod(int(off.argmax()), len(a))
        if max(diagonal[k], off[i, j]) == 0:
            break
        pivots = [k] if diagonal[k] >= bound * off[i, j] else [j, i]
        block = a[np.ix_(pivots, pivots)]
        signs = np.sign(block[0, 0]) if len(pivots) == 1 else np.array([-1, 1])  # off the diagonal is larger: one of each sign
        negative += int((signs < 0).sum())
        positive += int((signs > 0).sum())
        rest = np.setdiff1d(np.arange(len(a)), pivots)
        side = a[np.ix_(rest, pivots)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return negative, positive


class Spectrum:
    """Counts of the eigenvalues of ``v`` above a shift, each found once, and intervals whose ends stand in gaps."""

    def __init__(self, v: np.ndarray):
        self.v, self.top = v, float(np.abs(v).sum(axis=1).max()) * (1 + 1e-12)
        self.known: dict[float, int] = {}

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = inertia(self.v - shift * np.eye(len(self.v)))[1]
        return self.known[shift]

    def bracket(self, k: int, share: float = 1e-4) -> tuple[float, float]:
        """Shifts close to the k-th largest eigenvalue, from 1: at least k eigenvalues are above the first, fewer above the second."""
        low = max((s for s, n in self.known.items() if n >= k), default=-self.top * 1e-6)
        high = min((s for s, n in self.known.items() if n < k and s > low), default=self.top)
        while high - low > share * max(abs(high), self.top * 1e-12):
            middle = (low + high) / 2
            if not low < middle < high:
                break
            if self.above(middle) >= k:
                low = middle
            else:
                high = middle
        return low, high

    def intervals(self, wanted: int, each: int = EACH) -> list[tuple[float, float, int]]:
        """(low, high, count), from the top: they hold the ``wanted`` largest eigenvalues at least.

        An end is put into the widest gap behind half to all of the eigenvalues that an interval is meant to hold. The
        last interval ends at the first real gap behind the wanted ones, and so may hold more.
        """
        out, high, done = [], self.top * 1.01 + 1e-300, 0
        while done < wanted:
            last = wanted - done <= each
            tried = range(wanted, len(self.v) + 1) if last else range(done + each // 2, done + each + 1)
            best = None
            for k in tried:
                end = self.bracket(k)[0]
                below = self.bracket(k + 1)[1] if k < len(self.v) else -self.top * 1e-3
                gap = (end - below) / max(abs(end), self.top * 1e-12)
                if best is None or gap > best[0]:
                    best = (gap, end, below, k)
                if last and gap > 1e-3:
                    break
            if best[0] <= 0:  # one tight cluster: take all that is below with it
                best = (0.0, -self.top * 1e-3, -self.top * 1e-3, len(self.v))
            low, k = (best[1] + best[2]) / 2, best[3]
            out.append((low, high, k - done))
            high, done = low, k
        return out


def feast(v: np.ndarray, low: float, high: float, count: int, points: int = POINTS, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues of ``v`` between ``low`` and ``high``, and their eigenvectors."""
    d, middle, radius = len(v), (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(points)
    turns = np.exp(1j * (np.pi / 2) * (1 - nodes))  # on the upper half circle; the lower one is its mirror image
    scale = np.abs(v).sum(axis=1).max()
    size, rng = min(d, count + max(4, count // 2)), np.random.default_rng(12)
    while True:
        y, best = rng.standard_normal((d, size)), np.inf
        for _ in range(rounds):
            q = np.zeros((d, size))
            for turn, weight in zip(turns, weights, strict=True):
                q += weight / 2 * (radius * turn * np.linalg.solve((middle + radius * turn) * np.eye(d) - v, y.astype(complex))).real
            q = np.linalg.qr(q)[0]
            values, inner = np.linalg.eigh(q.T @ v @ q)
            y = q @ inner
            residual = np.linalg.norm(v @ y - y * values, axis=0) / scale
            inside = (values > low) & (values < high) & (residual < 1e-9)
            worst = residual[inside].max(initial=0.0)
            if inside.sum() == count and (worst < 1e-15 * d or worst >= best / 2 and worst < 1e-12):
                return values[inside], y[:, inside]
            best = min(best, worst) if inside.sum() == count else np.inf
        if size == d:
            raise ArithmeticError(f"{inside.sum()} of {count} eigenvalues between {low} and {high} settled")
        size = min(d, 2 * size)


def leading(v: np.ndarray, most: int = COMPONENTS, each: int = EACH) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues that aren't zero to double precision, falling, and their eigenvectors as columns."""
    spectrum, trace = Spectrum(v), float(np.trace(v))
    wanted = min(most, spectrum.above(ZERO * trace)) if trace > 0 else 0
    if not wanted:
        return np.zeros(0), np.zeros((len(v), 0))
    found = [feast(v, low, high, count)[1] for low, high, count in spectrum.intervals(wanted, each)]
    basis = np.linalg.qr(np.concatenate(found, axis=1))[0]
    values, inner = np.linalg.eigh(basis.T @ v @ basis)
    return values[::-1][:wanted], (basis @ inner)[:, ::-1][:, :wanted]


def fit(vectors: DataFrame, most: int = COMPONENTS) -> Whitening:
    """Learns from all whole vectors of ``vectors`` (vec_id, embedding); see ``whiten`` for odd rows."""
    kept, width = kept_vectors(vectors)
    if not width:
        return Whitening(0, 0, (), np.zeros(0), np.zeros((0, 0)), 0.0)
    n, sums, products = _moments(kept, width)
    v = np.array([[(n * products[i, j] - sums[i] * sums[j]) / (n * n) for j in range(width)] for i in range(width)], float)
    values, components = leading(v, most)
    return Whitening(n, width, tuple(sums), values, components, float(np.trace(v)))


def _centred(y: np.ndarray, fitted: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S of each row, and its exact sum of squares."""
    bound = fitted.n * max(1, int(np.abs(y).max(initial=0))) + max(map(abs, fitted.sums))
    kind = np.int64 if bound * bound * fitted.width < 1 << 63 else object
    away = y.astype(kind) * fitted.n - np.array(fitted.sums, kind)
    return away, (away * away).sum(axis=1)


def identity_error(kept: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows, minus the identity, as summed over all rows."""
    scaled, count = fitted.components / np.sqrt(fitted.values), len(fitted.values)

    def add(batches):
        total = np.zeros((count, count))
        for batch in batches:
            w = (_centred(floored(batch.column(0), fitted.width, FACTOR), fitted)[0] / fitted.n).astype(float) @ scaled
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(count * count), pa.int32()), pa.array(total.ravel())], ["place", "value"])

    summed = kept.select("vector").mapInArrow(add, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    values = [r.value for r in summed.orderBy("place").collect()]  # the square of the number of components
    return float(np.abs(np.array(values).reshape(count, count) / fitted.n - np.eye(count)).max())


def whiten(vectors: DataFrame, fitted: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each whole vector and component.

    A null vector, one with null or non-finite entries and one that is shorter than others is dropped. Rows that repeat
    count, and are returned, each on its own; a null vec_id stays null; other columns are not read. Components whose
    eigenvalue is zero to double precision are left out, so equal vectors alone and an empty table give an empty result.
    A deviation that no long can hold is an error.
    """
    kept, width = kept_vectors(vectors)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    count = len(fitted.values)
    if not count or not width:
        return vectors.sparkSession.createDataFrame([], schema)
    if width != fitted.width:
        raise ValueError(f"fitted on vectors of {fitted.width} entries, not {width}")
    error, scaled = identity_error(kept, fitted), fitted.components / np.sqrt(fitted.values)
    explained = fitted.values / fitted.trace

    def project(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            away, squares = _centred(floored(batch.column(0), width, FACTOR), fitted)
            whitened, rows = (away / fitted.n).astype(float) @ scaled, batch.num_rows
            ids = batch.column(1).take(pa.array(np.repeat(np.arange(rows), count)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)), pa.array(np.full(rows * count, fitted.n)), pa.array(np.repeat(squares, count).tolist(), pa.int64()),
                    pa.array(whitened.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * count, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return kept.select("vector", F.col("vec_id").cast("long").alias("vec_id")).mapInArrow(project, schema)
