import hashlib
import math

import numpy as np
import pytest

from pulsewright.llm import codes

SCHEMA = "label int, embedding array<float>, error string, vec_id long, code int"


def frame(spark, rows):
    return spark.createDataFrame([(label, e, "x", i, 3) for i, e, label in rows], SCHEMA).repartition(3)


def brute(rows, parts, entries=64, rounds=2):
    """One vector at a time, in Python's integers; no trees."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [float(np.float32(x)) for x in r[1]]))
    ints = [[math.floor(256 * float(np.float32(x))) for x in r[1]] for r in rows]
    step = len(ints[0]) // parts
    cut = [[tuple(v[p * step : (p + 1) * step]) for v in ints] for p in range(parts)]
    book = [list(c[:entries]) for c in cut]

    def nearest(x, own):
        away = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in own]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for x in cut[p]:
                held.setdefault(nearest(x, book[p])[0], []).append(x)
            for k, xs in held.items():
                book[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    digest = hashlib.sha256(",".join(str(c) for own in book for e in own for c in e).encode()).hexdigest()
    out = []
    for k, (i, _, label) in enumerate(rows):
        found = [nearest(cut[p][k], book[p]) for p in range(parts)]
        out.append((i, "".join(f"{f[0]:02x}" for f in found), sum(f[1] for f in found), label))
    sums = {}
    for _, _, e, label in out:
        sums[label] = sums.get(label, 0) + e
    return sorted(((i, c, e, sums[label], digest) for i, c, e, label in out), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [3, 64, 700])
def test_rows_match_brute_force(spark, n):
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((9, 32)) / 3
    rows = [(k * 7 % 1009, (centres[rng.integers(9)] + rng.standard_normal(32) / (4 if k % 3 else 400)).tolist(), [None, 0, 1][k % 3]) for k in range(n)]
    assert rows_of(codes.compress(frame(spark, rows))) == brute(rows, 16)


def test_ties_and_copies_match_brute_force(spark):
    rows = [(k, [float(k % 3), float(k % 2), 0.0, 0.0], 1) for k in range(300)]  # entries that are equal: the lower one
    assert rows_of(codes.compress(frame(spark, rows), parts=2, entries=8)) == brute(rows, 2, 8)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    whole = [(5, [0.5] * 16, 1), (5, [0.25] * 16, 1), (5, [0.25] * 16, None), (None, [1.0] * 16, None), (2, [-0.3] * 16, 2)]
    odd = [(0, None, 1), (1, [1.0] * 15 + [None], 1), (3, [nan] + [0.0] * 15, None), (4, [inf] + [0.0] * 15, 1), (6, [], 1), (7, [1.0] * 8, 1)]
    got = codes.compress(frame(spark, whole + odd))
    assert rows_of(got) == brute(whole, 16)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.compress(frame(spark, [])).collect() == codes.compress(frame(spark, odd[:1])).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(frame(spark, [(1, [1.0] * 17, 1)]))


@pytest.mark.parametrize(("n", "spread"), [(1, 5), (50, 2), (3000, 30), (400, 100_000)])
def test_trees_cover_separate_and_nest(n, spread):
    rng = np.random.default_rng(n)
    points = rng.integers(-spread, spread + 1, (n, 4))
    points[n // 2 :: 3] = points[0]
    tree = codes.cover_tree(points)
    assert sorted(tree.order.tolist()) == list(range(n))
    for k in range(len(tree.begin)):
        away = np.sqrt(((points[tree.order[tree.begin[k] : tree.end[k]]] - points[tree.centre[k]]) ** 2).sum(axis=1))
        assert len(away) and abs(away.max() - tree.reach[k]) < 1e-9
        if tree.first[k] >= 0:
            own = np.arange(tree.first[k], tree.last[k])
            assert tree.begin[own[0]] == tree.begin[k] and tree.end[own[-1]] == tree.end[k] and (tree.end[own[:-1]] == tree.begin[own[1:]]).all()
            assert tree.centre[own[0]] == tree.centre[k] and (tree.reach[own] <= tree.reach[k] / 2 + 1e-9).all()
            between = ((points[tree.centre[own]][:, None] - points[tree.centre[own]][None]) ** 2).sum(axis=-1)
            assert (np.sqrt(between[~np.eye(len(own), dtype=bool)]) > tree.reach[k] / 2 - 1e-9).all()
    book = rng.integers(-spread, spread + 1, (64, 4))
    book[10] = book[3]
    entry = np.empty(n, np.int64)
    entry[tree.order] = codes.assign(points, tree, book)[0]
    assert (entry == ((points[:, None] - book[None]) ** 2).sum(axis=-1).argmin(axis=1)).all()


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-3, 4, (2000, 4)) + c for c in (0, 500, 1000)])
    book = np.array([[0] * 4, [500] * 4, [1000] * 4])
    _, runs = codes.assign(points, codes.cover_tree(points), book)
    assert sum(len(b) for b, _, _ in runs) < 60  # far fewer decisions than points
