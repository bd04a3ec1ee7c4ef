"""Compression of vectors to codes of their parts, learned by Lloyd's rounds on partition-local cover trees.

Each task gathers vectors into groups of bounded size and builds a cover tree over every part of a group: a node's
children stand further apart than half its reach and hold all its points within that, and the points of a node stand side
by side, with running sums over them. In a round a node whose points must all have the same nearest entry, by the triangle
inequality, is assigned as a whole and its sum is one difference of running sums; only ambiguous nodes descend, with the
entries that are still possible, down to exact comparisons of single points. The groups with their trees are written once
to the shared folder; a round reads them, and only sums for each part and entry leave the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsewright.llm.common import join_counted, stored
from pulsewright.llm.vectors import floored, kept_vectors

FACTOR, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Vectors of a group, and points of a node that isn't split any more.
GROUP, LEAF = 8192, 8
#: Entries up to this have squared distances that are exact as doubles and longs.
MOST = 1 << 24
#: Labels with at least this share of the rows get their sum by a broadcast: at most 1 / FREQUENT of them.
FREQUENT = 1e-4


@dataclass
class Tree:
    """A cover tree over points, by node: the points ``order[begin:end]``, a centre, the greatest distance from it, and the children ``first:last``."""

    order: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    reach: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """All nodes of a level are split side by side: the first point of a node that no child holds yet becomes a child's centre."""
    n = len(points)
    order = np.arange(n)
    begin, end, centre = np.array([0]), np.array([n]), np.array([0])
    levels, top = [], 0
    while len(begin):
        owner = np.repeat(np.arange(len(begin)), end - begin)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + begin[owner]
        away = _squares(points[order[place]], points[centre[owner]])
        furthest = np.maximum.reduceat(away, np.cumsum(end - begin) - (end - begin))
        reach = np.sqrt(furthest.astype(float))
        split = (end - begin > leaf) & (furthest > 0)
        first = np.full(len(begin), -1)
        last = first.copy()
        levels.append((begin, end, centre, reach, first, last))
        top += len(begin)
        near = split[owner]
        owner, place = owner[near], place[near]
        if not len(owner):
            break
        own = points[order[place]]
        child, found = np.full(len(owner), -1), np.zeros(len(begin), np.int64)
        centres: list[tuple[np.ndarray, np.ndarray]] = []  # of the k-th child of each node: nodes and centres
        left = np.arange(len(owner))
        while len(left):
            nodes, at = np.unique(owner[left], return_index=True)
            # the node's own centre is the first child's, so a centre stays one on every level below
            chosen = order[place[left[at]]] if centres else centre[nodes]
            centres.append((nodes, chosen))
            of_node = np.zeros(len(begin), np.int64)
            of_node[nodes] = chosen
            held = 4 * _squares(own[left], points[of_node[owner[left]]]) <= furthest[owner[left]]
            child[left[held]] = found[owner[left[held]]]
            found[nodes] += 1
            left = left[~held]
        starts = np.cumsum(found) - found
        first[split], last[split] = top + starts[split], top + starts[split] + found[split]
        number = starts[owner] + child
        place_of = np.argsort(number, kind="stable")
        order[place] = order[place[place_of]]  # the places of a node stay its own, dealt out to its children
        sizes = np.bincount(number, minlength=int(found.sum()))
        rank = np.concatenate([starts[nodes] + k for k, (nodes, _) in enumerate(centres)])
        centre = np.empty(len(sizes), np.int64)
        centre[rank] = np.concatenate([c for _, c in centres])
        parent = np.repeat(np.arange(len(begin)), found)
        before = np.cumsum(sizes) - sizes
        begin = begin[parent] + before - before[starts[parent]]
        end = begin + sizes
    return Tree(order, *(np.concatenate(c) for c in zip(*levels, strict=True)))


def assign(points: np.ndarray, tree: Tree, book: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The nearest entry of ``book`` for each place of ``tree.order``, ties to the lower one; and (begin, end, entry) of what was assigned as a whole.

    The inequality is held with a margin beyond rounding, so ties always descend; distances of single points are exact.
    """
    out = np.empty(len(points), np.int64)
    runs = []
    at = np.array([0])
    possible = np.ones((1, len(book)), bool)
    margin = 1e-6 + 1e-9 * float(np.abs(points).max(initial=0) + np.abs(book).max(initial=0))
    while len(at):
        away = np.sqrt(_squares(points[tree.centre[at]][:, None, :], book[None]).astype(float))
        away[~possible] = np.inf
        nearest = away.argmin(axis=1)
        # an entry may be nearest to a point of the node only if it is within twice the reach of the nearest to the centre
        possible = away <= (away[np.arange(len(at)), nearest] + 2 * tree.reach[at] + margin)[:, None]
        sure = possible.sum(axis=1) == 1
        runs.append((tree.begin[at[sure]], tree.end[at[sure]], nearest[sure]))
        leaf = ~sure & (tree.first[at] < 0)
        single = _ranges(tree.begin[at[leaf]], tree.end[at[leaf]])
        if len(single):
            away = _squares(points[tree.order[single]][:, None, :], book[None])
            exact = away.argmin(axis=1)
            runs.append((single, single + 1, exact))
        down = np.flatnonzero(~sure & ~leaf)
        sizes = tree.last[at[down]] - tree.first[at[down]]
        possible = possible[np.repeat(down, sizes)]
        at = _ranges(tree.first[at[down]], tree.last[at[down]])
    for begin, end, entry in runs:
        out[_ranges(begin, end)] = np.repeat(entry, end - begin)
    return out, runs


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    sizes = end - begin
    return np.arange(sizes.sum()) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)


TREE = ["order", "begin", "end", "centre", "reach", "first", "last"]
GROUPS = "ids array<long>, labels array<string>, points array<long>, " + ", ".join(f"{n} array<array<{'double' if n == 'reach' else 'long'}>>" for n in TREE)


def _nested(parts: list[np.ndarray]) -> pa.ListArray:
    flat = pa.array(np.concatenate(parts))
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), flat)
    return pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), inner)


def _label_key(label: Column) -> Column:
    """A text for each label, nulls included."""
    return F.coalesce(F.concat(F.lit("="), label.cast("string")), F.lit(""))


def grouped(vectors: DataFrame, parts: int = PARTS, size: int = GROUP) -> tuple[DataFrame, int]:
    """A row for each group of at most ``size`` whole vectors, with the cover trees over its parts; and the vectors' length."""
    kept, width = kept_vectors(vectors, others=("vec_id", "label"))
    if width % parts:
        raise ValueError(f"vectors of {width} entries have no {parts} equal parts")
    rows = kept.select("vector", F.col("vec_id").cast("long").alias("vec_id"), _label_key(F.col("label")).alias("label"))

    def build(batches: Iterable[pa.RecordBatch]):
        waiting: list[pa.RecordBatch] = []

        def close():
            group = pa.Table.from_batches(waiting).combine_chunks()
            points = floored(group.column(0).combine_chunks(), width, FACTOR)
            if np.abs(points).max() > MOST:
                raise ValueError(f"entries beyond {MOST} / {FACTOR} have no exact distances")
            trees = [cover_tree(p) for p in np.split(points, parts, axis=1)]
            one = [pa.ListArray.from_arrays(pa.array([0, len(points)], pa.int32()), c) for c in (group.column(1).combine_chunks(), group.column(2).combine_chunks())]
            flat = pa.ListArray.from_arrays(pa.array([0, points.size], pa.int32()), pa.array(points.ravel()))
            names = ["ids", "labels", "points", *TREE]
            yield pa.RecordBatch.from_arrays([*one, flat, *(_nested([getattr(t, n) for t in trees]) for n in TREE)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                if waiting and sum(b.num_rows for b in waiting) + part.num_rows > size:
                    yield from close()
                    waiting = []
                waiting.append(part)
        if waiting:
            yield from close()

    return stored(rows.mapInArrow(build, GROUPS)), width


def _read(batches: Iterable[pa.RecordBatch], width: int):
    """(row, points, trees) of each group."""
    for batch in batches:
        column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        for k in range(batch.num_rows):
            points = column["points"][k].values.to_numpy().reshape(-1, width)
            fields = [[part.values.to_numpy() for part in column[n][k]] for n in TREE]
            yield column, k, points, [Tree(*own) for own in zip(*fields, strict=True)]


def lloyd_round(groups: DataFrame, width: int, book: np.ndarray) -> np.ndarray:
    """The codebook (part, entry, position) after one round: each entry becomes the floor of its points' mean, unused ones stay."""
    parts, entries, step = book.shape

    def add(batches):
        total = np.zeros((parts * entries, step + 1), object)
        for _, _, points, trees in _read(batches, width):
            own = np.zeros((parts * entries, step + 1), np.int64)
            for p, tree in enumerate(trees):
                part = points[:, p * step : (p + 1) * step]
                running = np.zeros((len(part) + 1, step + 1), np.int64)
                np.cumsum(np.column_stack([part[tree.order], np.ones(len(part), np.int64)]), axis=0, out=running[1:])
                for begin, end, entry in assign(part, tree, book[p])[1]:
                    np.add.at(own, p * entries + entry, running[end] - running[begin])
            total += own
        used = np.flatnonzero(total[:, -1].astype(np.int64))
        sums = pa.array(total[used].ravel().astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * (step + 1), pa.int32()), sums)], ["entry", "sums"])

    added = groups.mapInArrow(add, "entry long, sums array<long>").groupBy("entry").agg(F.array(*[F.sum(F.col("sums")[k].cast("decimal(38,0)")) for k in range(step + 1)]).alias("sums"))
    out = book.copy().reshape(-1, step)
    for row in added.collect():  # a row for each part and entry
        sums = [int(x) for x in row.sums]
        out[row.entry] = [s // sums[-1] for s in sums[:-1]]
    return out.reshape(book.shape)


def fit(vectors: DataFrame, groups: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebook, as (part, entry, position): from the rows with the smallest vec_ids, after ``rounds`` rounds."""
    kept, _ = kept_vectors(vectors)
    first = kept.orderBy(F.col("vec_id").cast("long").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    start = floored(first.column(0).combine_chunks(), width, FACTOR)
    book = np.stack(np.split(start, parts, axis=1))
    for _ in range(rounds):
        book = lloyd_round(groups, width, book)
    return book


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every whole vector of ``vectors`` (vec_id, embedding, label).

    A null vector, one with null or non-finite entries and one that is shorter than others is dropped. Rows that repeat a
    vec_id are learned from and coded each on its own; where the smallest ids repeat, the lesser vector starts first, and
    null ids come last. With fewer rows than entries the codebook is as long as the rows. Equal labels, nulls together,
    share a label_error. Other columns are not read; an empty table gives an empty result.
    """
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if entries > 256:
        raise ValueError("an index has two hex digits")
    groups, width = grouped(vectors, parts)
    if not width:
        return vectors.sparkSession.createDataFrame([], schema)
    book = fit(vectors, groups, width, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    step = book.shape[2]

    def code(batches):
        for column, k, points, trees in _read(batches, width):
            digits, error = np.empty((len(points), parts), np.uint8), np.zeros(len(points), np.int64)
            for p, tree in enumerate(trees):
                part = points[:, p * step : (p + 1) * step]
                entry = np.empty(len(part), np.int64)
                entry[tree.order] = assign(part, tree, book[p])[0]
                digits[:, p] = entry
                error += _squares(part, book[p][entry])
            text = digits.tobytes().hex()
            codes = [text[a : a + 2 * parts] for a in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([column["ids"][k].values, column["labels"][k].values, pa.array(codes), pa.array(error)], ["vec_id", "label", "code", "error"])

    coded = stored(groups.mapInArrow(code, "vec_id long, label string, code string, error long"))
    by_label = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    joined = join_counted(coded, by_label, "label", coded.count(), FREQUENT)
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
