"""Line dedup by pairwise alignment of documents that share line hashes.

A text is cut into units: its physical lines, and these behind sentence ends, so that joining the units gives the text
back. A block that two documents have in common is a run of equal units with enough bytes. Any such block holds, from its
first unit on and up to its last, a shortest run of enough bytes; so every document posts the hash of the shortest run
from each unit on and of the shortest run up to each unit. Where lines are long such a run is one line; short lines, down
to single words or signs, join until they are long enough, and a text that never gets there posts itself as a whole.

The earliest document that holds a hash owns it, and every later holder is paired with the owner only, so a line that
very many documents share costs one row for each holder, not one for each two. Rare or frequent, no hash is left out;
frequent ones, whose number is bounded, take another join.

Each pair of documents is aligned over the units that they match in, as patience diff does it: units matched once on both
sides are anchors, the longest run of anchors that stands in the same order on both sides is kept, and what lies between
two anchors is aligned again. Blocks that the alignment holds are deleted from the later document, however short. What
stands in another order, or once more than the owner has it, isn't aligned: a line or two of that kind stay, and only a
block that is long enough by itself (a moved or repeated passage) goes. All other text stays as it is.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh64_intdigest

from pulsewright.llm.common import documents, free_name, give_back, join_counted, pairs, stored

#: Bytes of UTF-8, blanks not counted, that a common block must have. With 1 every line that an earlier document has goes.
BLOCK_BYTES = 32
#: Bytes that a block must have which the alignment doesn't hold, as many times those of one that it holds.
MOVED = 4
ENDS = ("\n", ". ", "! ", "? ", "。", "！", "？")
AT_ENDS = re.compile("|".join(f"(?<={re.escape(e)})" for e in ENDS))
WHOLE, PART = 1, 0
#: Characters of texts whose postings are held at a time.
SLICE = 1_000_000
#: Bits of a posting's number that count units; those above tell which occurrence of the run it is.
NTH = 32
#: A hash with at least this share of all postings is frequent: there are at most 1 / FREQUENT of them, 24 bytes each.
FREQUENT = 1e-5


def units(text: str) -> list[str]:
    """Pieces whose join is the text: each ends behind a newline or behind a sentence's end (and its blank)."""
    mark = next((c for c in map(chr, range(0xE000, 0xF900)) if c not in text), None)  # private characters
    if mark is None:
        return [u for u in AT_ENDS.split(text) if u]
    for end in ENDS:
        if end in text:
            text = text.replace(end, end + mark)
    return [u for u in text.split(mark) if u]


def bodies_of(parts: list[str]) -> tuple[list[bytes], list[int]]:
    """The words of each unit that has any, and at which unit it is; units of blanks go with the one before them."""
    bodies, places = [], []
    for k, unit in enumerate(parts):
        words = unit.encode("utf-8", "surrogatepass").split()
        if words:
            bodies.append(b" ".join(words))
            places.append(k)
    return bodies, places


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def run_hash(bodies: list[bytes], seed: int = PART) -> int:
    return _signed(xxh64_intdigest(bodies[0] if len(bodies) == 1 else b"\n".join(bodies), seed))


def shortest_runs(sizes: np.ndarray, least: int) -> tuple[list[int], list[int]]:
    """First places and numbers of the shortest runs of at least ``least`` from each place on and up to each place."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    behind = np.searchsorted(total, total[:-1] + least)
    here = np.flatnonzero(behind <= n)
    before = np.searchsorted(total, total[1:] - least, side="right") - 1
    there = np.flatnonzero(before >= 0)
    both = np.unique(np.concatenate([here * (n + 1) + behind[here], before[there] * (n + 1) + there + 1]))
    first, end = both // (n + 1), both % (n + 1)
    return first.tolist(), (end - first).tolist()


def again(hash_: int, nth: int) -> int:
    """The hash of a run that its text has ``nth`` times before."""
    return _signed(xxh64_intdigest(hash_.to_bytes(8, "little", signed=True), nth)) if nth else hash_


def postings(text: str, least: int = BLOCK_BYTES) -> tuple[list[int], list[int], list[int]]:
    """(hashes, first places, numbers) of the posted runs of a text; a number holds how many units, and above NTH bits how many such runs come before.

    A run that the text has again is posted under the hash of that occurrence, so that a copy's runs meet those at the same place.
    """
    bodies, _ = bodies_of(units(text))
    if not bodies:
        return [], [], []
    first, number = shortest_runs(np.array([len(b) - b.count(b" ") for b in bodies]), least)
    if not first:
        return [run_hash(bodies, WHOLE)], [0], [len(bodies)]
    hashes = [run_hash(bodies[a : a + n]) for a, n in zip(first, number, strict=True)]
    if len(set(hashes)) < len(hashes):
        times: dict[int, int] = {}
        for k, h in enumerate(hashes):
            nth = times[h] = times.get(h, -1) + 1
            if nth:
                hashes[k] = again(h, nth)
                number[k] |= nth << NTH
    return hashes, first, number


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing run, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        at = bisect_left(tops, v)
        if at == len(tops):
            tops.append(v)
            piles.append(k)
        elif v < tops[at]:  # of equal ones the first stays
            tops[at], piles[at] = v, k
        before[k] = piles[at - 1] if at else -1
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def patience(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The matches (here, there), ascending, that an alignment keeps: both places go up from one to the next.

    Anchors are matches whose places have no other match. Of these the longest increasing run stays; between two of its
    anchors the matches that are left are aligned likewise, or, where none is an anchor, by their own longest run.
    """
    out, waiting = [], [sorted(pairs)]
    while waiting:
        rows = waiting.pop()
        if len(rows) < 2:
            out += rows
            continue
        times_here, times_there = Counter(h for h, _ in rows), Counter(t for _, t in rows)
        anchors = [(h, t) for h, t in rows if times_here[h] == times_there[t] == 1]
        if not anchors:
            rows.sort(key=lambda r: (r[0], -r[1]))  # one match of each place here at most
            out += [rows[k] for k in increasing([t for _, t in rows])]
            continue
        kept = [anchors[k] for k in increasing([t for _, t in anchors])]
        out += kept
        if len(kept) < len(rows):
            ends = [h for h, _ in kept]
            gaps: dict[int, list[tuple[int, int]]] = {}
            for h, t in rows:
                k = bisect_left(ends, h)
                after_last = k == 0 or kept[k - 1][1] < t
                before_next = k == len(kept) or h < kept[k][0] and t < kept[k][1]
                if after_last and before_next:
                    gaps.setdefault(k, []).append((h, t))
            waiting += gaps.values()
    return sorted(out)


def align(here: list[int], there: list[int], number: list[int]) -> list[int]:
    """For each run of units that two documents match in: -1 where the alignment holds all of it, else the number of its block.

    A block goes on, in both documents side by side, over all runs that meet or overlap.
    """
    matches = {(h + k, t + k) for h, t, n in zip(here, there, number, strict=True) for k in range(n)}
    kept = set(patience(list(matches)))
    out, blocks, ends = [-1] * len(here), 0, {}
    for k in sorted(range(len(here)), key=lambda k: (there[k] - here[k], here[k])):
        h, t, n = here[k], there[k], number[k]
        if all((h + j, t + j) in kept for j in range(n)):
            continue
        side = t - h
        block, end = ends.get(side, (0, -1))
        if h > end:
            block, blocks = blocks, blocks + 1
        ends[side] = (block, max(end, h + n))
        out[k] = block
    return out


def _owned(posted: DataFrame) -> DataFrame:
    """(hash, owner, owner_first, n, latest) of each posted hash."""
    return posted.groupBy("hash").agg(F.min("doc_id").alias("owner"), F.min_by("first", "doc_id").alias("owner_first"), F.max("doc_id").alias("latest"), F.count(F.lit(1)).alias("n"))


def line_cuts(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, owner, first, number, hash, block) of every run that a document shares with the earlier ``owner``: block -1 if the alignment of the two holds it."""

    def post(batches):
        names = ["hash", "first", "number", "doc_id"]
        for ids, texts in pairs(batches, SLICE):
            columns: list[list] = [[], [], []]
            sizes = []
            for i, t in zip(ids, texts, strict=True):
                own = postings(t, block_bytes) if i is not None else ([], [], [])
                sizes.append(len(own[0]))
                for c, more in zip(columns, own, strict=True):
                    c += more
            owner = np.repeat(np.array([0 if i is None else i for i in ids], np.int64), sizes)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(owner)], names)
        give_back()

    posted = stored(documents(docs).mapInArrow(post, "hash long, first long, number long, doc_id long"))
    owned = stored(_owned(posted).filter("owner < latest"))
    met = (
        join_counted(posted, owned.drop("latest"), "hash", posted.count(), FREQUENT)
        .filter("doc_id > owner")
        .select("doc_id", "owner", "first", "owner_first", "number", "hash")
    )

    def run(batches):
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            goes_on = kept and all(batch.column(c)[batch.num_rows - 1] == kept[0].column(c)[0] for c in (0, 1))
            kept.append(batch)
            if not goes_on:
                kept, out = _close(kept, last=False)
                yield out
        if kept:
            yield _close(kept, last=True)[1]
        give_back()

    sorted_pairs = met.repartition("doc_id", "owner").sortWithinPartitions("doc_id", "owner", "first", "number")
    return sorted_pairs.mapInArrow(run, "doc_id long, owner long, first long, number long, hash long, block int")


def _close(parts: list[pa.RecordBatch], last: bool):
    """Aligns all pairs of documents but the one that the next batch may go on with; a pair has no more rows than one document."""
    table = pa.Table.from_batches(parts).combine_chunks()
    doc, owner = table.column(0).to_numpy(), table.column(1).to_numpy()
    bounds = np.concatenate([[0], np.flatnonzero((np.diff(doc) != 0) | (np.diff(owner) != 0)) + 1, [len(doc)]])
    rest = []
    if not last:
        rest = table.slice(int(bounds[-2])).to_batches()
        bounds = bounds[:-1]
    done = table.slice(0, int(bounds[-1])).combine_chunks()
    here, there, number = (done.column(k).to_numpy() for k in (2, 3, 4))
    number = number & (1 << NTH) - 1
    block = np.full(len(done), -1, np.int32)
    if len(done):  # where both documents go on side by side throughout, all of it is one aligned block
        side, starts = there - here, bounds[:-1]
        crossed = np.minimum.reduceat(side, starts) != np.maximum.reduceat(side, starts)
        for a, b in zip(starts[crossed].tolist(), bounds[1:][crossed].tolist(), strict=True):
            block[a:b] = align(*(x[a:b].tolist() for x in (here, there, number)))
    columns = [done.column(k).combine_chunks() for k in (0, 1, 2, 4, 5)]
    return rest, pa.RecordBatch.from_arrays([*columns, pa.array(block)], ["doc_id", "owner", "first", "number", "hash", "block"])


def without(text: str, cuts: list[tuple], least: int = BLOCK_BYTES * MOVED) -> tuple[str, int]:
    """The text without the cut runs (first, number, hash, owner, block) that it really has, and how many units went.

    Runs of a block that isn't aligned (block 0 and more of an owner) go only if together they have ``least`` bytes. Of
    what goes, the text's own repeats go with it, if as long.
    """
    parts = units(text)
    bodies, places = bodies_of(parts)
    ends = [*places[1:], len(parts)]
    gone: set[int] = set()
    moved: dict[tuple, set[int]] = {}
    for first, number, hash_, owner, block in cuts:
        nth, number = number >> NTH, number & (1 << NTH) - 1
        own = bodies[first : first + number]
        if len(own) == number and (again(run_hash(own), nth) == hash_ or number == len(bodies) and run_hash(own, WHOLE) == hash_):
            (gone if block < 0 else moved.setdefault((owner, block), set())).update(range(first, first + number))
    size = lambda held: sum(len(bodies[k]) - bodies[k].count(b" ") for k in held)
    for held in moved.values():
        if size(held) >= least:
            gone |= held
    if len(gone) < len(bodies):
        once = {bodies[k]: k for k in sorted(gone, reverse=True)}
        here = 0
        while here < len(bodies):
            n, there = 0, once.get(bodies[here], -1) if here not in gone else -1
            while there >= 0 and here + n < len(bodies) and here + n not in gone and there + n in gone and bodies[here + n] == bodies[there + n] and there + n < here:
                n += 1
            if n and size(range(here, here + n)) >= least:
                gone.update(range(here, here + n))
            else:
                n = 0
            here += max(1, n)
    lost = {k for g in gone for k in range(places[g], ends[g])}
    if len(gone) == len(bodies):
        lost = set(range(len(parts)))
    return "".join(p for k, p in enumerate(parts) if k not in lost), len(lost)


def dedup_lines(docs: DataFrame, block_bytes: int = BLOCK_BYTES, removed: str | None = None) -> DataFrame:
    """Every row of ``docs`` with all its columns, its text without the blocks that an earlier document has.

    A block is a run of units with at least ``block_bytes`` bytes besides blanks, or a whole text with fewer; one that the
    alignment with the earlier document doesn't hold needs MOVED times as many. ``removed`` names a further column with the
    number of units that went; a name that ``docs`` has is an error. A copy of an earlier document loses all its text and
    stays as a row with an empty one. Earlier is by doc_id; a row without doc_id keeps its text and none loses to it, a
    null text stays null, rows that repeat a doc_id lose the same blocks, blocks that one document repeats stay in it,
    and an empty table gives an empty result. Other columns may have any name.
    """
    place, width = docs.columns.index("text"), len(docs.columns)
    key, listed_key, listed_cuts = (free_name(stem, docs.columns) for stem in ("cut_key", "cut_id", "cut_list"))
    if removed is not None and removed.lower() in map(str.lower, docs.columns):
        raise ValueError(f"there is a column {removed} already")
    of_block = F.when(F.col("block") >= 0, F.col("owner")).alias("owner")
    listed = line_cuts(docs, block_bytes).groupBy(F.col("doc_id").alias(listed_key)).agg(F.collect_set(F.struct("first", "number", "hash", of_block, "block")).alias(listed_cuts))
    moved_bytes = block_bytes * MOVED
    joined = docs.withColumn(key, F.col("doc_id").cast("long")).join(listed, F.col(key) == F.col(listed_key), "left").drop(key, listed_key)
    schema = docs.schema if removed is None else StructType([*docs.schema.fields, StructField(removed, LongType())])

    def apply(batches):
        for batch in batches:
            texts, cuts = batch.column(place).to_pylist(), batch.column(width)
            gone = [0] * len(texts)
            fields = [c.to_pylist() for c in cuts.flatten().flatten()]
            sizes = pc.fill_null(pc.list_value_length(cuts), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for k in np.flatnonzero(sizes).tolist():
                texts[k], gone[k] = without(texts[k] or "", list(zip(*(f[ends[k] - sizes[k] : ends[k]] for f in fields), strict=True)), moved_bytes)
            columns = list(batch.columns[:width])
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns + ([] if removed is None else [pa.array(gone, pa.int64())]), schema.names)
        give_back()

    return joined.mapInArrow(apply, schema)
