"""SimHash near-duplicates through an inverted index on the positional bytes of the fingerprints.

Two fingerprints of eight bytes that differ in at most three bits agree in at least five bytes of the same position: the
guaranteed minimum of shared positional bytes. A single positional byte is shared by every 256th row, so the index lists
fingerprints by four positional bytes at once. Which four: the fourteen sets of positions whose numbers cancel out under
exclusive or. Any three positions lie in exactly one of these sets, so for any three that differ there is one set beside
them that agrees, and every pair with the minimum meets in some list. In a list the shared positional bytes of each pair
are tallied, four being given; pairs that reach the minimum are retained, and verified by the count of differing bits. No
pairs are written: each list gives the ties of its own connected groups.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pulsewright.llm.common import cut, documents, free_name, give_back, join_counted, pairs
from pulsewright.llm.components import components

SEED, WORDS, BITS = 42, 3, 3
SHARED = 8 - BITS
#: Of each two complementary sets one lists what differs, the other what agrees.
SUBSETS = [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]
#: Lists up to this length are compared all with all in blocks; longer ones look up every allowed change, to the same effect.
DENSE = 8192
BLOCK = 128
#: Fingerprints of at least this share of all rows join them by a broadcast: at most 1 / FREQUENT rows.
FREQUENT = 1e-4
STEP = 1 << 16
LOW_BITS, HIGH_BIT = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def fingerprint(text: str, words: int = WORDS) -> int:
    """Bit k is set where it is set in over half of the hashes of the text's word shingles, as a signed number."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII blanks
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = ends - np.diff(ends, prepend=0)
    n = max(1, len(tokens) - words + 1)
    lows, highs = starts[:n].tolist(), (ends[min(words, len(tokens)) - 1 :] - 1).tolist()
    totals = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(lows[at : at + STEP], highs[at : at + STEP], strict=True)], np.uint64)
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(totals * 2 > n, bitorder="little").view(np.int64)[0])


def _text_hash() -> Column:
    """Tells texts apart under one doc_id; a null text is not an empty one."""
    return F.coalesce(F.sha2(F.col("text").cast("string"), 256), F.lit(""))


def fingerprints(docs: DataFrame, words: int = WORDS, hashed: bool = False) -> DataFrame:
    """(doc_id, fp) of every row, and text_hash if ``hashed``; a null text counts as empty and has fingerprint zero."""
    kinds = {"doc_id": pa.int64(), "text_hash": pa.string(), "fp": pa.int64()}
    if not hashed:
        del kinds["text_hash"]
    schema = pa.schema(list(kinds.items()))

    def run(batches):
        for batch in batches:
            at = 0
            for ids, texts in pairs([batch], 2_000_000):
                own = [batch.column(2).slice(at, len(texts))] if hashed else []
                at += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *own, pa.array([fingerprint(t, words) for t in texts], pa.int64())], schema=schema)
        give_back()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_hash().alias("text_hash")) if hashed else documents(docs)
    return read.mapInArrow(run, "doc_id long, text_hash string, fp long" if hashed else "doc_id long, fp long")


def _free_masks(subset: tuple[int, ...], bits: int) -> np.ndarray:
    free = [8 * p + b for p in range(8) if p not in subset for b in range(8)]
    masks = [sum(1 << b for b in chosen) for k in range(1, bits + 1) for chosen in combinations(free, k)]
    return np.array(masks, np.uint64)


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes of the same position two fingerprints share."""
    x = a ^ b
    return 8 - np.bitwise_count(((x & LOW_BITS) + LOW_BITS | x) & HIGH_BIT)


def linked_pairs(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which pairs reach the minimum of shared positional bytes and, of these, differ in few enough bits."""
    retained = shared_bytes(a, b) >= 8 - bits
    return retained & (np.bitwise_count(np.where(retained, a ^ b, ~np.uint64(0))) <= bits)


def group_labels(fps: np.ndarray, subset: tuple[int, ...], bits: int = BITS) -> np.ndarray:
    """For distinct fingerprints that agree in the bytes of ``subset``: the place of the first one of each linked group."""
    labels = np.arange(len(fps))
    if len(fps) <= DENSE:
        while True:
            least = labels.copy()
            for at in range(0, len(fps), BLOCK):
                near = linked_pairs(fps[at : at + BLOCK, None], fps[None, :], bits)
                least[at : at + BLOCK] = np.where(near, labels[None, :], len(fps)).min(axis=1)
            if (least == labels).all():
                return labels
            labels = least[least]
    order = np.argsort(fps)
    known = fps[order]
    while True:
        before = labels.copy()
        for mask in _free_masks(subset, bits):
            changed = fps ^ mask
            at = np.minimum(np.searchsorted(known, changed), len(known) - 1)
            found = known[at] == changed
            other = order[at[found]]
            labels[found] = np.minimum(labels[found], labels[other])
        labels = labels[labels]
        if (labels == before).all():
            return labels


def ties(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): enough verified links between distinct fingerprints (column fp) to tie every linked group together."""
    keys = []
    for k, subset in enumerate(SUBSETS):
        mask = sum(0xFF << (8 * p) for p in subset)
        keys.append((k, mask - (1 << 64) if mask >> 63 else mask))
    posted = distinct.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(mask)) for _, mask in keys])).alias("subset", "bytes"),
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(subset: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fps = np.sort(fps)
        labels = group_labels(fps.view(np.uint64), SUBSETS[subset], bits)
        tied = labels != np.arange(len(fps))
        return fps[tied], fps[labels[tied]]

    def run(batches):
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of the list that the last batch left open

        def close(parts, last: bool):
            subset, value, fps = (np.concatenate(c) for c in zip(*parts, strict=True))
            edges = np.flatnonzero((np.diff(subset) != 0) | (np.diff(value) != 0)) + 1
            bounds = np.concatenate([[0], edges, [len(fps)]])
            if not last:
                open_from = bounds[-2]
                rest = [(subset[open_from:], value[open_from:], fps[open_from:])]
                bounds = bounds[:-1]
            else:
                rest = []
            sizes = np.diff(bounds)
            out_a, out_b = [], []
            twos = bounds[:-1][sizes == 2]
            x, y = fps[twos], fps[twos + 1]
            near = linked_pairs(x.view(np.uint64), y.view(np.uint64), bits)
            out_a.append(np.maximum(x, y)[near])
            out_b.append(np.minimum(x, y)[near])
            for k in np.flatnonzero(sizes > 2):
                a, b = linked(int(subset[bounds[k]]), fps[bounds[k] : bounds[k + 1]])
                out_a.append(a)
                out_b.append(b)
            return rest, pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], schema=schema)

        for batch in batches:
            part = tuple(batch.column(c).to_numpy() for c in range(3))
            if not len(part[0]):
                continue
            whole = kept and part[0][-1] == kept[0][0][0] and part[1][-1] == kept[0][1][0]
            kept.append(part)
            if not whole:  # else the same list goes on
                kept, out = close(kept, last=False)
                yield out
        if kept:
            yield close(kept, last=True)[1]

    met = posted.select("subset", "bytes", "fp").repartition("subset", "bytes").sortWithinPartitions("subset", "bytes")
    return met.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``: which documents are linked, directly or through others.

    Fingerprints link at ``bits`` or fewer differing bits; component_id is the smallest doc_id that can be reached, its
    own included. Null and empty texts have fingerprint zero and are linked like any other. Repeated rows are repeated
    in the result, an empty table gives an empty one, other columns are not read.
    """
    of_doc = cut(fingerprints(docs, words))
    rooted = _rooted(of_doc, bits)
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    found = cut(rooted.join(least, "root").select("fp", "component_id", "n"))
    return join_counted(of_doc, found, "fp", of_doc.count(), FREQUENT).select("doc_id", "fp", "component_id")


def _rooted(of_doc: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, first_doc, n, root) of each distinct fingerprint and its n rows: linked ones have the same root."""
    if bits != BITS:
        raise ValueError(f"the index guarantees {SHARED} shared bytes, for {BITS} bits")
    distinct = cut(of_doc.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")))
    reached = components(ties(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
    return cut(distinct.join(reached, "fp", "left").select("fp", "first_doc", "n", F.coalesce("component", "fp").alias("root")))


def near_duplicate_digests(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with the fingerprint as 16 lowercase hex digits."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group of ``docs``: with its smallest doc_id, nulls last, then the least hash of the text.

    Groups are of fingerprints, so rows with null or repeated ids belong to the group of their text, and all texts
    without words, null or empty, are one group. Of rows that have both id and text in common one stays. An empty table
    gives an empty result; other columns may have any name.
    """
    of_doc = cut(fingerprints(docs, hashed=True))
    by_group = join_counted(of_doc, _rooted(of_doc).select("fp", "root", "n"), "fp", of_doc.count(), FREQUENT).groupBy("root")
    first = by_group.agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("row"))
    key, hash_, kept_key, kept_hash = (free_name(n, docs.columns) for n in ("own_id", "own_hash", "kept_id", "kept_hash"))
    kept = first.select(F.col("row.doc_id").alias(kept_key), F.col("row.text_hash").alias(kept_hash))
    hashed = docs.withColumns({key: F.col("doc_id").cast("long"), hash_: _text_hash()})
    same = hashed[key].eqNullSafe(kept[kept_key]) & (hashed[hash_] == kept[kept_hash])
    return hashed.join(kept, same, "left_semi").dropDuplicates([key, hash_]).select(docs.columns)
