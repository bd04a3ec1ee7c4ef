"""b-bit MinHash: near-duplicates by resemblance of shingle sets.

Each text has 128 minima of its shingles' hashes. Bands of five minima list candidates; of every minimum the four low bits
are retained and packed as bit planes, so that the resemblance of two texts, corrected for low bits that agree by chance,
is a count of bits. Candidates that could reach the threshold are confirmed on their full shingle sets.

Equal sets are one class. Each list has one hub, the class that meets most others, and each class goes to the hub it shares
most lists with, so a list that a third of all texts share costs one pair for each. There its set is taken apart into what
the hub's set has too and what it hasn't; within a hub's group these differences tell the exact intersection of any two
sets, by counts of bits and of shared extras, so all links of a group are found without moving texts again. Two classes of
different hubs look each other up in their lists: each its likeliest partners in every other component, more of them in
every round, until a round leaves none out. Lists and groups are dealt out in chunks of bounded size.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from pulsewright.llm.common import join_counted, pairs, stored
from pulsewright.llm.components import components

WORDS, PERCENT = 3, 85
#: Two sets that reach the threshold miss every band in 1 of 2 million cases.
HASHES, BANDS, ROWS = 128, 25, 5
LOW = 4
#: Standard errors below the threshold that an estimate may be: 3 of a million pairs at the threshold are estimated lower.
SLACK = 4.5
#: Rows of a chunk of a list, texts of a group that meet one hub, partners of a class in another component at first.
CHUNK, GROUP, PARTNERS = 4096, 256, 4
#: More partners than any chunk has; pairs that a chunk hands on at a time.
EVERY, TOGETHER = 1 << 62, 50_000
#: Shingles of a hub for which a chunk is that large; with more it has fewer rows.
CHUNK_SHINGLES = 1024
FREQUENT = 1e-4
#: Bits that tell which rows' texts are wanted, 8 MB: so many that few others share one, however large the corpus.
WANTED = 1 << 26
#: Elements that are hashed together, so that they stay in a processor's cache; words whose hashes a task remembers.
STEP, KNOWN = 1 << 15, 500_000
_RNG = np.random.default_rng(11)
FACTORS = _RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
FLIPS = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = x = xxh64_intdigest(word)
        return x


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * P2
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, known: WordHashes, words: int = WORDS) -> np.ndarray:
    """Ascending 64-bit hashes of the text's distinct word shingles; of its whole sequence if it has fewer words, none without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII blanks
    n = min(words, len(tokens))
    hashes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    out = np.full(max(0, len(tokens) - n + 1) if n else 0, n, np.uint64)
    for k in range(n):
        out = _mixed(out * P1 + hashes[k : k + len(out)] + P3)
    return np.unique(out)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of each hash function over each set, none of which is empty."""
    out = np.full((len(sets), HASHES), np.iinfo(np.uint32).max, np.uint32)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(sizes)
    joined = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32) if sets else np.zeros(0, np.uint32)
    for at in range(0, len(joined), STEP):
        part = joined[at : at + STEP]
        first = int(np.searchsorted(ends, at, side="right"))
        last = int(np.searchsorted(ends, at + len(part) - 1, side="right"))
        starts = np.maximum(ends[first : last + 1] - sizes[first : last + 1] - at, 0)
        for k in range(HASHES):
            least = np.minimum.reduceat((part ^ FLIPS[k]) * FACTORS[k], starts)
            np.minimum(out[first : last + 1, k], least, out=out[first : last + 1, k])
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A number for each band of each row, that holds the band and its minima."""
    own = least[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + P3, own.shape[:2])
    for k in range(ROWS):
        key = _mixed(key * P1 + own[:, :, k])
    return key.view(np.int64)


def low_bits(least: np.ndarray) -> np.ndarray:
    """The low bits of all minima, packed as LOW planes of HASHES bits: two longs for each plane."""
    planes = (least[:, None, :] >> np.arange(LOW, dtype=np.uint32)[None, :, None] & np.uint32(1)).astype(np.uint8)
    return np.packbits(planes, axis=2).reshape(len(least), -1).view(np.int64)


def similarity(differing):
    """Resemblance for a number of minima whose low bits differ, corrected for those that agree by chance."""
    chance = 1 / (1 << LOW)
    return ((HASHES - differing) / HASHES - chance) / (1 - chance)


def most_differing(percent: int = PERCENT, slack: float = SLACK) -> int:
    """The most minima that may differ in candidates: ``slack`` standard errors beyond the threshold."""
    agree = percent / 100 + (1 - percent / 100) / (1 << LOW)
    error = np.sqrt(agree * (1 - agree) / HASHES) / (1 - 1 / (1 << LOW))
    return max(d for d in range(HASHES + 1) if similarity(d) >= percent / 100 - slack * error or d == 0)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima differ in their low bits, by bit counts over the planes of rows of ``a`` and ``b``."""
    x = (a ^ b).view(np.uint64)
    planes = x.reshape(*x.shape[:-1], LOW, HASHES // 64)
    return np.bitwise_count(np.bitwise_or.reduce(planes, axis=-2)).sum(axis=-1, dtype=np.int64)


def _differing(a: str, b: str) -> Column:
    words = HASHES // 64
    each = []
    for w in range(words):
        bits = None
        for p in range(LOW):
            x = F.col(a)[p * words + w].bitwiseXOR(F.col(b)[p * words + w])
            bits = x if bits is None else bits.bitwiseOR(x)
        each.append(F.bit_count(bits))
    return sum(each[1:], each[0])


def _keyed(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, text): the key tells rows apart that differ in id or text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.xxhash64(doc_id, doc_id.isNull(), text).alias("row_key"), doc_id.alias("doc_id"), text.alias("text"))


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, row_key, n_shingles, set_id, bands, planes) of every row; equal sets have equal set_ids."""

    def run(batches):
        known = WordHashes()
        for batch in batches:
            at = 0
            for ids, texts in pairs([pa.RecordBatch.from_arrays([batch.column(1), batch.column(2)], ["doc_id", "text"])]):
                sets = [shingles(t, known, words) for t in texts]
                full = np.array([len(s) > 0 for s in sets], bool)
                least = np.zeros((len(sets), HASHES), np.uint32)
                least[full] = minima([s for s in sets if len(s)])
                bands, planes = band_keys(least), low_bits(least)
                offsets = [pa.array(np.arange(len(sets) + 1) * w, pa.int32()) for w in (bands.shape[1], planes.shape[1])]
                columns = [
                    pa.array(ids, pa.int64()), batch.column(0).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(offsets[0], pa.array(bands.ravel())), pa.ListArray.from_arrays(offsets[1], pa.array(planes.ravel())),
                ]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "n_shingles", "set_id", "bands", "planes"])

    return _keyed(docs).mapInArrow(run, "doc_id long, row_key long, n_shingles long, set_id binary, bands array<long>, planes array<long>")


def reaches(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two ascending sets reach the threshold, exactly."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def wanted(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` (row_key, ...) with a key in ``keys`` (row_key), and few others: each key sets one bit of a bounded number, which go to every task."""
    bit = F.pmod("row_key", F.lit(WANTED)) + 1
    bucket, place = F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit)
    bits = keys.groupBy(bucket).agg(F.bitmap_construct_agg(place).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    is_set = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1
    return docs.select("*", bucket).join(F.broadcast(bits), "bucket").filter(is_set).select(docs.columns)


def _met(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(hub, salt, role, set_id, text), sorted, for pairs (a, b, a_key, b_key, spread): every text ``a`` beside its hub ``b``, whose own text comes first.

    A hub with ``spread`` texts or so is met in as many groups as they need.
    """
    groups = F.ceil(F.col("spread") / GROUP)
    salted = found.withColumn("salt", F.xxhash64(groups, F.pmod(F.xxhash64("a"), groups)))
    members = salted.select(F.col("a_key").alias("row_key"), F.col("b").alias("hub"), "salt", F.lit(1).alias("role"), F.col("a").alias("set_id"))
    hubs = salted.select(F.col("b_key").alias("row_key"), F.col("b").alias("hub"), "salt", F.lit(0).alias("role"), F.col("b").alias("set_id")).distinct()
    parts = members.union(hubs)
    met = wanted(_keyed(docs).drop("doc_id"), parts.select("row_key")).join(parts, "row_key").select("hub", "salt", "role", "set_id", "text")
    return met.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")


def _beside_hubs(batches, words: int):
    """For each batch of ``_met``: (hub, its set, set_id, that set) of its members."""
    known, hub, own = WordHashes(), None, None
    for batch in batches:
        out = []
        hubs, _, roles, ids, texts = batch.columns
        for k in range(batch.num_rows):
            held = shingles(texts[k].as_py(), known, words)
            if roles[k].as_py() == 0:
                hub, own = hubs[k].as_py(), held
            elif hubs[k].as_py() == hub:
                out.append((hub, own, ids[k].as_py(), held))
        yield out


def confirmed(docs: DataFrame, found: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b) of the pairs in ``found`` (a, b, a_key, b_key, spread) whose full sets reach the threshold."""

    def run(batches):
        for rows in _beside_hubs(batches, words):
            links = [(a, hub) for hub, own, a, held in rows if reaches(held, own, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])

    return _met(docs, found).mapInArrow(run, "a binary, b binary").distinct()


def taken_apart(docs: DataFrame, found: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(hub, set_id, n_hub, n, linked, missing, extras): each class of ``found`` by what its set differs in from its hub's.

    ``missing`` has a bit for each shingle of the hub, in ascending order; ``extras`` are hashes that the hub hasn't.
    """
    names = ["hub", "set_id", "n_hub", "n", "linked", "missing", "extras"]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64())]

    def run(batches):
        for rows in _beside_hubs(batches, words):
            out = []
            for hub, own, a, held in rows:
                if len(own) and len(held):
                    has = held[np.minimum(np.searchsorted(held, own), len(held) - 1)] == own
                    there = own[np.minimum(np.searchsorted(own, held), len(own) - 1)] == held
                    out.append((hub, a, len(own), len(held), reaches(held, own, percent), np.packbits(~has).tobytes(), held[~there].view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names)

    made = _met(docs, found).mapInArrow(run, "hub binary, set_id binary, n_hub long, n long, linked boolean, missing binary, extras array<long>")
    return made.dropDuplicates(["set_id"])


def group_links(n_hub: int, n: np.ndarray, linked: np.ndarray, missing: list[bytes], extras: list[np.ndarray], own: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (i, j) that tie together all linked sets of a group, apart from those to the hub; exact.

    Sets that are linked with the hub are tied already. Of the others only those look up their links that are ``own``
    here or the partner is linked.
    """
    m = len(n)
    words = -(-(-(-n_hub // 8)) // 8)
    bits = np.frombuffer(b"".join(x.ljust(8 * words, b"\0") for x in missing), np.uint64).reshape(m, words)
    sizes = np.fromiter(map(len, extras), np.int64, m)
    values, owner = np.concatenate([*extras, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    root = np.where(linked, int(np.flatnonzero(linked)[0]) if linked.any() else 0, np.arange(m))
    out = []
    lacks = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    for i in np.flatnonzero(~linked):
        # no two sets have more in common than the hub's part that both might have and the fewer extras
        most = n_hub - np.maximum(lacks, lacks[i]) + np.minimum(sizes, sizes[i])
        can = (root != root[i]) & (linked | own[i]) & (100 * most >= percent * (n + n[i] - most))
        if not can.any():
            continue
        at = np.flatnonzero(can)
        both = n_hub - np.bitwise_count(bits[at] | bits[i]).sum(axis=1, dtype=np.int64)
        lo, hi = np.searchsorted(values, extras[i], side="left"), np.searchsorted(values, extras[i], side="right")
        if (hi - lo).sum() > len(extras[i]):  # besides its own
            shared = np.concatenate([owner[a:b] for a, b in zip(lo, hi, strict=True)])
            both = both + np.bincount(shared, minlength=m)[at]
        for j in at[100 * both >= percent * (n[at] + n[i] - both)]:
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((int(i), int(j)))
    return out


def within_groups(apart: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that tie together the linked classes of each hub's group (``taken_apart``), those to the hub included."""
    to_hub = apart.filter("linked").select(F.col("set_id").alias("a"), F.col("hub").alias("b"))
    groups = apart.groupBy("hub").agg(F.count(F.lit(1)).alias("m"), F.count_if(~F.col("linked")).alias("others")).filter("others > 0 and m > 1")
    chunks = F.ceil(F.col("m") * F.greatest(F.lit(1.0), F.col("n_hub") / CHUNK_SHINGLES) / CHUNK)
    own = apart.join(groups, "hub").withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("long"))
    dealt = own.withColumn("chunk", F.explode(F.when(F.col("linked"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))

    def run(batches):
        for table, a, b in _runs(batches, ("hub", "chunk")):
            part = table.slice(a, b - a)
            ids, n = part.column("set_id").to_pylist(), part.column("n").to_numpy()
            linked, own_ = (part.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("linked", "here"))
            extras = [x.values.to_numpy() for x in part.column("extras")]
            found = group_links(part.column("n_hub")[0].as_py(), n, linked, part.column("missing").to_pylist(), extras, own_, percent)
            yield pa.RecordBatch.from_arrays([pa.array([ids[x[k]] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    met = dealt.select("hub", "chunk", "set_id", "n_hub", "n", "linked", (F.col("own") == F.col("chunk")).alias("here"), "missing", "extras")
    return to_hub.union(met.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk").mapInArrow(run, "a binary, b binary"))


def _runs(batches, keys: tuple[str, ...]):
    """(table, begin, end) of each run of equal keys in sorted batches."""
    kept: list[pa.RecordBatch] = []

    def bounds_of(table: pa.Table) -> np.ndarray:
        new = np.zeros(max(0, len(table) - 1), bool)
        for key in keys:
            column = table.column(key).combine_chunks()
            new |= pc.not_equal(column.slice(1), column.slice(0, max(0, len(column) - 1))).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.flatnonzero(new) + 1, [len(table)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        goes_on = kept and all(batch.column(k)[batch.num_rows - 1] == kept[0].column(k)[0] for k in keys)
        kept.append(batch)
        if not goes_on:
            table = pa.Table.from_batches(kept).combine_chunks()
            bounds = bounds_of(table)
            for a, b in zip(bounds[:-2], bounds[1:-1], strict=True):
                yield table, int(a), int(b)
            kept = table.slice(int(bounds[-2])).to_batches()
    if kept:
        table = pa.Table.from_batches(kept).combine_chunks()
        bounds = bounds_of(table)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield table, int(a), int(b)


def starred(shared: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """(a, b, a_key, b_key, spread): each class with the hub that it shares most bands with, if the estimate allows a link."""
    met = shared.filter("set_id <> hub").groupBy("set_id", "hub").agg(F.count(F.lit(1)).alias("bands"), F.max("n").alias("spread"))
    for side, name in (("a", "set_id"), ("b", "hub")):
        met = met.join(classes.select(F.col("set_id").alias(name), F.col("planes").alias(f"{side}_planes"), F.col("row_key").alias(f"{side}_key")), name)
    likely = met.filter(_differing("a_planes", "b_planes") <= most)
    best = likely.groupBy("set_id").agg(F.max(F.struct("bands", "hub", "a_key", "b_key", "spread")).alias("best"))
    return best.select(F.col("set_id").alias("a"), F.col("best.hub").alias("b"), "best.a_key", "best.b_key", "best.spread")


def _likely(ids: list, label: np.ndarray, home: np.ndarray, planes: np.ndarray, rest: np.ndarray, own: np.ndarray, most: int, partners: int):
    """(i, j, whether more were left) of a chunk's rows: for each one of ``rest`` the likeliest of each other label, ``partners`` at most.

    Of ``rest`` among themselves only those look that are this chunk's ``own``; rows of one home have met there.
    """
    for i in np.flatnonzero(rest):
        away = differing(planes[i], planes)
        near = np.flatnonzero((away <= most) & (label != label[i]) & (home != home[i]) & (~rest | own[i]))
        if len(near):
            near = near[np.lexsort((near, away[near], label[near]))]
            first = np.flatnonzero(np.append(True, label[near][1:] != label[near][:-1]))
            rank = np.arange(len(near)) - np.repeat(first, np.diff(np.append(first, len(near))))
            more = bool((rank >= partners).any())
            for j in near[rank < partners]:
                yield i, j, more


def across(held: DataFrame, classes: DataFrame, labels: DataFrame, homes: DataFrame, most: int, partners: int) -> DataFrame:
    """(a, b, spread, more) of likely pairs between components and homes, in lists that hold several; ``more`` where partners were left out.

    Where ``classes`` have a row_key, a_key and b_key come along.
    ``held`` has a row for each class, with its lists: it meets its component and home as one row, not once for each list.
    """
    placed = held.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").join(homes, "set_id", "left")
    labelled = placed.select("set_id", F.coalesce("component", "set_id").alias("label"), F.coalesce("home", "set_id").alias("home"), F.inline("lists"))
    ends = lambda c: [F.min(c).alias(f"least_{c}"), F.max(c).alias(f"greatest_{c}")]
    open_ = labelled.groupBy("key").agg(*ends("label"), *ends("home"), F.max(F.when(F.col("set_id") == F.col("hub"), F.col("label"))).alias("main"))
    open_ = open_.filter("least_label <> greatest_label and least_home <> greatest_home")
    own_chunk = F.pmod(F.xxhash64("set_id"), F.ceil(F.col("n") / CHUNK)).cast("long")
    keyed = "row_key" in classes.columns
    with_key = ["set_id", "planes", *(["row_key"] if keyed else [])]
    rows = labelled.join(open_.select("key", "main"), "key").join(classes.select(*with_key), "set_id").select(
        "key", "label", "home", (F.col("label") != F.col("main")).alias("rest"), "n", own_chunk.alias("own"), *with_key
    )
    dealt = rows.withColumn("chunk", F.explode(F.when(F.col("rest"), F.sequence(F.lit(0), F.ceil(F.col("n") / CHUNK) - 1)).otherwise(F.array("own"))))

    def run(batches):
        numbers = lambda column: np.unique(np.array(column.to_pylist(), object), return_inverse=True)[1]
        for table, a, b in _runs(batches, ("key", "chunk")):
            part = table.slice(a, b - a)
            if b - a == 1:
                continue
            ids = part.column("set_id").to_pylist()
            planes = part.column("planes").combine_chunks().flatten().to_numpy().reshape(b - a, -1)
            if b - a == 2 and differing(planes[0], planes[1]) > most:
                continue
            rest = part.column("rest").combine_chunks().to_numpy(zero_copy_only=False)
            own = part.column("own").to_numpy() == part.column("chunk").to_numpy()
            row_keys = part.column("row_key").to_numpy() if keyed else None
            spread = part.column("n")[0].as_py()
            likely = _likely(ids, numbers(part.column("label")), numbers(part.column("home")), planes, rest, own, most, partners)
            while found := list(islice(likely, TOGETHER)):
                x, y = (np.array([i if (ids[i] > ids[j]) == larger else j for i, j, _ in found]) for larger in (True, False))
                columns = [pa.array([ids[k] for k in x], pa.binary()), pa.array([ids[k] for k in y], pa.binary()), pa.array([spread] * len(found), pa.int64()), pa.array([f[2] for f in found], pa.bool_())]
                columns += [pa.array(row_keys[k]) for k in (x, y)] if keyed else []
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "spread", "more", *key_names])

    key_names = ["a_key", "b_key"] if keyed else []
    schema = ", ".join(["a binary, b binary, spread long, more boolean", *(f"{c} long" for c in key_names)])
    met = dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk").mapInArrow(run, schema)
    return met.groupBy("a", "b").agg(F.max("spread").alias("spread"), F.max("more").alias("more"), *[F.max(c).alias(c) for c in key_names])


def linked_classes(docs: DataFrame, classes: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the classes (set_id, row_key, bands, planes) that are linked with another one."""
    most = most_differing(percent)
    posted = classes.select(F.explode("bands").alias("key"), "set_id")
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stored(posted.join(lists, "key"))
    meetings = met.groupBy("set_id").agg(F.sum("n").alias("meetings"))
    hubs = met.join(meetings, "set_id").groupBy("key").agg(F.max(F.struct("meetings", "set_id")).alias("hub"))
    shared = stored(met.join(hubs, "key").select("key", "set_id", F.col("hub.set_id").alias("hub"), "n"))
    held = stored(shared.groupBy("set_id").agg(F.collect_list(F.struct("key", "hub", "n")).alias("lists")))  # BANDS lists at most
    apart = stored(taken_apart(docs, stored(starred(shared, classes, most)), words, percent))
    homes = apart.select("set_id", F.col("hub").alias("home"))
    links = stored(within_groups(apart, percent))
    labels = components(links)
    partners = PARTNERS
    while True:
        found = stored(across(held, classes, labels, homes, most, partners))
        if found.isEmpty():
            return labels
        more = not found.filter("more").isEmpty()
        new = stored(confirmed(docs, found.drop("more"), words, percent))
        tied = not new.isEmpty()
        if tied:
            links = links.union(new)
            labels = components(links)
        if not more:
            return labels
        # where the likeliest aren't linked, the others seldom are: all of them are looked up at once, as rounds would have to
        partners = partners * 8 if tied else EVERY


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Two rows link when 100 times the intersection of their shingle sets is at least ``percent`` times the union;
    component_id is the smallest doc_id that can be reached, its own included, and the row that has it is kept. A null
    text, an empty one and one of blanks have no shingles and link with nothing. A row without doc_id belongs to the
    group of its text; where a whole group has no ids its component_id is null and its rows are kept. Rows that repeat
    are returned each on its own, other columns are not read, an empty table gives an empty result.
    """
    of_doc = stored(signatures(docs, words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    by_set = of_doc.filter("n_shingles > 0").groupBy("set_id").agg(first, F.count(F.lit(1)).alias("rows"), F.first("bands").alias("bands"), F.first("planes").alias("planes"))
    classes = stored(by_set.select("set_id", "first.doc_id", "first.row_key", "rows", "bands", "planes"))
    reached = linked_classes(docs, classes, words, percent).select(F.col("node").alias("set_id"), "component")
    rooted = classes.select("set_id", "doc_id", "rows").join(reached, "set_id", "left").withColumn("root", F.coalesce("component", "set_id"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = stored(rooted.join(least, "root").select("set_id", "component_id", F.col("rows").alias("n")))
    own = of_doc.select("doc_id", "n_shingles", "set_id")
    filled = join_counted(own.filter("n_shingles > 0"), found, "set_id", of_doc.count(), FREQUENT)
    both = filled.select("doc_id", "n_shingles", "component_id").union(own.filter("n_shingles = 0").select("doc_id", "n_shingles", "doc_id"))
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
