import itertools
import random
import re

import numpy as np
import xxhash

from pulsewright.llm import simhash
from pulsewright.llm.components import components


def brute_fingerprint(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_labels(fps, bits=3):
    fps, labels = np.array(fps, np.uint64), np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
    while True:
        least = np.where(near, labels[None, :], len(fps)).min(axis=1)
        if (least == labels).all():
            return labels
        labels = least


def test_fingerprints_match_the_definition(odd_rows):
    for _, text, *_ in odd_rows:
        assert simhash.fingerprint(text or "") & (1 << 64) - 1 == brute_fingerprint(text)


def test_groups_match_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    rows, base = [], [[rng.choice(words) for _ in range(40)] for _ in range(12)]
    for k in range(150):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            text[rng.randrange(40)] = rng.choice(words)
        rows.append((k * 3, " ".join(text)))
    got = {r.doc_id: r for r in simhash.near_duplicate_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    for (doc, _), fp, label in zip(rows, fps, brute_labels(fps), strict=True):
        assert (got[doc].fingerprint, got[doc].component_id) == (f"{fp:016x}", rows[label][0])


def test_any_three_positions_leave_one_list_whole():
    assert len(simhash.SUBSETS) == 14
    for differ in itertools.combinations(range(8), 3):
        assert sum(not set(differ) & set(s) for s in simhash.SUBSETS) == 1


def test_tally_of_shared_bytes():
    rng = random.Random(6)
    a = [rng.getrandbits(64) for _ in range(500)]
    b = [x ^ rng.choice([0, 1 << rng.randrange(64), rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64), 0xFF << 8 * rng.randrange(8), 0x80]) for x in a]
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    shared = [sum(u >> 8 * k & 255 == v >> 8 * k & 255 for k in range(8)) for u, v in zip(a, b, strict=True)]
    assert simhash.shared_bytes(x, y).tolist() == shared
    assert simhash.linked_pairs(x, y).tolist() == [(u ^ v).bit_count() <= 3 for u, v in zip(a, b, strict=True)]


def test_dense_lists_agree_with_looking_up_changes(monkeypatch):
    rng = random.Random(1)
    base, subset = rng.getrandbits(64), simhash.SUBSETS[0]
    free = [8 * p + b for p in range(8) if p not in subset for b in range(8)]
    fps = {base ^ sum(1 << b for b in rng.sample(free[:20], rng.randrange(7))) for _ in range(700)}
    fps = np.array(sorted(fps), np.uint64)
    dense = simhash.group_labels(fps, subset)
    monkeypatch.setattr(simhash, "DENSE", 10)
    assert (simhash.group_labels(fps, subset) == dense).all()
    assert (dense == brute_labels(fps)).all()


def test_frequent_fingerprints_and_columns_of_any_name(spark, monkeypatch):
    rows = [(k, " ".join(f"t{k % 7 * (k % 3)}w{j}" for j in range(40)), k, k) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own_id_0 long, kept_HASH_0 long")
    want = sorted(simhash.near_duplicates(docs).collect())
    monkeypatch.setattr(simhash, "FREQUENT", 0.1)
    assert sorted(simhash.near_duplicates(docs).collect()) == want and len(want) == 60
    kept = simhash.keep_first(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({r.component_id for r in want})


def test_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 5 in ids and 6 not in ids
    assert None in ids and simhash.keep_first(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + k, 201 + k) for k in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_one_row_of_each_group_stays_without_or_with_repeated_ids(spark):
    def text(k):
        return " ".join(f"t{k}w{j}" for j in range(40))

    rows = [(None, text(1)), (None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(4)), (None, text(4)), (3, text(5)), (9, text(5))]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.text, r.doc_id) for r in kept if r.doc_id is not None) == sorted([(text(3), 7), (text(4), 7), (text(5), 3)])
    assert sorted(r.text for r in kept if r.doc_id is None) == sorted([text(1), text(2)])
