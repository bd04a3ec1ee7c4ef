import random
import re

import numpy as np
import pytest

from pulsewright.llm import components, minhash


def brute_set(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[k : k + 3]) for k in range(len(words) - 2)} or ({tuple(words)} if words else set())


def brute(rows, percent=85):
    """All pairs, by the definition."""
    sets = [brute_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            groups[root(k)] = min(groups.get(root(k), doc), doc)
    return sorted(((doc, len(sets[k]), groups.get(root(k)), doc == groups.get(root(k))) for k, (doc, _) in enumerate(rows)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def chains(seed, bases=8, texts=250, length=60):
    """Copies of copies with a few changed words, so that groups are chains; and a passage that many texts share."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    known = [[rng.choice(words) for _ in range(length)] for _ in range(bases)]
    passage = [rng.choice(words) for _ in range(length * 2)]
    rows = []
    for k in range(texts):
        text = list(rng.choice(known))
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = rng.choice(words)
        if k % 5 == 0:
            text = passage + [rng.choice(words) for _ in range(rng.choice([3, 10, 40]))]
        known.append(text)
        rows.append((k * 3 + 1, " ".join(text).title() if k % 2 else "\n".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_brute_force(spark, seed):
    rows = chains(seed)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    want = brute(rows)
    assert rows_of(got) == want
    assert 1 < len({r[2] for r in want}) < len(rows) - 20


def test_groups_in_small_chunks_match_brute_force(spark, monkeypatch):
    """The same with lists in many chunks, hubs in many groups, and few partners in the first round."""
    monkeypatch.setattr(minhash, "CHUNK", 6)
    monkeypatch.setattr(minhash, "GROUP", 3)
    monkeypatch.setattr(minhash, "PARTNERS", 1)
    rows = chains(3, bases=2, texts=160, length=40)
    assert rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_threshold_is_exact(spark):
    words = [f"v{k}" for k in range(400)]
    rows = []
    for k, kept in enumerate([90, 91, 92, 93, 94, 95]):  # 98 of 98 against sets that lose their tail
        rows += [(10 * k, " ".join(f"{k}{w}" for w in words[:100])), (10 * k + 1, " ".join(f"{k}{w}" for w in words[: kept - 6]))]
    want = brute(rows)
    assert rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert {r[0]: r[2] for r in want} == {d: (d // 10 * 10 if d % 10 == 0 or d >= 20 else d) for d, _ in rows}  # 85 * 98 / 100 = 83.3


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rows = [(r[0], r[1]) for r in odd_rows]
    assert rows_of(minhash.near_duplicates(odd_docs)) == sorted([(d, n, c, d == c) for d, n, c, _ in brute(rows)], key=str)
    assert minhash.near_duplicates(no_docs).collect() == []
    rows = [(None, "a b c d"), (None, "a b c d"), (4, "A b c d"), (4, "another text"), (7, "x y"), (8, "X y"), (9, "x y z"), (9, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got) == sorted(
        [(None, 2, 4, False), (None, 2, 4, False), (4, 2, 4, True), (4, 1, 4, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 9, True), (9, 0, 9, True)], key=str
    )
    alone = spark.createDataFrame([(None, "no id here"), (None, "no id here"), (None, "")], "doc_id long, text string")
    assert rows_of(minhash.near_duplicates(alone)) == sorted([(None, 1, None, True), (None, 1, None, True), (None, 0, None, True)], key=str)


def test_estimates_follow_resemblance():
    rng = np.random.default_rng(5)
    errors = []
    for j in (0.3, 0.6, 0.85, 0.95):
        for _ in range(20):
            both = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
            n = int(4000 * (1 - j) / 2)
            a, b = np.unique(both[n:]), np.unique(both[: 4000 - n])
            least = minhash.minima([a, b])
            bits = minhash.low_bits(least)
            errors.append(minhash.similarity(minhash.differing(bits[0], bits[1])) - j)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05
    assert minhash.similarity(minhash.most_differing()) >= 0.69 and minhash.similarity(minhash.most_differing() + 1) < 0.71


def test_minima_do_not_depend_on_the_cut():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 70_000, 3, 40_000, 1, 2, 32_768)]
    got = minhash.minima(sets)
    for k in (0, 77, 127):
        assert got[:, k].tolist() == [int((((s >> np.uint64(32)).astype(np.uint32) ^ minhash.FLIPS[k]) * minhash.FACTORS[k]).min()) for s in sets]


def test_low_bits_are_counted_natively_alike(spark):
    rng = np.random.default_rng(7)
    bits = minhash.low_bits(rng.integers(0, 1 << 32, (40, 128), dtype=np.uint32) & np.uint32(0xFFFFFFF9))
    df = spark.createDataFrame([(bits[k].tolist(), bits[k + 1].tolist()) for k in range(39)], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(minhash._differing("a", "b")).collect()] == [int(minhash.differing(bits[k], bits[k + 1])) for k in range(39)]


def test_links_of_a_group_are_exact():
    """Sets by their differences from a hub, in one chunk or in several, against all pairs."""
    rng = random.Random(9)
    hub = np.array(sorted(rng.sample(range(1 << 40), 150)), np.uint64)
    for chunks in (1, 3):
        sets = []
        for k in range(120):
            x = set(hub.tolist())
            for _ in range(rng.randrange(14)):
                x.discard(rng.choice(hub.tolist()))
                x.add(rng.randrange(1 << 40) if k % 3 else rng.randrange(40))
            sets.append(np.array(sorted(x), np.uint64))
        lacks = [np.packbits(~np.isin(hub, s)).tobytes() for s in sets]
        extras = [s[~np.isin(s, hub)].view(np.int64) for s in sets]
        linked = np.array([minhash.reaches(s, hub) for s in sets])
        n, label = np.array([len(s) for s in sets]), list(range(len(sets)))

        def join(i, j, label):
            a, b = label[i], label[j]
            label[:] = [min(a, b) if x in (a, b) else x for x in label]

        first = int(np.flatnonzero(linked)[0])
        want = [first if x else k for k, x in enumerate(linked)]
        for i in range(len(sets)):
            for j in range(i):
                if minhash.reaches(sets[i], sets[j]):
                    join(i, j, want)
        label = [first if x else k for k, x in enumerate(linked)]
        for c in range(chunks):
            here = [k for k in range(len(sets)) if not linked[k] or k % chunks == c]
            at = np.array(here)
            for i, j in minhash.group_links(len(hub), n[at], linked[at], [lacks[k] for k in here], [extras[k] for k in here], at % chunks == c):
                join(here[i], here[j], label)
        assert [label.index(x) for x in label] == [want.index(x) for x in want]
        assert 5 < len(set(want)) < 100


@pytest.mark.parametrize("bits", [1 << 26, 1 << 15])
def test_wanted_keys_are_all_found(spark, monkeypatch, bits):
    """Only texts that are wanted move: none of them is lost, and few others come along where bits are many."""
    monkeypatch.setattr(minhash, "WANTED", bits)
    docs = spark.range(20000).selectExpr("xxhash64(id) as row_key", "cast(id as string) as text", "id")
    keys = docs.filter("id % 20 = 0").select("row_key")
    found = minhash.wanted(docs, keys.union(keys))
    assert found.columns == docs.columns
    ids = [r["id"] for r in found.collect()]
    assert len(set(ids)) == len(ids) and set(range(0, 20000, 20)) <= set(ids)
    assert len(ids) < (1010 if bits > 1 << 20 else 2000)
    assert minhash.wanted(docs, keys.limit(0)).count() == 0


def test_across_joins_classes_not_postings(spark):
    """A class in many lists meets its component and home as one row; its lists are read from it afterwards."""
    held = spark.createDataFrame([(bytes([k]), [(key, b"\0", 2) for key in range(25)]) for k in range(2)], "set_id binary, lists array<struct<key: long, hub: binary, n: long>>")
    classes = spark.createDataFrame([(bytes([k]), [0] * 8) for k in range(2)], "set_id binary, planes array<long>")
    labels = spark.createDataFrame([], "node binary, component binary")
    homes = spark.createDataFrame([], "set_id binary, home binary")
    found = minhash.across(held, classes, labels, homes, minhash.most_differing(), 4).collect()
    assert [(bytes(r["a"]), bytes(r["b"]), r["spread"], r["more"]) for r in found] == [(b"\1", b"\0", 2, False)]


def test_stars_settle_in_one_round(spark, monkeypatch):
    """Components that are stars after a round need no second one to show it; a chain goes on until it is one."""
    calls, star = [], components._star
    monkeypatch.setattr(components, "_star", lambda edges, large: calls.append(large) or star(edges, large))
    found = components.components(spark.createDataFrame([(k, 50) for k in range(50, 60)] + [(k, 7) for k in range(8)], "a long, b long"))
    assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(8)] + [(k, 50) for k in range(50, 60)]
    assert len(calls) == 2
    chain = [(k, k + 1) for k in range(0, 30, 2)] + [(k + 1, k) for k in range(1, 30, 2)]
    assert sorted(map(tuple, components.components(spark.createDataFrame(chain, "a long, b long")).collect())) == [(k, 0) for k in range(31)]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_across_brings_the_keys_of_texts(spark, monkeypatch):
    held = spark.createDataFrame([(bytes([k]), [(5, b"\0", 3)]) for k in range(3)], "set_id binary, lists array<struct<key: long, hub: binary, n: long>>")
    classes = spark.createDataFrame([(bytes([k]), [0] * 8, 10 + k) for k in range(3)], "set_id binary, planes array<long>, row_key long")
    labels, homes = spark.createDataFrame([], "node binary, component binary"), spark.createDataFrame([], "set_id binary, home binary")
    for together in (1, 50_000):
        monkeypatch.setattr(minhash, "TOGETHER", together)
        found = minhash.across(held, classes, labels, homes, minhash.most_differing(), minhash.EVERY).collect()
        assert {(r["a"][0], r["b"][0], r["a_key"], r["b_key"], r["more"]) for r in found} == {(a, b, 10 + a, 10 + b, False) for a in range(3) for b in range(a)}
