import collections
import math
import re
import zlib

import numpy as np
import pytest

from pulsewright.llm import lm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) + ["\n"]


def brute_score(tree_nodes, sequence):
    """The longest retained suffix of what came before, smoothed with its parents, byte after byte."""
    def p(context, byte):
        if context == b"":
            counts = tree_nodes[b""]
            return (counts.get(byte, 0) + 1) / (sum(counts.values()) + 255)
        counts = tree_nodes[context]
        parent = context[1:]
        while parent not in tree_nodes:
            parent = parent[1:]
        kinds = max(1, len(counts))
        return (counts.get(byte, 0) + kinds * p(parent, byte)) / (sum(counts.values()) + kinds)

    history, total = bytes([lm.PAD]) * lm.DEPTH, 0.0
    for byte in sequence:
        context = history[-lm.DEPTH :]
        while context not in tree_nodes:
            context = context[1:]
        total += math.log10(p(context, byte))
        history += bytes([byte])
    return total


def test_automaton_scores_as_the_tree_says(monkeypatch):
    monkeypatch.setattr(lm, "STRETCH", 7)
    rng = np.random.default_rng(3)
    text = bytes(rng.choice(list(b"ab c"), 4000).tolist())
    nodes = collections.defaultdict(lambda: collections.defaultdict(int))
    history = bytes([lm.PAD]) * lm.DEPTH + text
    for k in range(lm.DEPTH, len(history)):
        for d in range(lm.DEPTH + 1):
            context = history[k - d : k]
            if d < 2 or hash(context) % 3 == 0:
                nodes[context][history[k]] += 1
    nodes = {c: dict(n) for c, n in nodes.items()}
    tree = lm.SuffixTree(nodes)
    sequences = [b"\n", b"ab c a\n", b"zz ab\n", text[:50] + b"\n"]
    assert tree.score(sequences) == pytest.approx([brute_score(nodes, s) for s in sequences])


def test_base_scores_match_brute_force(odd_docs, odd_rows, no_docs, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_SHARE", 1e-3)  # most words take the way by join
    rows = [r for r in odd_rows if r[0] is not None]
    training = [t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter(x for t in training for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = lm.score_texts(odd_docs).collect()
    assert len(got) == len(odd_rows)
    texts = dict((r[0], r[1]) for r in odd_rows)
    for r in got:
        own = tokens(texts[r.doc_id])
        assert r.train_tokens == n and r.n_tokens == len(own) and r.n_known == sum(counts[x] > 0 for x in own)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in own))
        assert r.score < 0
    assert lm.score_texts(no_docs).count() == 0


def test_counts_take_every_position():
    keys, n = lm.grams([b"abc\n", b"\n", b"aaaaaaaaa\n"])
    assert n.sum() == 4 + 1 + 10


def brute_nodes(training):
    """Every context's next-byte counts; then only those whose own evidence is enough, and their suffixes."""
    every = collections.defaultdict(collections.Counter)
    for text in training:
        history = bytes([lm.PAD]) * lm.DEPTH + b" ".join(lm.words_of(text)) + b"\n"
        for k in range(lm.DEPTH, len(history)):
            for d in range(lm.DEPTH + 1):
                every[history[k - d : k]][history[k]] += 1
    kept = {b""}
    for c, counts in every.items():
        if c:
            n, above = sum(counts.values()), every[c[1:]]
            bits = sum(x * math.log2(x / n / (above[b] / sum(above.values()))) for b, x in counts.items())
            if bits >= 8 + len(counts) / 2 * math.log2(n + 1):
                kept |= {c[k:] for k in range(len(c))}
    return {c: dict(every[c]) for c in kept}


def test_scores_match_brute_force_of_own_evidence(odd_docs, odd_rows, monkeypatch):
    rows = [r for r in odd_rows if r[0] is not None]
    nodes = brute_nodes([t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    texts = {r[0]: r[1] for r in odd_rows}
    tree = lm.SuffixTree(nodes)
    for share in (5e-7, 1e-3, 2.0):  # all grams in the tasks, some, none
        monkeypatch.setattr(lm, "GRAM_SHARE", share)
        got = lm.score_texts(odd_docs).collect()
        assert len(got) == len(odd_rows)
        for r in got:
            assert r.score == pytest.approx(tree.score([b" ".join(lm.words_of(texts[r.doc_id])) + b"\n"])[0])


def test_what_else_is_in_the_corpus_drops_no_context(spark):
    rare = " ".join("xyxz" if k % 3 else "yzxx" for k in range(12))
    common = " ".join(["abc", "bca", "cab", "aab"] * 250_000)

    def contexts(texts):
        docs = spark.createDataFrame([(True, t) for t in texts], "learn boolean, text string")
        nodes = lm.retained(lm.levels(lm.corpus_counts(docs)))
        return {(d, r.context) for d, n in enumerate(nodes) for r in n.collect() if all(b in b"xyz" for b in r.context.to_bytes(d + 1))}

    alone = contexts([rare])
    assert len(alone) > 3 and alone <= contexts([rare, *[common] * 5])
