import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from pulsewright.llm import packing
from pulsewright.llm.memo import Recent

PATH = P.path("byte_bpe_50k.json")


def brute_bins(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in range(len(left)) if left[b] >= n]
        if fits:
            left[min(fits, key=lambda b: left[b])] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


def test_plan_is_what_single_placing_gives():
    rng = random.Random(3)
    for _ in range(400):
        capacity = rng.choice([5, 16, 17, 64, 100])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(60))]
        counts = Counter(lengths)
        plan, used, cells = packing.best_fit_plan(counts, capacity), Counter(), set()
        for n in counts:
            rows = plan[plan[:, 0] == n]
            for k in range(counts[n]):
                _, first, sequence, each, offset = rows[np.searchsorted(rows[:, 1], k, side="right") - 1].tolist()
                s, o = sequence + (k - first) // each, offset + (k - first) % each * n
                used[s] += n
                assert not cells & {(s, c) for c in range(o, o + n)}
                cells |= {(s, c) for c in range(o, o + n)}
        assert all((s, c) in cells for s in used for c in range(used[s]))
        assert sorted(capacity - v for v in used.values()) == brute_bins(lengths, capacity)


def test_pieces():
    assert packing.pieces_of(1, 10) == [(0, 1)] and packing.pieces_of(10, 10) == [(0, 10)]
    assert packing.pieces_of(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.pieces_of(20, 10) == [(0, 10), (10, 10)]


def test_odd_rows(odd_docs, odd_rows, no_docs):
    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.pack_digests(odd_docs, PATH, 512).collect()
    want = Counter()
    for doc, text, *_ in odd_rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (start, n) in enumerate(packing.pieces_of(len(ids), 512)):
            want[doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 512
    assert len(places) == len(brute_bins([r.length for r in rows], 512))
    assert packing.pack(no_docs, PATH).count() == 0
    assert max(len(r.ids) for r in packing.pack(odd_docs, PATH, 512).collect()) == 512


def test_workers_retain_no_chunks(spark):
    """A worker that has packed goes on to other stages; the chunks that its task remembered are gone by then."""
    path = P.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(k, f"one two word{k} word{k + 1}") for k in range(400)], "doc_id long, text string").repartition(4)
    packing.pack_digests(docs, path).collect()

    def held(batches):
        for _ in batches:
            pass
        for memo in packing._MEMOS.values():
            yield pa.RecordBatch.from_arrays([pa.array([len(m.young) + len(m.old) for m in (memo.chunks, memo.heads)])], ["n"])

    found = [r["n"] for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()]
    assert found and not any(found)


def test_simple_chunks_are_cut_and_spelled_alike():
    """Chunks of plain letters, digits and symbols skip the tokenizer's own pattern; their ids are the tokenizer's."""
    rng, tokenizer = random.Random(5), Tokenizer.from_file(PATH)
    parts = ["the", "Word", "é", "ß", "Ȁɏ", "ñandú", "日本", "Ω", "7", "2024", ".", "...", ",", "###", "$$$", "<|", "|>", "-", "'s", "'", "“", "×", "\n", "\n", "\t", "\x7f", "́", "²", "_", "~`", "ͅ"]
    chunks = list(dict.fromkeys("".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(6000)))
    memo = packing.memo(PATH)
    chunks = [c for c in chunks if memo.alone(c)]
    simple = [c for c in chunks if packing.SIMPLE(" " + c)]
    assert 500 < len(simple) < len(chunks) - 500
    for some in (simple, chunks):
        want = tokenizer.encode_batch([" " + c for c in some], add_special_tokens=False)
        assert [np.frombuffer(b, "<u4").tolist() for b in memo.encode_all(some)] == [e.ids for e in want]


def test_memo_takes_keys_back():
    """A key in use survives when the memo is full, is made once, and both halves stay bounded."""
    made, memo = [], Recent(10)
    for k in range(40):
        found = memo.of({"often", f"a{k}", f"b{k}"}, lambda keys: made.extend(keys) or [x.upper() for x in keys])
        assert found["often"] == "OFTEN" and found[f"a{k}"] == f"A{k}"
        assert len(memo.young) <= 10 and len(memo.old) <= 13
    assert made.count("often") == 1 and len(made) == 81
