import numpy as np
import pytest

from pulsewright.llm import classifier


def test_chunks_hold_every_window():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 517, 518, 519, 2000):
        text = bytes(rng.integers(1, 256, n, dtype=np.uint8))
        chunks, valid, owner = classifier.chunks_of([text])
        size = max(1, n)
        assert valid.sum() == max(1, -(-(size - classifier.WINDOW) // classifier.STEP) + 1)
        assert set(text) <= set(chunks.ravel().tolist()) and (owner == 0).all()


def test_gradients():
    rng = np.random.default_rng(1)
    net = classifier.ByteNetwork()
    net.out = rng.normal(0, 0.3, len(net.out)).astype(np.float32)
    texts = [bytes(rng.integers(0, 256, k, dtype=np.uint8)) for k in (0, 3, 700, 1500)]
    y = np.array([0, 1, 0, 1], np.float32)

    def loss():
        p = net.probabilities(texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for values, grad in zip(net.parameters(), net._gradients(texts, y), strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        was = values[at]
        values[at] = was + 1e-2
        up = loss()
        values[at] = was - 1e-2
        down = loss()
        values[at] = was
        assert (up - down) / 2e-2 == pytest.approx(float(grad[at]), rel=0.1, abs=1e-3)


def test_learns_held_out_kinds_of_text():
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    good = [" ".join(word() for _ in range(80)).encode() for _ in range(60)]
    bad = ["$$$ ".join(word() for _ in range(80)).encode() for _ in range(60)]
    net = classifier.ByteNetwork().fit(good[:40] + bad[:40], np.array([1] * 40 + [0] * 40, np.float32), epochs=10)
    assert net.probabilities(good[40:]).min() > net.probabilities(bad[40:]).max()


def test_odd_rows(odd_docs, odd_rows, labels, no_labels, no_docs):
    net = classifier.fit(odd_docs, labels, rows=20)
    got = classifier.classify(odd_docs, net).collect()
    assert len(got) == len(odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert classifier.classify(no_docs, classifier.fit(no_docs, no_labels)).count() == 0
