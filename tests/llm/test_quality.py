import collections
import re

import numpy as np

from pulsewright.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_counts_match_brute_force(odd_docs, odd_rows, labels, no_labels, no_docs):
    field = quality.fit(odd_docs, labels)
    got = {r.doc_id: r for r in quality.judge(odd_docs, field).collect()}
    for doc, text, *_ in odd_rows:
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text or "")
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = quality.keep_good(odd_docs, field)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}
    assert quality.judge(no_docs, quality.fit(no_docs, no_labels)).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    field = quality.LineField(rng.normal(size=quality.N_FEATURES), rng.normal(size=(2, 2)))
    docs = [rng.normal(size=(n, quality.N_FEATURES)) for n in (1, 4, 6, 0)]
    for x, path in zip(docs, field.viterbi(docs), strict=True):
        best = None
        for code in range(1 << len(x)):
            states = [code >> k & 1 for k in range(len(x))]
            score = sum(x[k] @ field.weights for k in range(len(x)) if states[k]) + sum(field.turn[a, b] for a, b in zip(states, states[1:], strict=False))
            if best is None or score > best[0] + 1e-12:
                best = (score, states)
        assert path.tolist() == (best[1] if len(x) else [])


GOOD = [b"An ordinary line of words, as people write them.", b"Another one follows it and ends as well.", b"So it goes."]
BAD = [b"BUY!! NOW!! ### $$$ &&& MORE!! AND!! MORE!!", b"| a | b | c | d |", b"ONLY### TODAY### $$$"]


def test_fit_tells_kinds_of_lines_apart():
    x = [quality.line_features(GOOD), quality.line_features(BAD)] * 20
    field = quality.LineField().fit(x, [np.ones(3, int), np.zeros(3, int)] * 20)
    states = field.viterbi([quality.line_features(GOOD), quality.line_features(BAD)])
    assert states[0].all() and not states[1].any()


def test_changes_of_state_are_learned_from_labels_of_documents():
    mixed = [GOOD[0], *BAD, *BAD]
    docs = [GOOD] * 4 * 10 + [BAD, BAD * 2, BAD, mixed] * 10
    x = [quality.line_features(d) for d in docs]
    field = quality.learn(x, [np.array([len(line.split()) for line in d]) for d in docs], np.array([1] * 40 + [0] * 40))
    alternating = [line for pair in zip(GOOD, BAD, strict=True) for line in pair]
    got = field.viterbi([quality.line_features(d) for d in (mixed, alternating, [b"", b""])])
    assert got[0].tolist() == [1] + [0] * 6 and got[1].tolist() == [1, 0] * 3
    shares = quality.verdicts([b"\n".join(d).decode() for d in (mixed, alternating, GOOD, BAD)], field).content_share.tolist()
    assert 0 < shares[0] < 0.5 and 0 < shares[1] < 1 and shares[2:] == [1, 0]


def test_braided_lines_keep_their_states():
    docs, states = [np.full((5, 1), 1.0), np.full((3, 1), 0.0)], [np.ones(5, int), np.zeros(3, int)]
    x, y = quality.braided(docs, states)
    assert len(x) == 1 and x[0][:, 0].tolist() == y[0].tolist() and sorted(y[0]) == [0] * 3 + [1] * 5
    assert quality.braided(docs[:1], states[:1]) == ([], [])


def test_one_kind_of_label_makes_all_content():
    x = [quality.line_features(BAD)]
    assert quality.learn(x, [np.array([1, 1, 1])], np.array([0])).viterbi(x)[0].tolist() == [1, 1, 1]
