import itertools
import random
import re
import time

import numpy as np
import pytest

from pulsewright.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    found = []
    for k, pattern in enumerate(PATTERNS.values()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (
                lambda: True,
                lambda: all(int(p) <= 255 for p in m.group().split(".")),
                lambda: 14 <= len(digits) <= 19 and pii.luhn(digits),
                lambda: 10 <= len(digits) <= 15,
            )[k]()
            if good:
                found.append((m.start(), k, m.end()))
    return sorted(found)


@pytest.mark.parametrize("alphabet", ["a@.1+- ", "0123.@", "@a.-%", "+1 ()-.9x", "123456789 -"])
def test_matches_are_those_of_the_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    began = time.process_time()
    pii.base_spans("1" * 200_000 + "a" * 200_000 + "@" * 50_000 + "+1" + " " * 100_000)
    pii.graph(["a" * 400_000 + "1"], [[]])
    assert time.process_time() - began < 5


CORPUS = [
    f"Some words and bob.{k}@mail{k % 3}.example.com then host 10.{k}.3.77 of version 4.{k}, about {k * 37} things, call +1 ({900 + k}) 555-{1000 + 7 * k} or so."
    for k in range(40)
] + [f"Only numbers here: {k * 991}, {k * 7}-{k * 31 % 10000}, version 2.{k}." for k in range(60)]


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string"))


def added(text, field):
    ((_, spans),) = pii.find([text], field)
    return [(pii.KINDS[k], text[a:b]) for a, k, b in spans]


def test_repeated_mentions_get_the_label_of_the_match(field):
    text = "Call +1 (988) 555-2485 or mail jane.7@mail.example.com. Later 555-2485 rang, then 777-2485. Ask jane.7, not june.8, nor version 5.4."
    assert added(text, field) == [("phone", "555-2485"), ("email", "jane.7")]
    assert added("Later 555-2485 rang. Ask jane.7, version 5.4.", field) == []
    assert added(text, pii.SkipChainField(field.weights, field.chain, None)) == []  # it is the skip potential that tells


def test_skip_potentials_are_learned(field):
    diagonal, off = np.diag(field.skip)[1:], field.skip[1:, 0]
    assert (diagonal[[0, 1, 3]] > off[[0, 1, 3]] + 1).all()
    assert (pii.SkipChainField().fit(np.zeros((0, 17), np.int64), np.zeros(0)).skip == 0).all()


def test_planted_mentions_are_found_and_like_tokens_left_alone(field):
    rng, hits, wrong, planted = random.Random(2), 0, 0, 0
    for k in range(60):
        user, number = f"{rng.choice(['kim', 'lee', 'ann'])}.{100 + k}", f"{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        other = f"{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        text = f"Write to {user}@mail.example.com, call +1 (555) {number} now. As {user} said, {number} and {other} rang; x.{k} knows."
        got = added(text, field)
        hits += sum(t in (user, number) for _, t in got)
        wrong += sum(t not in (user, number) for _, t in got)
        planted += 2
    assert hits >= 0.95 * planted and wrong <= 0.02 * planted


def enumerated(field, g):
    """Exact marginals of nodes by summing over all labels of nodes and hubs."""
    n, hubs = len(g.doc), int(g.hub[:, 1].max()) + 1 if len(g.hub) else 0
    total = np.zeros((n, pii.LABELS))
    agreed = [{int(g.given[a]) for a, b in g.hub if b == h and g.given[a] >= 0} for h in range(hubs)]
    for labels in itertools.product(range(pii.LABELS), repeat=n + hubs):
        if any(y >= 0 and labels[k] != y for k, y in enumerate(g.given)) or any(len(s) == 1 and labels[n + h] not in s for h, s in enumerate(agreed)):
            continue
        score = sum(g.features[k] @ field.weights[:, labels[k]] for k in range(n))
        score += sum(field.chain[labels[a], labels[b]] for a, b in g.chain) + sum(field.skip[labels[a], labels[n + h]] for a, h in g.hub)
        for k in range(n):
            total[k, labels[k]] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def test_beliefs_are_the_exact_marginals_where_nothing_loops():
    rng = np.random.default_rng(3)
    scale = lambda *shape: rng.normal(0, 0.7, shape)
    for text in ("a1 b2 c3 word d4", "x1 word x1 then x1 word y2", "mail bob.1@mail.example.com and bob.1 or b2 c3"):
        skip = scale(pii.LABELS, pii.LABELS)
        field = pii.SkipChainField(scale(pii.N_FEATURES, pii.LABELS), scale(pii.LABELS, pii.LABELS), skip + skip.T)
        g = pii.graph([text], [pii.base_spans(text)])
        assert np.abs(field.beliefs(g) - enumerated(field, g)).max() < 1e-3


def test_counted_terms_have_the_gradient_of_the_likelihood():
    """A step on counted terms climbs the pseudo-likelihood that is summed node by node."""
    g, y = pii.with_mentions(CORPUS[:6])

    def likelihood(f):
        total = 0.0
        for k in range(len(y)):
            score = g.features[k] @ f.weights
            for a, b in g.chain:
                score = score + (f.chain[y[a]] if b == k else 0) + (f.chain[:, y[b]] if a == k else 0)
            for a, h in g.hub:
                if a == k and g.given[k] < 0:
                    matches = {int(g.given[c]) for c, other in g.hub if other == h and g.given[c] >= 0}
                    score = score + (f.skip[max(matches, default=0)] if len(matches) < 2 else 0)
            total += score[y[k]] - np.log(np.exp(score).sum())
        return total

    rows = pii.terms(g, y)
    seen = [likelihood(pii.SkipChainField().fit(rows, np.ones(len(rows)), steps=n, rate=0.02)) for n in (0, 5, 20, 60)]
    assert seen == sorted(seen) and seen[-1] > seen[0] + 10


def test_odd_rows(odd_docs, odd_rows, no_docs):
    field = pii.fit(odd_docs)
    got = pii.detect(odd_docs, field).collect()
    assert len(got) == len(odd_rows)
    by_id = {r.doc_id: r for r in got}
    assert (by_id[9].n_email, by_id[9].n_ip, by_id[9].n_card, by_id[9].n_phone) == (1, 1, 1, 1)
    assert by_id[10].n_ip == 1 and by_id[1].spans == "" and by_id[2].spans == ""
    for doc, text, *_ in odd_rows:
        base = brute(text or "")
        assert set(pii._written(base).split(",")) - {""} <= set(by_id[doc].spans.split(","))
    assert pii.detect(no_docs, pii.fit(no_docs)).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(odd_docs, field).collect()}
    assert clean[1] is None and "<email>" in clean[9] and "bob.1" not in clean[9] and clean[5] == dict((r[0], r[1]) for r in odd_rows)[5]


def test_one_match_labels_hundreds_of_repetitions(field):
    bare = " and ".join(f"word{'abcdefghij'[k % 10]} 555-2485" for k in range(300))
    for text in (f"Call +1 (988) 555-2485 now. {bare}", f"{bare} now. Call +1 (988) 555-2485"):
        ((_, spans),) = pii.find([text], field)
        assert sum(text[a:b] == "555-2485" and kind == 3 for a, kind, b in spans) == 300
