"""Personal data: exact patterns, then a skip-chain conditional random field over each whole text.

Nodes are the tokens that hold a digit or an at sign, and those that are the user of an address matched in the document;
any other token is outside by construction, so the chain is cut there without loss. Neighbouring nodes share a transition
potential. Nodes that are the same but for their punctuation share a skip potential wherever they are in the document: all
occurrences hang on one hub, which has the label of the matches among them, if they agree. Tokens of pattern matches are
given; loopy message passing over all documents of a batch at once, until it settles, carries their labels to repeated and
adjoining tokens, and tokens that end up labelled with enough belief become spans beside the matches, which always stay.

The potentials are fitted by pseudo-likelihood on the matches of all documents. As no pattern finds a repeated mention, the
fit shows the field some: each match's user or number is written once more at the end of its document in a form that no
pattern takes, labelled like the match, beside a like token that has no match, labelled outside. The terms of the
likelihood depend on a node's features and on its neighbours' labels only, so equal ones are counted in Spark, and the
fit reads the counts.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewright.llm.common import documents, give_back, pairs

#: Kinds in the order in which they are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")  # starts only where digits start, so long runs cost no retries
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

TOKEN = re.compile(r"\S+")
HINT = re.compile(r"[0-9@]")
EDGES = ".,;:!?'\"()[]{}<>#$%&*|=~`"
OUTSIDE, LABELS = 0, len(KINDS) + 1
N_FEATURES = 24
LEAST_BELIEF = 0.9
#: How the fit writes mentions: between words, so that they adjoin nothing.
BETWEEN = "\n\nsee {} also"
#: Messages have settled when none changes by more; after each so many rounds without that, they are damped more.
SETTLED, ROUNDS = 1e-4, 50


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def _ips(text: str):
    for m in DOTTED.finditer(text):  # four parts after four, as the pattern takes them
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, by start and then by kind."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(a, 1, b) for a, b in _ips(text)]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


@dataclass
class Graph:
    """Nodes of many documents at once: where they are, their features, given labels and edges."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    given: np.ndarray  # -1: not covered by a match
    chain: np.ndarray  # pairs of nodes
    hub: np.ndarray  # pairs of a node and the hub of all that are the same


def token_features(token: str, before: str) -> list[float]:
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    dots, dashes = token.count("."), token.count("-")
    has_at = "@" in token
    longest = max(map(len, re.findall("[0-9]+", token)), default=0)
    return [
        1.0,
        float(has_at),
        float(has_at and "." in token.rpartition("@")[2].strip(EDGES)),
        float(has_at and letters > 0),
        float(dots == 3 and letters == 0),
        float(dots == 3 and letters == 0 and longest <= 3),
        float(dots > 3),
        float(token.startswith("+")),
        float("(" in token and ")" in token and letters == 0),
        float(dashes == 1 and letters == 0),
        float(dashes > 1 and letters == 0),
        float(letters == 0),
        float(letters > 0),
        float(letters > digits),
        float(digits <= 2),
        float(3 <= digits <= 4),
        float(5 <= digits <= 8),
        float(9 <= digits <= 13),
        float(14 <= digits <= 19),
        float(digits > 19),
        float(letters == 0 and longest == 4 and digits % 4 == 0),
        float("=" in token or '"' in token),
        float(before.endswith((" ", "\n")) or not before),
        float(token[-1:] in EDGES),
    ]


def same_keys(token: str) -> list[str]:
    """What tokens have in common that share a potential: the token itself, an address's user, a number's digits."""
    core = token.strip(EDGES).lower()
    if not core:
        return []
    if "@" in core:
        user = core.partition("@")[0]
        return [core, user] if user else [core]
    digits = "".join(re.findall("[0-9]", core))
    return [core, f"#{digits}"] if len(digits) >= 6 else [core]


def users_of(text: str, base: list[tuple[int, int, int]]) -> set[str]:
    """Users of the addresses among the matches, but for those that are mere words."""
    users = {text[a:b].partition("@")[0].lower() for a, kind, b in base if kind == 0}
    return {u for u in users if not u.isalpha()}


def graph(texts: list[str], bases: list[list[tuple[int, int, int]]]) -> Graph:
    doc, starts, ends, rows, given, chain, hub = [], [], [], [], [], [], []
    hubs = 0
    for d, (text, base) in enumerate(zip(texts, bases, strict=True)):
        alike_nodes: dict[str, list[int]] = {}
        last_end, k = None, 0  # k: the first match that may still cover a token
        hinted = HINT.search(text)
        users = users_of(text, base) if hinted else set()
        for m in TOKEN.finditer(text) if hinted else ():
            a, token = m.start(), m.group()
            if not HINT.search(token) and not (users and token.strip(EDGES).lower() in users):
                continue
            node = len(doc)
            while k < len(base) and base[k][2] <= a:
                k += 1
            label = next((kind + 1 for s, kind, e in base[k : k + 4] if s < m.end() and e > a), -1)
            doc.append(d)
            starts.append(a)
            ends.append(m.end())
            given.append(label)
            rows.append(token_features(token, text[max(0, a - 1) : a]))
            if last_end is not None and a - last_end <= 2 and not text[last_end:a].strip():
                chain.append((node - 1, node))
            last_end = m.end()
            alike = same_keys(token)
            if alike:  # the last key holds for all that share any
                alike_nodes.setdefault(alike[-1], []).append(node)
        for nodes in alike_nodes.values():
            if len(nodes) > 1:
                hub += [(node, hubs) for node in nodes]
                hubs += 1
    pairs_ = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph(np.array(doc, np.int64), np.array(starts, np.int64), np.array(ends, np.int64), np.array(rows, float).reshape(-1, N_FEATURES), np.array(given, np.int64), pairs_(chain), pairs_(hub))


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, int]]:
    """(token, label): each match's user or number in a form that no pattern takes, and a like one that has no match."""
    found: dict[str, int] = {}
    for a, kind, b in base:
        match = text[a:b]
        if kind == 0:
            user = match.partition("@")[0]
            if not user.isalpha():
                found.update({user: kind + 1, user[::-1]: OUTSIDE})
            continue
        for token in match.split():
            digits = "".join(DIGIT.findall(token))
            if len(digits) >= 6:
                other = f"{digits[:3]}/{digits[3:]}"
                found.update({other: kind + 1, f"{digits[2::-1]}/{digits[:2:-1]}": OUTSIDE})
                if not base_spans(token) and token.strip(EDGES) == token:
                    found.update({token: kind + 1, token[::-1]: OUTSIDE})
    by_key: dict[str, set[int]] = {}
    for token, label in found.items():
        by_key.setdefault(same_keys(token)[-1] if same_keys(token) else "", set()).add(label)
    return [(t, y) for t, y in found.items() if same_keys(t) and len(by_key[same_keys(t)[-1]]) == 1]


def with_mentions(texts: list[str]) -> tuple[Graph, np.ndarray]:
    """The graph of texts with their mentions written once more, and the label of each node."""
    longer, bases, hidden = [], [], []
    for d, text in enumerate(texts):
        base = base_spans(text)
        for token, label in mentions(text, base):
            at = len(text) + BETWEEN.index("{")
            text += BETWEEN.format(token)
            hidden.append((d, at, label))
        longer.append(text)
        bases.append(base_spans(text) if base else base)
    g = graph(longer, bases)
    y = np.maximum(g.given, OUTSIDE)
    node = {(d, a): k for k, (d, a) in enumerate(zip(g.doc.tolist(), g.start.tolist(), strict=True))}
    for d, at, label in hidden:
        k = node.get((d, at))
        if k is not None and g.given[k] < 0:
            y[k] = label
    return g, y


def agreed(g: Graph) -> np.ndarray:
    """The label of the matches of each hub; -1 where there are none, -2 where they don't agree."""
    hubs = int(g.hub[:, 1].max()) + 1 if len(g.hub) else 0
    votes = np.zeros((hubs, LABELS), bool)
    matched = g.hub[g.given[g.hub[:, 0]] >= 0]
    votes[matched[:, 1], g.given[matched[:, 0]]] = True
    kinds = votes.sum(axis=1)
    return np.where(kinds == 1, votes.argmax(axis=1), np.where(kinds == 0, -1, -2))


def terms(g: Graph, y: np.ndarray) -> np.ndarray:
    """A row for each node: features as bits, label, how many neighbours before and behind and hubs have each label.

    A hub has the label that its matches agree on, or is outside where it has none. A match doesn't see its own hub.
    """
    out = np.zeros((len(y), 2 + 3 * LABELS), np.int64)
    out[:, 0] = g.features.astype(np.int64) @ (1 << np.arange(N_FEATURES))
    out[:, 1] = y
    np.add.at(out, (g.chain[:, 1], 2 + y[g.chain[:, 0]]), 1)
    np.add.at(out, (g.chain[:, 0], 2 + LABELS + y[g.chain[:, 1]]), 1)
    label = agreed(g)[g.hub[:, 1]]
    seen = (label > -2) & (g.given[g.hub[:, 0]] < 0)
    np.add.at(out, (g.hub[seen, 0], 2 + 2 * LABELS + np.maximum(label[seen], OUTSIDE)), 1)
    return out


def _soft(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class SkipChainField:
    def __init__(self, weights=None, chain=None, skip=None):
        self.weights = np.zeros((N_FEATURES, LABELS)) if weights is None else weights
        self.chain = np.zeros((LABELS, LABELS)) if chain is None else chain
        self.skip = np.zeros((LABELS, LABELS)) if skip is None else skip

    def fit(self, rows: np.ndarray, counts: np.ndarray, steps: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> SkipChainField:
        """Pseudo-likelihood: each node given its neighbours; ``rows`` are distinct ``terms``, ``counts`` how often they occur."""
        if not len(rows):
            return self
        features = (rows[:, :1] >> np.arange(N_FEATURES) & 1).astype(float)
        y = rows[:, 1]
        before, behind, hub = (rows[:, 2 + k * LABELS : 2 + (k + 1) * LABELS].astype(float) for k in range(3))
        share = np.sqrt(counts)[:, None]  # a kind of token that the corpus repeats much doesn't drown the others
        share = share / share.sum()
        theta = [self.weights.copy(), self.chain.copy(), self.skip.copy()]
        m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
        one = np.eye(LABELS)
        for step in range(1, steps + 1):
            w, chain, skip = theta
            left = share * (one[y] - _soft(features @ w + before @ chain + behind @ chain.T + hub @ skip))
            of_skip = hub.T @ left
            grads = [features.T @ left, before.T @ left + left.T @ behind, (of_skip + of_skip.T) / 2]  # skips have no direction
            for k, t in enumerate(theta):
                grad = grads[k] - ridge * t
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.99 * v[k] + 0.01 * grad * grad
                t += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return SkipChainField(*theta)

    def beliefs(self, g: Graph, damp: float = 0.3) -> np.ndarray:
        """Marginals by loopy message passing until it settles; nodes of matches keep their label."""
        n = len(g.doc)
        label = agreed(g)
        unary = np.concatenate([g.features @ self.weights, np.zeros((len(label), LABELS))])
        given = np.concatenate([g.given, np.maximum(label, -1)])
        held = given >= 0
        unary[held] = -50.0
        unary[held, given[held]] = 50.0
        edges = np.concatenate([g.chain, g.hub + [0, n]])
        tables = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.hub), 0)])
        src = np.concatenate([edges[:, 0], edges[:, 1]])
        dst = np.concatenate([edges[:, 1], edges[:, 0]])
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        messages = np.zeros((len(src), LABELS))
        total = unary.copy()
        done, change = 0, np.inf if len(src) else 0.0
        while change > SETTLED:
            out = total[src] - messages[back]
            new = (out - out.max(axis=1, keepdims=True))[:, :, None] + tables
            new = np.log(np.exp(new - new.max(axis=1, keepdims=True)).sum(axis=1)) + new.max(axis=1)
            new -= new.max(axis=1, keepdims=True)
            change = (1 - damp) * np.abs(new - messages).max()
            messages = damp * messages + (1 - damp) * new
            total = unary.copy()
            np.add.at(total, dst, messages)
            done += 1
            if done % ROUNDS == 0:  # what swings is damped until it doesn't
                damp = (1 + damp) / 2
        return _soft(total[:n])


def added_spans(texts: list[str], g: Graph, belief: np.ndarray, least: float = LEAST_BELIEF) -> dict[int, list[tuple[int, int, int]]]:
    """By text: (start, kind, end) of runs of free tokens with one label that is believed enough."""
    label = belief.argmax(axis=1)
    sure = (g.given < 0) & (label != OUTSIDE) & (belief.max(axis=1) >= least)
    linked = {(int(a), int(b)) for a, b in g.chain}
    found: dict[int, list[tuple[int, int, int]]] = {}
    last = None
    for k in np.flatnonzero(sure).tolist():
        d, kind = int(g.doc[k]), int(label[k]) - 1
        text = texts[d]
        a, b = int(g.start[k]), int(g.end[k])
        while a < b and text[a] in EDGES:
            a += 1
        while b > a and text[b - 1] in EDGES:
            b -= 1
        if a == b:
            continue
        own = found.setdefault(d, [])
        if last == k - 1 and (k - 1, k) in linked and own and own[-1][1] == kind:
            own[-1] = (own[-1][0], kind, b)
        else:
            own.append((a, kind, b))
        last = k
    return found


def find(texts: list[str], field: SkipChainField) -> list[tuple[list, list]]:
    """For each text its pattern matches and the spans that the field adds."""
    bases = [base_spans(t) for t in texts]
    g = graph(texts, bases)
    added = added_spans(texts, g, field.beliefs(g)) if len(g.doc) else {}
    return [(base, added.get(d, [])) for d, base in enumerate(bases)]


def fit(docs: DataFrame) -> SkipChainField:
    """The field fitted on the matches of all documents.

    Only counts of equal terms leave the tasks: of token features and neighbours' labels, at most some thousand kinds
    whatever the corpus. Null and empty texts have no nodes; without any match nothing is learned and no span is added.
    """

    def count(batches):
        for _, texts in pairs(batches, 4_000_000):
            g, y = with_mentions([t for t in texts if HINT.search(t)])
            if len(y):
                rows, n = np.unique(terms(g, y), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.int64())), pa.array(n)], ["term", "n"])

    counted = documents(docs).mapInArrow(count, "term array<long>, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = sorted((r["term"], r["n"]) for r in counted.collect())
    return SkipChainField().fit(np.array([t for t, _ in got], np.int64).reshape(-1, 2 + 3 * LABELS), np.array([n for _, n in got], float))


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans))


def detect(docs: DataFrame, field: SkipChainField) -> DataFrame:
    """A row for every row of ``docs``: counts of the matches by kind, base_sha256, spans, n_added.

    Positions are code points, ends exclusive. A null text counts as empty and has no spans; repeated rows are read each
    on its own, an empty table gives an empty result, other columns are not read.
    """

    def run(batches):
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
        for ids, texts in pairs(batches, 4_000_000):
            rows = []
            for doc_id, (base, added) in zip(ids, find(texts, field), strict=True):
                n = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
                rows.append((doc_id, *n, hashlib.sha256(_written(base).encode()).hexdigest(), _written(base + added), len(added)))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return documents(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span in the place of which its kind stands, in angle brackets; overlapping spans count as one."""
    out, at = [], 0
    for a, kind, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: SkipChainField) -> DataFrame:
    """Every row of ``docs`` with all its columns, its text without personal data.

    A null text stays null and an empty one empty; null and repeated ids make no difference, rows that repeat are redacted
    alike. An empty table gives an empty result; other columns may have any name.
    """
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(place).to_pylist()
                found = find([t or "" for t in texts], field)
                columns = list(part.columns)
                columns[place] = pa.array([t if t is None else redacted(t, b + a) for t, (b, a) in zip(texts, found, strict=True)], part.schema.field(place).type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)
        give_back()

    return docs.mapInArrow(run, docs.schema)
