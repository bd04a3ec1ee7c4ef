"""Quality rules: counts over whole texts, then a linear-chain conditional random field over the lines.

Viterbi decoding marks every line as content or boilerplate; a document stays when content lines hold enough of its
words. The field has two states; a line's features score content against boilerplate, and a table of transitions scores
neighbours. It is fitted on a bounded sample of labelled documents. Only documents have labels, so the states of the lines
of bad documents are found in turn with the field, and documents of both kinds are braided to show changes of state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewright.llm.common import doc_mod, documents, give_back, pairs

BLANKS = b" \t\n\v\f\r"
#: Fixed values of the counting rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT = 50, 50
#: Words that mark notices and page furniture.
NOTICES = (b"copyright", b"licensed", b"license", b"all rights reserved", b"cookie", b"subscribe", b"click here", b"privacy policy")
LETTERS_UP = bytes(range(65, 91))
LETTERS = LETTERS_UP + bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
N_FEATURES = 11


def _count(data: bytes, of: bytes) -> int:
    return len(data) - len(data.translate(None, of))


def repeated_words(words: list) -> int:
    """Words inside three-word windows that occur twice or more, the first time included."""
    n = len(words) - 2
    if n < 2:
        return 0
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    window = ids[:-2] * len(known) + ids[1:-1]
    if len(known) >= 1 << 20:
        window = np.unique(window, return_inverse=True)[1]
    _, at, times = np.unique(window * len(known) + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[at] > 1)
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[starts + k] = True
    return int(hit.sum())


def line_features(lines: list[bytes]) -> np.ndarray:
    """A row for each line. A line's size, signs, case and place in the document; whether it came before."""
    rows, seen = [], set()
    for line in lines:
        words = line.split()
        n = max(1, len(line) - _count(line, BLANKS))
        letters = _count(line, LETTERS)
        lower = line.lower()
        rows.append(
            (
                1.0,
                np.log1p(len(words)) / 4,
                min(1.0, 5 * _count(line, SYMBOLS) / n),
                min(1.0, 10 * line.count(b"!") / n),
                _count(line, LETTERS_UP) / letters if letters else 0.0,
                _count(line, DIGITS) / n,
                float(bool(words) and line in seen),
                float(line.rstrip()[-1:] in (b".", b"!", b"?")),
                min(2.0, n / (10 * max(1, len(words)))),
                float(len(words) < 5),
                float(any(x in lower for x in NOTICES)),
            )
        )
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, N_FEATURES)


class LineField:
    """A two-state chain: ``weights`` score content for a line, ``turn[i, j]`` scores state j after state i."""

    def __init__(self, weights=None, turn=None):
        self.weights = np.zeros(N_FEATURES) if weights is None else np.asarray(weights, float)
        self.turn = np.zeros((2, 2)) if turn is None else np.asarray(turn, float)

    @staticmethod
    def _lay(docs: list[np.ndarray]):
        """Lines of all documents side by side, longest first; how many documents have each line number."""
        sizes = np.array([len(d) for d in docs])
        order = np.argsort(-sizes, kind="stable")
        running = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")
        return order, sizes[order], running

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.zeros(len(x)), x @ self.weights], axis=1)

    def viterbi(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """For each document's feature rows, the states of the best path: 1 content, 0 boilerplate; ties go to content."""
        order, sizes, running = self._lay(docs)
        out = [np.ones(len(d), np.int8) for d in docs]
        scored = [self.scores(docs[k]) for k in order]
        best = np.zeros((len(docs), 2))
        back = []
        for t, n in enumerate(running):
            here = np.stack([s[t] for s in scored[:n]])
            if t:
                step = best[:n, :, None] + self.turn
                came = (step[:, 1] >= step[:, 0]).astype(np.int8)  # per next state: 1 if it is best reached from content
                back.append(came)
                best[:n] = np.maximum(step[:, 0], step[:, 1]) + here
            else:
                best[:n] = here
        state = (best[:, 1] >= best[:, 0]).astype(np.int8)
        for t in range(len(running) - 1, -1, -1):
            n = running[t]
            for j in range(n):
                out[order[j]][t] = state[j]
            if t:
                state[:n] = back[t - 1][np.arange(n), state[:n]]
        return out

    def fit(self, docs: list[np.ndarray], states: list[np.ndarray], steps: int = 150, rate: float = 0.2, ridge: float = 1e-3) -> LineField:
        """Maximum likelihood by the forward-backward sums; ``states`` are those of each document's lines."""
        docs, states = zip(*[(d, y) for d, y in zip(docs, states, strict=True) if len(d)]) if any(map(len, docs)) else ((), ())
        if len({int(v) for y in states for v in np.unique(y)}) < 2:
            return self  # nothing to tell apart: all content
        order, sizes, running = self._lay(list(docs))
        x = np.zeros((len(running), len(docs), N_FEATURES))
        for j, k in enumerate(order):
            x[: sizes[j], j] = docs[k]
        lines = sizes.sum()
        want_w = sum(d[y == 1].sum(axis=0) for d, y in zip(docs, states, strict=True))
        want_t = np.zeros((2, 2))
        for y in states:
            np.add.at(want_t, (y[:-1], y[1:]), 1)
        theta = np.concatenate([self.weights, self.turn.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        add = np.logaddexp
        for step in range(1, steps + 1):
            w, turn = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
            e = x @ w
            fwd = np.zeros((len(running), len(docs), 2))
            for t, n in enumerate(running):
                if t:
                    a = fwd[t - 1, :n, :, None] + turn
                    fwd[t, :n] = add(a[:, 0], a[:, 1])
                fwd[t, :n, 1] += e[t, :n]
            bwd = np.zeros_like(fwd)
            got_t = np.zeros((2, 2))
            last = fwd[sizes - 1, np.arange(len(docs))]
            z = add(last[:, 0], last[:, 1])
            for t in range(len(running) - 2, -1, -1):
                n = running[t + 1]
                nxt = bwd[t + 1, :n].copy()
                nxt[:, 1] += e[t + 1, :n]
                b = turn + nxt[:, None, :]
                got_t += np.exp(fwd[t, :n, :, None] + b - z[:n, None, None]).sum(axis=0)
                bwd[t, :n] = add(b[:, :, 0], b[:, :, 1])
            p = np.zeros(e.shape)
            for t, n in enumerate(running):
                p[t, :n] = np.exp(fwd[t, :n, 1] + bwd[t, :n, 1] - z[:n])
            got_w = np.einsum("td,tdf->f", p, x)
            g = np.concatenate([want_w - got_w, (want_t - got_t).ravel()]) / lines - ridge * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return LineField(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents outside the held-out fold, spread by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.filter("doc_id is not null and y is not null").filter(doc_mod("doc_id", 5) != 0)
    drawn = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return documents(docs).join(F.broadcast(drawn), "doc_id")  # ``rows`` rows at most


def braided(docs: list[np.ndarray], states: list[np.ndarray], seed: int = 5) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Documents of either state with one of the other, a few lines of each in turn, so that every change of state occurs."""
    draw = np.random.default_rng(seed)
    sides = [[k for k, y in enumerate(states) if len(y) and (y.mean() >= 0.5) == side] for side in (True, False)]
    if not all(sides):
        return [], []
    out_x, out_y = [], []
    for k in range(max(map(len, sides))):
        left = [[docs[s[k % len(s)]], states[s[k % len(s)]]] for s in sides]
        xs, ys, turn = [], [], int(draw.integers(2))
        while any(len(x) for x, _ in left):
            n = int(draw.integers(1, 4))
            x, y = left[turn]
            xs.append(x[:n])
            ys.append(y[:n])
            left[turn] = [x[n:], y[n:]]
            turn = 1 - turn
        out_x.append(np.concatenate(xs))
        out_y.append(np.concatenate(ys))
    return out_x, out_y


def relabelled(field: LineField, docs: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    """States of lines: all content under label 1; under label 0 as they decode, if content then has under half of the words."""
    out = []
    for y, decoded, size in zip(labels, field.viterbi(docs), sizes, strict=True):
        good = y == 1 or 2 * size[decoded == 1].sum() >= size.sum()
        out.append(np.full(len(decoded), int(y == 1), np.int64) if good else decoded.astype(np.int64))
    return out


def learn(docs: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, rounds: int = 2, stretch: int = 100) -> LineField:
    """The field from documents' line features, words of each line and labels; no line's own state is known.

    Lines take the label of their document first. Then lines of documents of label 0 take the state that they decode
    as, for ``rounds`` rounds. Sequences are stretches of the documents, and documents of both labels braided.
    """
    states = [np.full(len(d), int(y), np.int64) for d, y in zip(docs, labels, strict=True)]
    field = LineField()
    for nth in range(rounds + 1):
        own = [(d[a : a + stretch], y[a : a + stretch]) for d, y in zip(docs, states, strict=True) for a in range(0, len(d), stretch)]
        x, y = ([p[k] for p in own] for k in (0, 1))
        more_x, more_y = braided(x, y)
        field = field.fit(x + more_x, y + more_y, steps=40 if nth else 120)
        states = relabelled(field, docs, sizes, labels)
    return field


def fit(docs: DataFrame, labels: DataFrame, rows: int = 1500) -> LineField:
    """The field fitted on at most ``rows`` labelled documents, of which only the features of lines leave the tasks.

    Null or empty texts have one line without words. Documents or labels without an id are left out, of repeated ids one
    row is taken and the larger label. Without rows of both labels the field marks all lines as content.
    """
    sample = labelled_sample(docs, labels, "quality", rows)

    def features(batches):
        for batch in batches:
            lines = [line_bytes(t) for t in batch.column(1).to_pylist()]
            x = pa.array([line_features(own).ravel() for own in lines], pa.list_(pa.float64()))
            words = pa.array([[len(line.split()) for line in own] for own in lines], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x, words, pa.array(batch.column(2).to_pylist(), pa.int32())], ["doc_id", "x", "words", "y"])

    found = sample.mapInArrow(features, "doc_id long, x array<double>, words array<long>, y int")
    got = sorted(found.dropDuplicates(["doc_id"]).collect(), key=lambda r: r["doc_id"])  # ``rows`` rows at most
    x = [np.array(r["x"]).reshape(-1, N_FEATURES) for r in got]
    return learn(x, [np.array(r["words"]) for r in got], np.array([min(1, max(0, r["y"])) for r in got], int))


def line_bytes(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def verdicts(texts: list[str], field: LineField, least_share: float = 0.5) -> pd.DataFrame:
    """What ``judge`` returns of each text, without its id."""
    rows, chains, sizes = [], [], []
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        words, lines = data.split(), data.split(b"\n")
        full = [line for line in lines if line and not line.isspace()]
        chains.append(line_features(lines))
        sizes.append(np.array([len(line.split()) for line in lines]))
        rows.append((len(words), len(text) - _count(data, BLANKS), _count(data, SYMBOLS), len(full) - len(set(full)), repeated_words(words)))
    table = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], dtype="int64")
    share = np.array([size[state == 1].sum() / max(1, size.sum()) for state, size in zip(field.viterbi(chains), sizes, strict=True)], float)
    table["base_failed"] = (table.n_words < LEAST_WORDS) | (100 * table.n_repeat_words > REPEAT_PERCENT * table.n_words)
    table["kept"] = ~table.base_failed & (share >= least_share)
    table["content_share"] = share
    return table


def judge(docs: DataFrame, field: LineField, least_share: float = 0.5) -> DataFrame:
    """A row for every row of ``docs``: its counts, base_failed, the share of its words in content lines, and kept.

    A null text counts as empty: no words, so base_failed. A document is kept if it doesn't fail the counting rules and
    at least ``least_share`` of its words are in lines that decode as content. Repeated rows are judged each on its own,
    an empty table gives an empty result, other columns are not read.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64())]
    )

    def run(batches):
        for ids, texts in pairs(batches, 4_000_000):
            table = verdicts(texts, field, least_share)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(table[c]) for c in table)], schema=schema)

    columns = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return documents(docs).mapInArrow(run, columns)


def keep_good(docs: DataFrame, field: LineField, least_share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns; the judgement never leaves the row's task.

    Null and empty texts have no words, fail the counting rules and go; null and repeated ids make no difference, and rows
    that repeat stay or go together. An empty table gives an empty result; other columns may have any name.
    """
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [t or "" for t in part.column(place).to_pylist()]
                yield part.filter(pa.array(verdicts(texts, field, least_share).kept))
        give_back()

    return docs.mapInArrow(run, docs.schema)
