"""Quality classifier: a convolutional network over the bytes of whole documents, in numpy.

Bytes are embedded and read by filters over short windows. A document is cut in chunks that overlap by all but one step
of a window, so that every window lies in one chunk; each filter keeps its largest answer in a chunk. A document's
features are the largest and the mean of its chunks' answers, which a logistic layer makes into one probability.
The network is fitted on a bounded sample of labelled rows outside the held-out fold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewright.llm.common import doc_mod, documents, pairs
from pulsewright.llm.quality import labelled_sample

WINDOW, STEP, EMBED, FILTERS, WINDOWS = 8, 2, 4, 16, 256
CHUNK = (WINDOWS - 1) * STEP + WINDOW
LOW = np.float32(-1e9)
THRESHOLD = 0.3


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of each chunk, how many of its windows are the text's, and its text. An empty text is one zero byte."""
    sizes = np.array([max(1, len(t)) for t in texts])
    windows = np.maximum(1, -(-(sizes - WINDOW) // STEP) + 1)
    parts = -(-windows // WINDOWS)
    owner = np.repeat(np.arange(len(texts)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    out = np.zeros((len(owner), CHUNK), np.uint8)
    row = 0
    for text, n in zip(texts, parts.tolist(), strict=True):
        data = np.frombuffer(text, np.uint8)
        for k in range(n):
            piece = data[k * WINDOWS * STEP : k * WINDOWS * STEP + CHUNK]
            out[row, : len(piece)] = piece
            row += 1
    return out, np.minimum(WINDOWS, windows[owner] - nth * WINDOWS), owner


class ByteNetwork:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = r.normal(0, 0.3, (WINDOW * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = np.zeros(2 * FILTERS, np.float32)
        self.base = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.base]

    def answers(self, chunks: np.ndarray, valid: np.ndarray, where: bool = False):
        """The largest answer of each filter in each chunk (and at which window)."""
        best = np.empty((len(chunks), FILTERS), np.float32)
        at = np.empty((len(chunks), FILTERS), np.int64) if where else None
        for a in range(0, len(chunks), 256):
            laid = self.embed[chunks[a : a + 256]].reshape(-1, CHUNK * EMBED)
            seen = np.lib.stride_tricks.sliding_window_view(laid, WINDOW * EMBED, axis=1)[:, :: STEP * EMBED]
            got = (np.ascontiguousarray(seen).reshape(-1, WINDOW * EMBED) @ self.filters).reshape(len(laid), WINDOWS, FILTERS)
            for k in np.flatnonzero(valid[a : a + 256] < WINDOWS):
                got[k, valid[a + k] :] = LOW
            if where:
                at[a : a + 256] = got.argmax(axis=1)
            best[a : a + 256] = got.max(axis=1)
        return (best, at) if where else best

    def _features(self, pooled: np.ndarray, owner: np.ndarray, n: int):
        first = np.searchsorted(owner, np.arange(n))
        count = np.diff(np.append(first, len(owner)))[:, None]
        return np.concatenate([np.maximum.reduceat(pooled, first, axis=0), np.add.reduceat(pooled, first, axis=0) / count], axis=1), first, count

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        chunks, valid, owner = chunks_of(texts)
        pooled = np.maximum(self.answers(chunks, valid) + self.bias, 0)
        features, _, _ = self._features(pooled, owner, len(texts))
        return 1 / (1 + np.exp(-np.clip((features @ self.out + self.base).astype(np.float64), -500, 500)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 7) -> ByteNetwork:
        if len(texts) == 0:
            return self
        share = float(np.clip(labels.mean(), 0.02, 0.98))
        self.base[0] = np.log(share / (1 - share))
        if len(set(labels.tolist())) < 2:
            return self
        r = np.random.default_rng(seed)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for a in range(0, len(order), batch):
                step += 1
                part = order[a : a + batch]
                for p, g, (m, v) in zip(self.parameters(), self._gradients([texts[k] for k in part], labels[part]), moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
        chunks, valid, owner = chunks_of(texts)
        best, at = self.answers(chunks, valid, where=True)
        pooled = np.maximum(best + self.bias, 0)
        features, first, count = self._features(pooled, owner, len(texts))
        p = 1 / (1 + np.exp(-np.clip(features @ self.out + self.base, -50, 50)))
        d = ((p - labels) / len(texts)).astype(np.float32)
        g_out, g_base = features.T @ d + 1e-4 * self.out, np.array([d.sum()], np.float32)
        g_top, g_mean = d[:, None] * self.out[None, :FILTERS], d[:, None] * self.out[None, FILTERS:] / count
        g = g_mean[owner]
        is_top = pooled == features[owner, :FILTERS]
        g = g + np.where(is_top, g_top[owner], 0)
        g = np.where(best + self.bias > 0, g, 0).astype(np.float32)
        reach = at[:, :, None] * STEP + np.arange(WINDOW)  # chunk, filter, byte of the window
        read = chunks[np.arange(len(chunks))[:, None, None], reach]
        x = self.embed[read].reshape(len(chunks), FILTERS, WINDOW * EMBED)
        g_filters = np.einsum("cf,cfk->kf", g, x)
        g_embed = np.zeros_like(self.embed)
        back = (g[:, :, None] * self.filters.T[None]).reshape(-1, EMBED)
        for k in range(EMBED):
            g_embed[:, k] = np.bincount(read.ravel(), weights=back[:, k], minlength=256)
        return [g_embed, g_filters, g.sum(axis=0), g_out, g_base]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 1500, most_chars: int = 64_000) -> ByteNetwork:
    """The network fitted on at most ``rows`` labelled documents of at most ``most_chars`` characters each."""
    drawn = labelled_sample(docs, labels, label, rows).filter(F.length(F.coalesce("text", F.lit(""))) <= most_chars)
    got = sorted(((r["doc_id"], r["text"] or "", r["y"]) for r in drawn.dropDuplicates(["doc_id"]).collect()), key=lambda r: r[0])
    return ByteNetwork().fit([t.encode("utf-8", "surrogatepass") for _, t, _ in got], np.array([min(1, max(0, y)) for *_, y in got], np.float32))


def classify(docs: DataFrame, network: ByteNetwork, fold: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, from its whole text alone.

    ``score`` is the probability of label 1. A null text counts as empty and gets a score like any other; repeated rows
    are scored each on its own, an empty table gives an empty result, other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for ids, texts in pairs(batches, 2_000_000):
            score = model.value.probabilities([t.encode("utf-8", "surrogatepass") for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = documents(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(doc_mod("doc_id", fold) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
