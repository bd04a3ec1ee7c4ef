"""Language-model scoring by a probabilistic suffix tree over bytes.

A text is its words, A-Z lowered, with one blank between and one end. The tree's nodes are byte contexts of up to DEPTH
bytes: a context is retained when the next byte, given it, diverges enough from what the context without its first byte
predicts. What a node tells beyond its parent is measured in bits over its own occurrences and held against a fixed
amount and half a logarithm for each of its counts, whatever else is in the corpus; so the tree grows with the corpus,
and its nodes are Spark tables. Each node's next-byte distribution is smoothed with its parent's, down to a root that
gives every byte some probability.

The probability of a byte depends on the DEPTH bytes before it only. It is found once for each distinct such gram, depth
by depth. Frequent grams go to every task, all others are joined to the rows that hold them.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsewright.llm.common import doc_mod, documents, pairs, stored

DEPTH = 5
END, PAD = 0x0A, 0x0B  # neither is part of a word
#: What a context must tell beyond its parent, over its own occurrences, besides half a logarithm for each count.
LEAST_BITS = 8.0
#: Words that are at least this share of the training tokens go to every task: at most 1 / HEAD_SHARE of them.
HEAD_SHARE, HEAD_BYTES = 1e-6, 64
#: Grams that are at least this share of all places go to every task: at most 1 / GRAM_SHARE of them, 16 bytes each.
GRAM_SHARE = 2e-7
STRETCH = 512
LN10 = np.log(10)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _add_sorted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def codes(sequences: list[bytes]) -> np.ndarray:
    """A number for each byte of ``sequences``, that holds DEPTH bytes of context and the byte."""
    pad = bytes([PAD]) * DEPTH
    data = np.frombuffer(pad + pad.join(sequences), np.uint8).astype(np.int64)
    code = np.zeros(max(0, len(data) - DEPTH), np.int64)
    for k in range(DEPTH + 1):
        code = code << 8 | data[k : len(data) - DEPTH + k]
    return code[data[DEPTH:] != PAD]


def grams(sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that hold DEPTH bytes of context and the next byte, and how often each occurs."""
    return np.unique(codes(sequences), return_counts=True)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(word, code, n, m): how often each word, or each context with its next byte, occurs in the texts to learn from.

    ``docs`` has (learn, text); words are of the texts to learn from only, codes of all texts: m counts every place.
    """
    names = ["word", "code", "n", "m"]

    def count(batches):
        words: Counter = Counter()
        none = np.zeros(0, np.int64)
        sums = {True: (none, none), False: (none, none)}

        def word_rows():
            n = pa.array(list(words.values()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), n, n], names)

        for learn, texts in pairs(batches, 2_000_000):
            sequences: dict[bool, list[bytes]] = {True: [], False: []}
            for is_learned, text in zip(learn, texts, strict=True):
                own = words_of(text)
                if is_learned:
                    words.update(own)
                    words[b"\n"] += 1
                sequences[is_learned].append(b" ".join(own) + b"\n")
            for kind, found in sequences.items():
                if found:
                    sums[kind] = _add_sorted(*(np.concatenate(c) for c in zip(sums[kind], grams(found), strict=True)))
            if len(words) > 500_000:
                yield word_rows()
                words.clear()
        yield word_rows()
        (known, n), (other, more) = sums[True], sums[False]
        found, of_both = np.unique(np.concatenate([known, other]), return_inverse=True)
        both = [np.bincount(of_both, weights=np.concatenate(w), minlength=len(found)).astype(np.int64) for w in ((n, np.zeros_like(more)), (n, more))]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.binary()), pa.array(found), *map(pa.array, both)], names)

    return stored(docs.mapInArrow(count, "word binary, code long, n long, m long").groupBy("word", "code").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))


class SuffixTree:
    """A tree that fits in memory, made into an automaton's tables; tests hold the tables of ``gram_logs`` against it.

    The tree and the prefixes of its contexts are the states: the state after a byte is the longest suffix of the text so
    far that is a state. A state depends on the last DEPTH bytes only, so texts are cut in stretches that advance together.
    """

    def __init__(self, nodes: dict[bytes, dict[int, int]]):
        """``nodes``: counts of next bytes by context; the empty context is the root."""
        nodes = {b"": {}, **nodes}
        used = sorted({b for c in nodes.values() for b in c} | {b for c in nodes for b in c})
        classes = [b for b in used if b != PAD] + [PAD]
        other = len(classes)  # bytes that the corpus doesn't have
        self.class_of = np.full(256, other, np.uint8 if other < 256 else np.uint16)
        self.class_of[classes] = np.arange(len(classes))
        width = other + 1
        probability: dict[bytes, np.ndarray] = {}
        total = sum(nodes[b""].values())
        root = np.full(width, 1.0)
        for b, n in nodes[b""].items():
            root[self.class_of[b]] += n
        probability[b""] = root / (total + 255)  # add one, over all bytes but PAD
        for context in sorted(nodes, key=len):
            if context:
                counts, parent = nodes[context], context[1:]
                while parent not in probability:
                    parent = parent[1:]
                n, kinds = sum(counts.values()), max(1, len(counts))
                own = probability[parent] * kinds
                for b, c in counts.items():
                    own[self.class_of[b]] += c
                probability[context] = own / (n + kinds)
        states = {b""} | {c[:k] for c in nodes for k in range(1, len(c) + 1)} | {bytes([PAD]) * k for k in range(DEPTH + 1)}
        self.states = sorted(states)
        number = {s: k for k, s in enumerate(self.states)}

        def longest(s: bytes, among) -> bytes:
            while s not in among:
                s = s[1:]
            return s

        self.start = number[bytes([PAD]) * DEPTH]
        self.root = number[b""]
        self.next = np.full((len(self.states), width), self.root, np.int32)
        self.log10 = np.empty((len(self.states), width))
        longer: dict[bytes, list[bytes]] = {}
        for s in self.states:
            if s:
                longer.setdefault(s[:-1], []).append(s)
        for s in sorted(self.states, key=len):  # where a byte makes no longer state, it leads where it leads from the suffix
            k = number[s]
            if s:
                self.next[k] = self.next[number[longest(s[1:], number)]]
            for t in longer.get(s, ()):
                self.next[k, self.class_of[t[-1]]] = number[t]
            self.log10[k] = np.log10(probability[longest(s, probability)])

    def score(self, sequences: list[bytes]) -> np.ndarray:
        """log10 probability of each sequence, every byte after the longest state that ends there."""
        pad = bytes([PAD]) * DEPTH
        joined = self.class_of[np.frombuffer(b"".join(pad + s for s in sequences), np.uint8)]
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        begins = np.cumsum(sizes + DEPTH) - sizes
        parts = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(sequences)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = begins[owner] + nth * STRETCH
        long = np.minimum(STRETCH, sizes[owner] - nth * STRETCH)
        order = np.argsort(-long, kind="stable")
        at, long, owner = at[order], long[order], owner[order]
        state = np.full(len(at), self.root, np.int32)
        for k in range(DEPTH):  # the bytes before a stretch bring it to its state
            state = self.next[state, joined[at - DEPTH + k]]
        total = np.zeros(len(at))
        running = np.searchsorted(-long, -np.arange(long.max(initial=0)), side="left")
        for t, n in enumerate(running):
            symbol = joined[at[:n] + t]
            total[:n] += self.log10[state[:n], symbol]
            state[:n] = self.next[state[:n], symbol]
        return np.bincount(owner, weights=total, minlength=len(sequences))


def _last(column: str, n: int) -> Column:
    """The last ``n`` bytes of a number that holds bytes."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * n) - 1))


def levels(counts: DataFrame) -> list[DataFrame]:
    """By depth: (code, n, m) of each context of so many bytes with its next byte."""
    found = [counts.filter("code is not null").select("code", "n", "m")]
    for d in range(DEPTH - 1, -1, -1):
        found.append(stored(found[-1].groupBy(_last("code", d + 1).alias("code")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))))
    return found[::-1]


def retained(depth: list[DataFrame], least_bits: float = LEAST_BITS) -> list[DataFrame]:
    """By depth from 1: (context, all, kinds) of the contexts that pass the divergence test, and of their suffixes."""
    context = F.shiftright("code", 8).alias("context")
    known = [d.filter("n > 0") for d in depth]
    stats = [known[0].groupBy(context).agg(F.sum("n").alias("all"))]
    for d in range(1, DEPTH + 1):
        above = known[d - 1].select(F.col("code").alias("shorter"), F.col("n").alias("parent_n"))
        sums = known[d].withColumn("shorter", _last("code", d)).join(above, "shorter").groupBy(context).agg(
            F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") * F.log2(F.col("n") / F.col("parent_n"))).alias("part")
        )
        parent = stats[-1].select(F.col("context").alias("parent"), F.col("all").alias("parent_all"))
        bits = F.col("part") + F.col("all") * F.log2(F.col("parent_all") / F.col("all"))
        passed = bits >= F.lit(float(least_bits)) + F.col("kinds") / 2 * F.log2(F.col("all") + 1)
        stats.append(stored(sums.withColumn("parent", _last("context", d - 1)).join(parent, "parent").select("context", "all", "kinds", passed.alias("passed"))))
    kept, nodes = None, []
    for d in range(DEPTH, 0, -1):
        own = stats[d].filter("passed").select("context")
        if kept is not None:  # suffixes of deeper ones
            own = own.union(kept.select(_last("context", d).alias("context"))).distinct()
        kept = stored(own)
        nodes.append(stats[d].join(kept, "context").select("context", "all", "kinds"))
    return nodes[::-1]


def gram_logs(counts: DataFrame, least_bits: float = LEAST_BITS) -> DataFrame:
    """(code, m, log10): each context with its next byte in any text, how often it occurs, and the byte's log probability."""
    depth = levels(counts)
    nodes = retained(depth, least_bits)
    total = depth[0].agg(F.sum("n")).first()[0] or 0
    found = depth[0].select("code", "m", ((F.col("n") + 1) / F.lit(total + 255)).alias("p"))
    for d in range(1, DEPTH + 1):
        above = found.select(F.col("code").alias("shorter"), F.col("p").alias("q"))
        below = depth[d].withColumns({"shorter": _last("code", d), "context": F.shiftright("code", 8)}).join(above, "shorter").join(nodes[d - 1], "context", "left")
        p = F.coalesce((F.col("n") + F.col("kinds") * F.col("q")) / (F.col("all") + F.col("kinds")), F.col("q"))
        found = stored(below.select("code", "m", p.alias("p")))
    return found.select("code", "m", F.log10("p").alias("log10"))


def sum_known(sequences: list[bytes], known: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """For each sequence the sum over its grams that are in ``known`` (ascending), and its other grams with their counts."""
    code = codes(sequences)
    owner = np.repeat(np.arange(len(sequences), dtype=np.int32), list(map(len, sequences)))
    order = np.argsort(code)
    code, owner = code[order], owner[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    distinct, times = code[first], np.diff(np.append(first, len(code)))
    at = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
    is_known = known[at] == distinct if len(known) else np.zeros(len(distinct), bool)
    total = np.bincount(owner, weights=np.repeat(np.where(is_known, logs[at] if len(known) else 0.0, 0.0), times), minlength=len(sequences))
    other = np.repeat(~is_known, times)
    code, owner = code[other], owner[other]
    order = np.argsort(owner, kind="stable")  # codes stay ascending within a sequence
    code, owner = code[order], owner[order]
    first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1]))) if len(code) else np.zeros(0, np.int64)
    bounds = np.searchsorted(owner[first], np.arange(len(sequences) + 1)).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(code[first]), pa.array(np.diff(np.append(first, len(code))).astype(np.int64))], ["code", "times"])
    return total, pa.ListArray.from_arrays(pa.array(bounds), items)


def score_texts(docs: DataFrame, fold: int = 7, held: int = 2, least_bits: float = LEAST_BITS) -> DataFrame:
    """A row for every row of ``docs``: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learns from the rows whose crc32(doc_id as text) mod ``fold`` is not ``held``. A token is a word with A-Z lowered,
    or the one end of a text; a null text counts as empty. ``base_score`` is the add-one score of single tokens,
    ``score`` the suffix tree's log10 probability of the text. A null doc_id is neither learned from nor held out.
    Repeated rows count and are scored each on its own; an empty table gives an empty result.
    """
    learn = F.coalesce(doc_mod("doc_id", fold) != held, F.lit(False))
    counts = corpus_counts(docs.select(learn.alias("learn"), F.col("text").cast("string").alias("text")))
    vocabulary = counts.filter("word is not null")
    facts = vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, distinct = facts["n"] or 0, facts["v"]
    words = vocabulary.select("word", "n")
    least = max(1, int(np.ceil(n_train * HEAD_SHARE)))
    is_end = F.col("word") == F.lit(b"\n")
    frequent = words.filter(is_end | ((F.col("n") >= least) & (F.length("word") <= HEAD_BYTES))).toArrow()  # 1 / HEAD_SHARE rows and the end, at most
    spark = docs.sparkSession
    head = spark.sparkContext.broadcast(dict(zip(frequent.column(0).to_pylist(), frequent.column(1).to_pylist(), strict=True)))
    by_gram = gram_logs(counts, least_bits)
    places = by_gram.agg(F.sum("m")).first()[0] or 0
    often = by_gram.filter(F.col("m") >= max(1, int(np.ceil(places * GRAM_SHARE)))).select("code", "log10").toArrow()  # 1 / GRAM_SHARE rows at most
    order = np.argsort(often.column(0).to_numpy())
    grams_head = spark.sparkContext.broadcast((often.column(0).to_numpy()[order], often.column(1).to_numpy()[order]))

    def run(batches):
        own, part, at = head.value, TaskContext.get().partitionId(), 0
        logs = {w: float(np.log10(n + 1)) for w, n in own.items()}
        end = logs.get(b"\n", 0.0)
        names = ["doc_id", "row", "n_tokens", "n_known", "logs", "score", "rest", "grams"]
        known_codes, known_logs = grams_head.value
        has_end = b"\n" in own
        for ids, texts in pairs(batches, 2_000_000):
            n_tokens, n_known, sums, sequences = [], [], [], []
            rare, times, bounds = [], [], [0]  # words that aren't in the head, side by side
            for text in texts:
                tokens = words_of(text)
                sequences.append(b" ".join(tokens) + b"\n")
                found = list(map(logs.get, tokens))
                known = [x for x in found if x is not None]
                rest = Counter([w for w, x in zip(tokens, found, strict=True) if x is None]) if len(known) < len(found) else {}
                rare += rest
                times += rest.values()
                bounds.append(len(rare))
                n_tokens.append(len(tokens) + 1)
                n_known.append(len(known) + has_end)
                sums.append(sum(known) + end)
            score, others = sum_known(sequences, known_codes, known_logs)
            words_left = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], ["word", "times"]))
            row = pa.array((part << 40) + at + np.arange(len(ids)))
            at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), row, *(pa.array(c, pa.int64()) for c in (n_tokens, n_known)), pa.array(sums, pa.float64()), pa.array(score), words_left, others], names)

    scored = stored(
        documents(docs).mapInArrow(run, "doc_id long, row long, n_tokens long, n_known long, logs double, score double, rest array<struct<word:binary,times:long>>, grams array<struct<code:long,times:long>>")
    )
    rare = scored.select("row", F.inline("rest")).join(words.withColumnRenamed("n", "c"), "word")
    by_row = rare.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_logs"))
    others = scored.select("row", F.inline("grams")).join(by_gram, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("log10")).alias("more_score"))
    zero = F.lit(0)
    return scored.drop("rest", "grams").join(by_row, "row", "left").join(others, "row", "left").select(
        "doc_id",
        F.coalesce(doc_mod("doc_id", fold) == held, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", zero)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n_train + distinct + 1)))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
