"""Best-fit packing of whole documents into sequences of a fixed number of tokens.

Best-fit decreasing looks only at lengths, of which there are at most as many as a sequence has tokens. So the counts of
each length are all that the plan needs: a segment tree over the remaining capacities finds the tightest open sequence
for a length in logarithmic time, and sequences that stand alike are moved together. The plan is the one that placing
every document singly would give, its size depends on the capacity alone, and every piece then finds its place by its
rank among the pieces of its length. Ranks come from counts of each length in each partition, never from one task.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from pulsewright.llm.common import cut, documents, give_back, pairs
from pulsewright.llm.memo import ChunkMemo

END = "<|endoftext|>"
TOGETHER = 200
#: Chunks that a task remembers, and characters of texts that it encodes at a time.
KNOWN, SLICE = 400_000, 2_000_000
#: Letters up to U+024F, digits and symbols: what the pattern makes of them does not depend on a version of Unicode. Apostrophes are left out.
LETTERS, SYMBOLS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-&(-/:-@\[-`{-~"
SIMPLE = re.compile(rf"(?: [{LETTERS}0-9{SYMBOLS}]+(?:\n[{LETTERS}0-9{SYMBOLS}]+)*)+").fullmatch
PIECES = re.compile(rf" ?[{LETTERS}]+| ?[0-9]+| ?[{SYMBOLS}]+|\n").findall


def _spelled() -> np.ndarray:
    """The character that stands for each byte in vocabularies of bytes, as UTF-16; byte 0 parts pieces and becomes a blank."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = np.zeros(256, "<u2")
    table[own] = own
    table[[b for b in range(256) if b not in own]] = 256 + np.arange(256 - len(own))
    table[0] = ord(" ")
    return table


SPELLED = _spelled()


class CapacityTree:
    """How many groups of open sequences have each remaining capacity; finds the least capacity of at least some size."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, remaining: int, by: int) -> None:
        k = remaining + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def tightest(self, size: int) -> int | None:
        k = size + self.leaves
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):  # up, until a subtree to the right holds something
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:  # then down along the left
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        return k - self.leaves


def best_fit_plan(counts: Mapping[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces in each sequence, offset there), by length and rank.

    Pieces of a length with ranks from the first rank on fill one sequence after another, so many in each.
    """
    tree = CapacityTree(capacity)
    alike: dict[int, list[tuple[int, int]]] = {}
    plan, opened = [], 0

    def put(remaining: int, first: int, number: int) -> None:
        if number and remaining:
            alike.setdefault(remaining, []).append((first, number))
            tree.add(remaining, 1)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                each = capacity // length
                remaining, first, number = capacity, opened, -(-left // each)
                opened += number
            else:
                first, number = alike[remaining].pop()
                tree.add(remaining, -1)
                each = remaining // length
            plan.append((length, rank, first, each, capacity - remaining))
            full, over = min(number, left // each), 0
            if full < number:
                over = left - full * each
            placed = full * each + over
            put(remaining - each * length, first, full)
            if over:
                put(remaining - over * length, first + full, 1)
            put(remaining, first + full + bool(over), number - full - bool(over))
            rank, left = rank + placed, left - placed
    return np.array(sorted(plan), np.int64).reshape(-1, 5)


_MEMOS: dict[str, ChunkMemo] = {}


def memo(path: str) -> ChunkMemo:
    """One tokenizer for each worker process and vocabulary."""
    if path not in _MEMOS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives each task one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        tokenizer = Tokenizer.from_file(path)
        by_piece = Tokenizer(tokenizer.model)  # the same merges, for pieces that are cut and spelled in the vocabulary's alphabet already
        by_piece.pre_tokenizer = WhitespaceSplit()
        #: which ids begin with a blank, that no other character of this vocabulary's alphabet stands for
        blank = np.zeros(1 + max(tokenizer.get_vocab().values()), bool)
        blank[[i for token, i in tokenizer.get_vocab().items() if token[0] == "\u0120"]] = True

        def encode(text: str) -> bytes:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

        def spelled(line: str) -> str:
            """A simple line's pieces, apart from each other and in the vocabulary's alphabet."""
            return SPELLED[np.frombuffer("\0".join(PIECES(line)).encode(), np.uint8)].tobytes().decode("utf-16-le")

        def encode_all(chunks: list[str]) -> list[bytes]:
            """Many chunks in few calls; as no chunk holds a blank, each begins where a token begins with one.

            Lines of simple chunks are cut into pieces here, which spares the tokenizer its pattern and its count of places.
            """
            out: list[bytes] = []
            for at in range(0, len(chunks), TOGETHER * 32):
                some = chunks[at : at + TOGETHER * 32]
                lines = [" " + " ".join(some[k : k + TOGETHER]) for k in range(0, len(some), TOGETHER)]
                simple = [bool(SIMPLE(line)) for line in lines]
                coded = iter(by_piece.encode_batch_fast([spelled(x) for x, s in zip(lines, simple, strict=True) if s], add_special_tokens=False))
                ids = np.concatenate([np.array((next(coded) if s else tokenizer.encode(x, add_special_tokens=False)).ids, "<u4") for x, s in zip(lines, simple, strict=True)])
                starts, data = (4 * np.flatnonzero(blank[ids])).tolist(), ids.tobytes()
                out += [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
            return out

        _MEMOS[path] = ChunkMemo(encode, encode_all, odd=lambda chunk: END in chunk, most=KNOWN)
    return _MEMOS[path]


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; of a longer one only the first may be shorter."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)


def as_list(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def pack(docs: DataFrame, path: str, capacity: int = 2048, value: Callable[[bytes], object] = as_list, name: str = "ids", kind: pa.DataType | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece of every row of ``docs``.

    A document is its ids followed by id 0; a null or empty text is that id alone. Only a document of more than
    ``capacity`` ids is cut. Each sequence is gapless from offset 0. Repeated rows are packed each on its own, an empty
    table gives an empty result, other columns are not read. ``value`` makes column ``name`` of type ``kind`` from the
    little-endian ids of a piece.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), (name, kind or pa.list_(pa.int64())), ("part", pa.int32()), ("rank", pa.int64())]
    )

    def tokenize(batches):
        known = memo(path)
        encode, part, seen = known.batch, TaskContext.get().partitionId(), [0] * (capacity + 1)
        for ids, texts in pairs(batches, SLICE):
            rows = []
            for doc_id, tokens in zip(ids, encode(texts), strict=True):
                tokens += b"\0\0\0\0"
                for k, (start, length) in enumerate(pieces_of(len(tokens) // 4, capacity)):
                    rows.append((doc_id, k, start, length, value(tokens[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
        known.forget()  # the next task of this worker may be another stage's, which has no use for chunks
        give_back()

    pieces = cut(documents(docs).mapInArrow(tokenize, from_arrow_schema(schema)))
    # at most one row for each length and partition
    by_part = cut(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    before = by_part.select(
        "length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")
    )
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = best_fit_plan(counts, capacity)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(plan)  # a few rows for each length, however many documents there are
    spans = spark.sparkContext.broadcast({n: np.searchsorted(plan[:, 0], [n, n + 1]) for n in counts})

    out = pa.schema([*list(schema)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        plan, of_length = shared.value, spans.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            sizes, starts = np.unique(length[order], return_index=True)
            for size, at in zip(sizes.tolist(), np.split(order, starts[1:]), strict=True):
                lo, hi = of_length[size]
                rows = plan[lo:hi]
                row = rows[np.searchsorted(rows[:, 1], rank[at], side="right") - 1]
                nth = rank[at] - row[:, 1]
                sequence[at] = row[:, 2] + nth // row[:, 3]
                offset[at] = row[:, 4] + nth % row[:, 3] * size
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], schema=out)

    ranked = pieces.join(before, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", name, (F.col("rank") + F.col("before")).alias("rank")
    )
    return ranked.mapInArrow(place, from_arrow_schema(out))


def pack_digests(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """What ``pack`` returns, with ids_crc32 in the place of the ids."""
    return pack(docs, path, capacity, crc, "ids_crc32", pa.int64())
