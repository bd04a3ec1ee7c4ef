"""Byte-level BPE by prefix dynamic programming, and its decoding.

For every byte prefix of a piece exactly one token can end a valid encoding. ``Prefix`` stores that token for each
length, so appending bytes extends the table and never changes it, and the ids are read off by walking back. A token b
may follow a token a when merging the bytes of both gives just [a, b]; that is decided by undoing their merges from the
latest to the earliest and looking whether a merge across the border would have come first.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pulsewright.llm.common import documents, pairs
from pulsewright.llm.memo import ChunkMemo, Recent

NEVER = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Ranks with what the prefix table needs: the last merge of each token and which tokens may be neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._next_to: dict[int, bool] = {}
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        #: rank of each token that merges reach, -1 for what is only the end of one
        self.kind = dict.fromkeys((b[k:] for b in ranks for k in range(len(b))), -1)
        self.kind.update((b, i) for b, i in ranks.items() if self.reached(b))

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes a token; None for one byte, and for a token that merges never reach."""
        if token not in self._halves:
            parts = [token[k : k + 1] for k in range(len(token))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[k] + parts[k + 1], NEVER), k) for k in range(len(parts) - 1))
                if rank >= self.ranks[token]:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def reached(self, token: bytes) -> bool:
        return len(token) == 1 or self.halves(token) is not None

    def next_to(self, a: int, b: int) -> bool:
        """Whether token b may follow token a."""
        if len(self._next_to) > 2_000_000:
            self._next_to.clear()
        found = self._next_to[a << 32 | b] = self._stay_apart(self.bytes_of[a], self.bytes_of[b])
        return found

    def _stay_apart(self, a: bytes, b: bytes) -> bool:
        ranks, until = self.ranks, NEVER
        while True:
            if ranks.get(a + b, NEVER) < until:
                return False
            if len(a) == len(b) == 1:
                return True
            made_a = ranks[a] if len(a) > 1 else -1
            made_b = ranks[b] if len(b) > 1 else -1
            if made_b >= made_a:  # of equal merges the left one comes first, so b's is the later one
                b, until = self.halves(b)[0], made_b + 1
            else:
                a, until = self.halves(a)[1], made_a


class Prefix:
    """The last token of every byte prefix; grows by exact appends, and never changes what it has."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        v, last = self.vocabulary, self.last
        kind, known = v.kind.get, v._next_to.get
        begin = len(self.data)
        self.data = whole = self.data + data
        for end in range(begin + 1, len(whole) + 1):
            start = end - 1
            while (token := kind(whole[start:end])) is not None:
                if token >= 0:
                    if start == 0:
                        break
                    before = last[start]
                    fits = known(before << 32 | token)
                    if v.next_to(before, token) if fits is None else fits:
                        break
                start -= 1
                if start < 0:
                    raise ValueError("no token ends here")
            else:
                raise ValueError("no token ends here")
            last.append(token)

    def become(self, data: bytes) -> None:
        """Other bytes: the table of what both have in common stays."""
        old, shared = self.data, 0
        for a, b in zip(old, data):
            if a != b:
                break
            shared += 1
        del self.last[shared + 1 :]
        self.data = data[:shared]
        self.append(data[shared:])

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.data)
        if whole is not None:  # a piece that is a token is that token
            return [whole]
        size, last = self.vocabulary.size, self.last
        found, end = [], len(self.data)
        while end:
            token = last[end]
            found.append(token)
            end -= size[token]
        return found[::-1]


class Encoder:
    """Texts to ids and back; each match of the pattern is encoded separately."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = v = Vocabulary(load_ranks(path))
        self.pattern = regex.compile(pattern)
        self.pieces = Recent(600_000)
        self.memo = ChunkMemo(self.encode_bytes, self.encode_chunks)
        most = max(v.bytes_of, default=-1) + 1
        self.decimal = [b"%d" % i for i in range(most)]
        self.bytes_by_id = [v.bytes_of.get(i) for i in range(most)]

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode()
        rank = self.vocabulary.ranks.get(data)
        return [rank] if rank is not None else Prefix(self.vocabulary, data).ids()

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces: taken in order, each shares the table of its common prefix with the one before."""
        table, ids = Prefix(self.vocabulary), {}
        for piece in sorted(pieces):
            data = piece.encode()
            if (rank := self.vocabulary.ranks.get(data)) is not None:
                ids[piece] = array("I", [rank]).tobytes()
            else:
                table.become(data)
                ids[piece] = array("I", table.ids()).tobytes()
        return [ids[p] for p in pieces]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that have no blank, each with one before it; see ``memo``."""
        found = self.pattern.findall(" " + " ".join(chunks))
        ids = list(map(self.pieces.of(set(found), self._encode_pieces).__getitem__, found))
        starts = [k for k, p in enumerate(found) if p[0] == " "]
        return [b"".join(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(found)], strict=True)]

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        found = self.pattern.findall(text)
        return b"".join(map(self.pieces.of(set(found), self._encode_pieces).__getitem__, found))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_by_id.__getitem__, ids))


class EditableText:
    """A text with its ids that follows edits by encoding only the pieces near them."""

    #: The pattern looks at most this many characters past the start of a piece that it cuts short (as in 'll).
    LOOK = 3

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.pieces: list[list[int]] = []
        self.replace(0, 0, text)

    def append(self, text: str) -> int:
        return self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in the place of text[start:end]; how many pieces were encoded anew."""
        k = max(0, bisect_right(self.starts, max(0, start - self.LOOK)) - 2)
        moved = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        at = self.starts[k] if k < len(self.starts) else 0
        old = {s + moved: j for j, s in enumerate(self.starts) if s >= end}
        starts, pieces = self.starts[:k], self.pieces[:k]
        for count, m in enumerate(self.encoder.pattern.finditer(self.text, at)):
            if (j := old.get(m.start())) is not None and m.start() >= start + len(new):
                self.starts = starts + [s + moved for s in self.starts[j:]]
                self.pieces = pieces + self.pieces[j:]
                return count
            starts.append(m.start())
            pieces.append(self.encoder.encode_piece(m.group()))
        self.starts, self.pieces = starts, pieces
        return len(starts) - k

    def ids(self) -> list[int]:
        return [i for piece in self.pieces for i in piece]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, then: Callable | None = None, schema: pa.Schema | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``docs``; a null text counts as empty and has no ids.

    ``ids`` are as the public encoders of this vocabulary give them without special tokens; ``decoded`` are the bytes
    that the ids stand for. Rows keep their partition, repeated rows give repeated rows, other columns are not read.
    ``then(encoder, ids bytes)`` with ``schema`` puts other columns in their place.
    """
    schema = schema or pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def plain(e: Encoder, ids: bytes):
        found = np.frombuffer(ids, "<u4").tolist()
        return found, e.decode(found)

    def run(batches):
        e = encoder(path, pattern)
        for ids, texts in pairs(batches):
            rows = [(then or plain)(e, found) for found in e.memo.batch(texts)]
            columns = [pa.array(ids, pa.int64())] + [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    from pyspark.sql.pandas.types import from_arrow_schema

    return documents(docs).mapInArrow(run, from_arrow_schema(schema))


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digest(e: Encoder, ids: bytes):
    found = np.frombuffer(ids, "<u4").tolist()
    return len(found), hashlib.sha256(b",".join(map(e.decimal.__getitem__, found))).hexdigest(), hashlib.sha256(e.decode(found)).hexdigest()


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the digests of what ``encode`` returns."""
    return encode(docs, path, pattern, digest, DIGESTS)
