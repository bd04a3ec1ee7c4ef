"""Ids of whole texts from a bounded memo of the chunks between single blanks.

Both byte-level vocabularies cut a text by the same public pattern, in which a blank before a visible character always
starts a new piece. So a text whose blanks are single is the join of its blank-separated chunks, each encoded with its
blank; chunks repeat, texts seldom do. Chunks that the memo doesn't have are encoded together, once for each batch of
texts. Any text outside that rule is encoded whole.
"""

from __future__ import annotations

import gc
from collections.abc import Callable
from contextlib import contextmanager


@contextmanager
def no_cycles():
    """Many small lists and strings, none of which refers to itself: looking for cycles among them is idle work."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Recent:
    """A memo of bounded size: when it is full it becomes the old half, from which keys in use come back."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def of(self, keys: set, make: Callable[[list], list]) -> dict:
        """A dictionary with the value of each of some keys, others among them; ``make`` gives those of the keys that aren't known."""
        young, old = self.young, self.old
        missing = keys.difference(young)
        unknown = missing.difference(old)
        for key in missing - unknown:
            young[key] = old[key]
        unknown = list(unknown)
        young.update(zip(unknown, make(unknown) if unknown else (), strict=True))
        if len(young) > self.most:
            self.young, self.old = {}, young
        return young


class ChunkMemo:
    """Texts to little-endian unsigned 32-bit ids.

    ``encode`` gives the ids of a whole text. ``encode_all`` gives those of several chunks, each with a blank before it.
    """

    def __init__(self, encode: Callable[[str], bytes], encode_all: Callable[[list[str]], list[bytes]], odd: Callable[[str], bool] = lambda s: False, most: int = 600_000):
        self.encode, self.encode_all, self.odd = encode, encode_all, odd
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.chunks, self.heads = Recent(self.most), Recent(self.most // 4)

    def alone(self, chunk: str) -> bool:
        if not chunk or chunk[0] < "!" or chunk[-1] < "!" or chunk[0].isspace() or chunk[-1].isspace():
            return False
        return not self.odd(chunk)

    def _rest(self, chunks: list[str]) -> list[bytes | bool]:
        sound = [c for c in chunks if c.isalpha() or self.alone(c)]
        coded = self.encode_all(sound) if sound else []
        if len(sound) == len(chunks):
            return coded
        known = dict(zip(sound, coded, strict=True))
        return [known.get(c, False) for c in chunks]

    def _first(self, chunks: list[str]) -> list[bytes | bool]:
        return [self.encode(c) if self.alone(c) else False for c in chunks]

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text, as bytes."""
        with no_cycles():
            return self._batch(texts)

    def _batch(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        first = [s.pop(0) for s in split]
        heads = self.heads.of(set(first), self._first)
        rest = self.chunks.of(set().union(*split), self._rest).__getitem__
        out = []
        for text, head, s in zip(texts, first, split, strict=True):
            try:
                out.append(heads[head] + b"".join(map(rest, s)))
            except TypeError:  # a chunk that can't stand alone
                out.append(self.encode(text) if text else b"")
        return out

    def __call__(self, text: str) -> bytes:
        return self.batch([text])[0]
