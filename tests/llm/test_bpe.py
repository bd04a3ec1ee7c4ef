import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsewright.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXT = st.text(alphabet=st.one_of(st.sampled_from(list("abcdeth  \n\t'slré日0123.!?\x1f\x85\u00a0")), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def public():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_are_those_of_the_public_encoder(text):
    e = bpe.encoder(PATH, P.PATTERN)
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.vocabulary.ranks, special_tokens={})
    ids = np.frombuffer(e.memo(text), "<u4").tolist()
    assert ids == public.encode_ordinary(text)
    assert e.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 60), st.integers(0, 6), TEXT), max_size=4))
def test_edits_give_what_encoding_anew_gives(text, edits):
    e = bpe.encoder(PATH, P.PATTERN)
    own = bpe.EditableText(e, text)
    for start, size, new in edits:
        start = min(start, len(own.text))
        own.replace(start, min(len(own.text), start + size), new)
        assert own.ids() == e.encode(own.text)
    own.append(text)
    assert own.ids() == e.encode(own.text)


def test_prefixes_grow_by_exact_appends():
    v = bpe.encoder(PATH, P.PATTERN).vocabulary
    grown = bpe.Prefix(v)
    for part in (b"inter", b"nation", b"alisation", "é".encode()):
        grown.append(part)
        assert grown.ids() == bpe.Prefix(v, bytes(grown.data)).ids()


def test_odd_rows(odd_docs, odd_rows, no_docs, public):
    got = sorted(tuple(r) for r in bpe.encode_digests(odd_docs.filter("doc_id is not null"), PATH, P.PATTERN).collect())
    want = []
    for doc, text, *_ in odd_rows:
        if doc is not None:
            ids = public.encode_ordinary(text or "")
            want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode(no_docs, PATH, P.PATTERN).count() == 0
    assert {len(r.ids) for r in bpe.encode(odd_docs.filter("doc_id < 3"), PATH, P.PATTERN).collect()} == {0}
