import hashlib
import math
import struct
import tarfile
import zlib
from collections import Counter

from pyspark.sql import functions as F

from pulsewright.llm import media


def padded(text):
    data = (text or "").encode()
    return data + bytes(max(64, (len(data) + 63) // 64 * 64) - len(data))


def decoded(png):
    """Samples of an unfiltered 8-bit grey picture, by the format's description alone."""
    assert png[:8] == bytes([137]) + b"PNG\r\n\x1a\n"
    at, head, packed = 8, None, b""
    while at < len(png):
        (size,) = struct.unpack_from(">I", png, at)
        kind, data, (check,) = png[at + 4 : at + 8], png[at + 8 : at + 8 + size], struct.unpack_from(">I", png, at + 8 + size)
        assert check == zlib.crc32(kind + data)
        head = data if kind == b"IHDR" else head
        packed += data if kind == b"IDAT" else b""
        at += 12 + size
    assert kind == b"IEND"
    width, height, bits, colour, method, filters, interlaced = struct.unpack(">IIBBBBB", head)
    assert (bits, colour, method, filters, interlaced) == (8, 0, 0, 0, 0)
    rows = zlib.decompress(packed)
    assert len(rows) == height * (width + 1) and not any(rows[k * (width + 1)] for k in range(height))
    return b"".join(rows[k * (width + 1) + 1 : (k + 1) * (width + 1)] for k in range(height))


def summary(payload):
    n, mean = len(payload), sum(payload) / len(payload)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(payload).values())
    edges = [k * n // 64 for k in range(65)]
    bits = 0
    for a, b in zip(edges, edges[1:], strict=False):
        bits = bits << 1 | (sum(payload[a:b]) / (b - a) > mean)
    return f"{mean:.4f}", f"{entropy + 0.0:.4f}", f"{bits:016x}"


def test_payload_comes_back():
    for text in ("", None, "a", "x" * 64, "x" * 65, "é日本" * 1000, "\x00"):
        assert media.payload_of(text) == padded(text)
        assert decoded(media.to_png(padded(text))) == padded(text) == media.from_png(media.to_png(padded(text)))


def test_odd_rows(spark, odd_docs, odd_rows, no_docs, tmp_path):
    folder = str(tmp_path / "shards")
    got = media.media_columns(odd_docs, folder).collect()
    assert len(got) == len(odd_rows)
    texts = dict((r[0], r[1]) for r in odd_rows)
    for r in got:
        payload = padded(texts[r.doc_id])
        assert r.n_bytes == len((texts[r.doc_id] or "").encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.width, r.height, r.bits) == (len(payload), 1, 8)
        assert tuple(r.feature.split(":")) == summary(payload)
        with open(f"{folder}/{r.shard}", "rb") as f:  # the row's place holds the row's payload
            f.seek(r.offset)
            stored = f.read(r.length)
        assert decoded(stored) == payload and r.media_bytes == len(stored)
        assert r.media_sha256 == r.digest == hashlib.sha256(stored).hexdigest()
    same = [r for r in got if r.doc_id in (1, 2)]
    assert len({tuple(r)[1:] for r in same}) == 1
    names = set()
    for shard in (tmp_path / "shards").glob("*.tar"):
        assert shard.stem == hashlib.sha256(shard.read_bytes()).hexdigest()
        with tarfile.open(shard) as t:
            for member in t:
                data = t.extractfile(member).read()
                assert member.name == hashlib.sha256(data).hexdigest() + ".png"
                names.add(member.name)
    assert {f"{r.media_sha256}.png" for r in got} == names
    assert media.media_columns(no_docs, str(tmp_path / "none")).count() == 0
    rows = media.store(odd_docs, str(tmp_path / "again"))
    assert media.places(rows).count() == rows.select(F.count_distinct("digest")).first()[0]
    heads = media.describe(media.places(rows), str(tmp_path / "again")).collect()
    assert {(r.digest, r.width) for r in heads} == {(r.digest, r.width) for r in got}


def test_small_shards_and_a_small_memory_give_the_same(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k % 7} " * 50) for k in range(60)], "doc_id long, text string").coalesce(1)
    rows = media.store(docs, str(tmp_path), shard_bytes=3000, most=3)
    assert rows.count() == 60 and rows.select("digest").distinct().count() == 7 and rows.select("shard").distinct().count() > 5
    read = media.contents(media.places(rows), str(tmp_path)).collect()
    assert {r.payload_sha256 for r in read} == {hashlib.sha256(padded(f"text {k} " * 50)).hexdigest() for k in range(7)}
    assert sum(r.n for r in read) == 60
