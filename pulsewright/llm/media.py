"""Media columns: payloads in content-addressed tar shards, and columns read back from them.

A payload is stored as an 8-bit grey PNG of one row, so that no filter bytes cut its text. Its name in the shard is the SHA-256 of the file. Rows
carry digest, shard, offset and length; a header-only range read fills the columns of a picture's shape, a full range
read the columns of its content. Every task fills shards of its own and names each by its bytes, so a task that runs
again leaves nothing behind; the rows then agree on one place for each digest.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from pulsewright.llm.common import documents, join_counted, pairs, shared_dir, stored

UNIT = 64
HEADER = 33
#: Payloads of at least this share of all rows are joined to them by a broadcast: at most 1 / FREQUENT rows of some 400 bytes.
FREQUENT = 1e-4
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> bytes:
    """UTF-8 and zero bytes up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    head = struct.pack(">IIBBBBB", len(payload), 1, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(b"\0" + payload, 6)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first 33 bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", data[16:25])
    return width, height, bits


def from_png(data: bytes) -> bytes:
    width, height, _ = png_header(data)
    at, packed = HEADER, b""
    while data[at + 4 : at + 8] != b"IEND":
        (size,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += size + 12
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are written")
    return rows[:, 1:].tobytes()


class Shard:
    """A tar file in memory, of a bounded size, that is written under the hash of its bytes."""

    def __init__(self):
        self.parts, self.size, self.name = [], 0, None

    def add(self, name: str, data: bytes) -> int:
        """The place of the data in the file."""
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.GNU_FORMAT)
        self.parts += [head, data, b"\0" * (-len(data) % 512)]
        offset = self.size + len(head)
        self.size = offset + len(data) + (-len(data) % 512)
        return offset

    def write(self, files: fs.FileSystem, root: str) -> None:
        data = b"".join([*self.parts, b"\0" * 1024])
        self.name, self.parts = f"{hashlib.sha256(data).hexdigest()}.tar", []
        with files.open_output_stream(f"{root}/{self.name}") as out:
            out.write(data)


def store(docs: DataFrame, folder: str, shard_bytes: int = 16_000_000, most: int = 100_000) -> DataFrame:
    """(doc_id, n_bytes, digest, shard, offset, length) of every row of ``docs``; writes the payloads on the way.

    A null text counts as empty, a null doc_id stays null. Equal payloads have one digest. A task stores a payload once
    among its last ``most`` different ones; ``places`` agrees on one place for all. A shard has the name of its content,
    so a task that runs again writes the same files. Repeated rows are kept, an empty table writes nothing, other
    columns are not read.
    """

    def write(batches):
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        shard, placed, rows = Shard(), {}, []
        names = ["doc_id", "n_bytes", "digest", "shard", "offset", "length"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

        def close():
            if shard.size:
                shard.write(files, root)
            found = [(i, n, digest, s.name, offset, length) for i, n, (digest, s, offset, length) in rows]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

        for ids, texts in pairs(batches):
            for doc_id, text in zip(ids, texts, strict=True):
                payload = payload_of(text)
                key = hashlib.sha256(payload).digest()
                if key not in placed:
                    if len(placed) >= most:
                        placed.clear()
                    data = to_png(payload)
                    digest = hashlib.sha256(data).hexdigest()
                    placed[key] = (digest, shard, shard.add(f"{digest}.png", data), len(data))
                rows.append((doc_id, len(text.encode("utf-8", "surrogatepass")), placed[key]))
                if shard.size > shard_bytes or len(rows) >= most:
                    yield close()
                    shard, rows = Shard(), []
        if rows:
            yield close()

    return stored(documents(docs).mapInArrow(write, "doc_id long, n_bytes long, digest string, shard string, offset long, length long"))


def places(rows: DataFrame) -> DataFrame:
    """(digest, shard, offset, length, n): of the places that tasks gave a payload, one for all, and how many rows have it."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p"), F.count(F.lit(1)).alias("n")).select("digest", "p.*", "n")


def _by_shard(where: DataFrame) -> DataFrame:
    """Neighbours in a shard are read by one task; a shard's size is bounded."""
    return where.repartition("shard").sortWithinPartitions("shard", "offset")


def _reading(folder: str, columns: dict[str, pa.DataType], of):
    """Rows of places, all columns kept, with ``columns`` by ``of(read, offset, length)``."""

    def run(batches):
        files, root = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    if source is not None:
                        source.close()
                    name, source = shard, files.open_input_file(f"{root}/{shard}")
                rows.append(of(source.read_at, offset, length))
            if rows:
                new = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), columns.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *columns])

    return run


HEAD_COLUMNS = {"width": pa.int64(), "height": pa.int64(), "bits": pa.int32()}
CONTENT_COLUMNS = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def _filled(where: DataFrame, folder: str, columns: dict[str, pa.DataType], of) -> DataFrame:
    schema = StructType([*where.schema.fields, *from_arrow_schema(pa.schema(list(columns.items()))).fields])
    return _by_shard(where).mapInArrow(_reading(folder, columns, of), schema)


def _head(read, offset: int, length: int):
    return png_header(read(HEADER, offset))


def describe(where: DataFrame, folder: str) -> DataFrame:
    """``where`` with the columns (width, height, bits) of stored pictures, from range reads of their headers alone."""
    return _filled(where, folder, HEAD_COLUMNS, _head)


def feature(samples: np.ndarray) -> str:
    """Mean, entropy of the values in bits, and 64 bits that tell which of 64 bands is lighter than the mean."""
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    mean = samples.mean()
    bands = np.add.reduceat(samples.astype(np.int64), np.arange(64) * len(samples) // 64) / np.diff(np.append(np.arange(64) * len(samples) // 64, len(samples)))
    bits = int.from_bytes(np.packbits(bands > mean).tobytes(), "big")
    return f"{mean:.4f}:{-(p * np.log2(p)).sum() + 0.0:.4f}:{bits:016x}"


def _content(read, offset: int, length: int):
    data = bytes(read(length, offset))
    payload = from_png(data)
    return (
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-UNIT:]),
        len(data),
        hashlib.sha256(data).hexdigest(),
        feature(np.frombuffer(payload, np.uint8)),
    )


def contents(where: DataFrame, folder: str) -> DataFrame:
    """``where`` with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, read back from the shards."""
    return _filled(where, folder, CONTENT_COLUMNS, _content)


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Every row of ``docs`` with its payload's columns, those of its header and of its content, and where it is.

    The header's columns come from a read of the header's range, the content's from a read of the whole range. A null text
    counts as empty, and an empty one has a payload of 64 zero bytes. Equal texts share one stored payload, whatever their
    ids; repeated rows and null ids are returned each on their own. An empty table gives an empty result, other columns are
    not read.
    """
    folder = folder or f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    rows = store(docs, folder)
    both = _filled(places(rows), folder, CONTENT_COLUMNS | HEAD_COLUMNS, lambda *place: (*_content(*place), *_head(*place)))
    return join_counted(rows.select("doc_id", "n_bytes", "digest"), stored(both), "digest", rows.count(), FREQUENT).select(
        "doc_id", "n_bytes", *CONTENT_COLUMNS, *HEAD_COLUMNS, "digest", "shard", "offset", "length"
    )
