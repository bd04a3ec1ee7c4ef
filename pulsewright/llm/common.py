"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """Only the two columns that operators read; other columns never reach a task."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def pairs(batches: Iterable[pa.RecordBatch], slice_chars: int = 8_000_000) -> Iterator[tuple[list, list]]:
    """(ids, texts) of each batch, in slices of a bounded number of characters; a null text is empty."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        start, size = 0, 0
        part: list[str] = []
        for k in range(len(ids)):
            text = texts[k].as_py() or ""
            part.append(text)
            size += len(text)
            if size >= slice_chars:
                yield ids[start : k + 1], part
                start, size, part = k + 1, 0, []
        if part:
            yield ids[start:], part


def give_back() -> None:
    """What a task no longer uses goes back to the system, as its worker goes on to other stages beside a JVM that has grown."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def arrow_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def doc_mod(column: str, m: int) -> Column:
    """crc32 of an id written as text, modulo m."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")  # one machine, as in tests
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder, so that nothing above it runs again and lost executors cost nothing."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, for frames of many rows: written as Parquet in the shared folder and read again by column."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_counted(left: DataFrame, right: DataFrame, key: str, total: int, share: float) -> DataFrame:
    """``left`` with the one row of ``right`` that has its key, where there is one; column n of ``right`` counts the rows of ``left``.

    Keys with at least ``share`` of ``total`` rows are broadcast, at most 1 / ``share`` of them, so no task meets a
    frequent key's rows; all other keys are joined by shuffles. ``right`` is read three times.
    """
    often = max(2.0, share * total)
    frequent = F.broadcast(right.filter(F.col("n") >= often).drop("n"))
    rest = right.filter(F.col("n") < often).drop("n")
    return left.join(frequent, key).unionByName(left.join(frequent.select(key), key, "left_anti").join(rest, key))


def free_name(stem: str, taken: list[str]) -> str:
    """A column name that no column in ``taken`` has; Spark tells no case apart."""
    known = {c.lower() for c in taken}
    return next(n for k in range(len(taken) + 1) if (n := f"{stem}_{k}") not in known)
