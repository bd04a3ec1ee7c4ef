"""What the operators on embedding columns share: which rows count, and their entries as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries beyond this have no exact place in sums of products and are refused.
MOST = 1 << 40


def kept_vectors(df: DataFrame, column: str = "embedding", others: tuple[str, ...] = ("vec_id",)) -> tuple[DataFrame, int]:
    """(vector, then ``others``) of the rows whose vector is whole, and its length.

    A null vector and one with null or non-finite entries are dropped. All vectors have the greatest length that is
    left; a shorter one counts as one whose last entries are missing and is dropped. Length 0 means that none is left.
    """
    whole = df.select(F.col(column).cast("array<double>").alias("vector"), *others).filter(
        "vector is not null and forall(vector, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))"
    )
    width = whole.agg(F.max(F.size("vector"))).first()[0] or 0
    return whole.filter(F.size("vector") == width), width


def floored(column: pa.Array, width: int, factor: int) -> np.ndarray:
    """floor(factor * entry) of each vector of a batch, a row for each."""
    scaled = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) * float(factor))
    if scaled.size and np.abs(scaled).max() > MOST:
        raise ValueError(f"entries beyond {MOST} / {factor} have no exact sums")
    return scaled.astype(np.int64)
