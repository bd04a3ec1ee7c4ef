"""Cutting long plans: a frame that several later steps read is made once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """Written as Parquet to the shared checkpoint folder where the session names one, and read again by column; else kept by Spark.

    Columns are compressed together, later steps read those that they need, and Spark knows how large the frame is.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
