"""From raw documents to packed sequences: five stages, each over all that its predecessor kept.

Every stage but the last returns the columns of ``documents``, with n_chars as the text then has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from pulsewright.llm import linededup, packing, pii, quality, simhash
from pulsewright.llm.common import stored, table


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, n_chars (if there) being the length of the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that pass the counting rules and hold enough content lines; null and empty texts go, an empty table stays empty."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document has.

    A null text stays null, and so does its n_chars; a row without doc_id keeps its text, rows that repeat lose the same
    blocks, a copy stays as a row with an empty text. An empty table stays empty.
    """
    return _counted(linededup.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Texts without words, null or empty, are one group. Of rows with null or repeated ids one of each group stays too, and of
    rows that repeat one. An empty table stays empty.
    """
    return simhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the kinds of personal data in the place of the data; a null text stays null, an empty table empty."""
    return _counted(pii.redact(docs, pii.fit(docs)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null or empty text is its end token alone, rows that repeat are packed each on their own, an empty table has no pieces."""
    return packing.pack_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no way to state the fitted stages; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
