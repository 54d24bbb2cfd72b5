"""From raw documents to packed sequences: each stage reads what the one before it kept.

All stages take null and empty texts for texts without words, keep rows whose doc_id is null or shared by different texts apart by
their texts, leave one row of equal ones, and give an empty table for an empty one. Other columns travel along unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import contamination, digest_merge, near, packing, quality
from sedge.llm.scratch import materialized
from sedge.llm.tokens import vocabulary_path

SEQUENCE = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    trusted = _table(spark, sf_dir, "labels").filter((F.col("quality") == 1) & (fold != 1))
    return docs.filter(quality.is_good("text", quality.fit_quality(docs, trusted, "doc_id", "text")))


def one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return digest_merge.first_of_equals(docs, "doc_id", "text")


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the row with the smallest doc_id."""
    return near.one_of_each(docs, "doc_id", "text")


def unseen_in_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a test item; a document goes by its text, whatever its doc_id."""
    return contamination.uncontaminated(docs, "text", _table(spark, sf_dir, "benchmark"), "text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place."""
    return packing.pack(docs, "doc_id", "text", vocabulary_path(), SEQUENCE)


STAGES = [
    ("quality classifier", good_texts),
    ("exact dedup", one_of_equals),
    ("n-gram Jaccard join", one_of_near),
    ("benchmark decontamination", unseen_in_tests),
    ("best-fit packing", packed),
]
# Learned scores and alignments are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written once and read by the next."""
    docs = _table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = materialized(stage(spark, docs, sf_dir), f"stage-{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
