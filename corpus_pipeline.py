"""From raw documents to packed training sequences, stage by stage.

Every stage is written as Parquet before the next one reads it, so a lost executor costs a
stage's tasks at most, and no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentalytics.llm import jaccard_join, mixing, packing, quality_rules, secrets
from rentalytics.llm.common import n_words, read
from rentalytics.runtime import stage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the quality model fitted on the labelled ones among them."""
    model = quality_rules.train(docs, read(spark, sf_dir, "labels"), "doc_id", "text")
    return quality_rules.judge(docs, "text", model).filter("kept").select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return jaccard_join.keep_one(docs, "doc_id", "text")


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and the number of characters set anew where that happened."""
    found = secrets.scan(docs, "text", mark="<SECRET>")
    changed = F.when(F.col("secret_spans") != "", F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).select(*docs.columns)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks: weights 3, 1, 2 in turn, 150 % of all words, twice at most."""
    return mixing.mixed_rows(docs, n_words(F.col("text")), "source", weights=(3, 1, 2))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 2048 tokens."""
    return packing.pack(docs, "text", ["doc_id"])


STAGES = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("secret scans", redacted_documents),
    ("mixing sources to target weights", mixed_documents),
    ("packing", packed_sequences),
]

# A fitted model, redaction by a guess-cost search and token ids have no SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. An empty table runs through and gives no sequences."""
    docs = read(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
