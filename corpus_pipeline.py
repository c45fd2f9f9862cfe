"""Documents to token ids in five stages; each takes (spark, docs, sf_dir) and works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import exact_dedup, mixing, quality_rules, sentencepiece_codec, simhash
from tickloom.llm.common import stash


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that a quality rule rejects go."""
    return quality_rules.filter_documents(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of equal texts the largest doc_id stays."""
    return exact_dedup.filter_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of near duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return simhash.filter_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: sources take their target weights; a document comes 0 to 3 times."""
    return mixing.repeat_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: token ids, and whether they decode to the text again."""
    return sentencepiece_codec.round_trip(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL has neither SimHash nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = stash(docs)
    return docs
