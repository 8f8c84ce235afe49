"""The corpus pipeline: quality rules, SimHash near-duplicates, secret scans, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Nulls, empty and very long texts, ties and repeated rows have the results that the operators state: texts of under ten
words (null ones too) go in the first stage, repeated rows of one id and text are one from the second on, and an
empty table gives no rows. Clashing names of other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentrylake.llm import mixing, packing, quality_rules, secrets, simhash
from sentrylake.llm.common import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, links of resemblance 0.8 or more) one document stays."""
    return simhash.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.expand(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix's documents with their places in the packed sequences."""
    return packing.pack(docs).drop("text_hash")


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("secret scans", secret_scan), ("mixing", mix), ("packing", pack)]

#: SQL can't express the SimHash, tokenizer and best-fit stages; tests hold the first two stages, the masks of the third and
#: the packing against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return docs
