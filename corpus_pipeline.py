"""Corpus pipeline: language ID, quality rules, near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; stages but the last return the columns of
`documents`. A stage's result is written as Parquet in the shared folder and read again as the next one's documents.

In every stage: null and empty texts have no words (the first stage drops them), long texts are read whole, other columns may be null and have any name, an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattmill.llm import decontaminate, langid, mixing, quality, simhash
from wattmill.llm.common import ship, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those of which no language has its share of words, go."""
    ship(spark)
    return langid.keep_known(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the threshold table go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that with the smallest id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go. Rows with one text go or stay together; without benchmark items all stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often: doc_id, leaf, tokens, budget, copies. Null languages and sources are leaves of their own; rows with one id
    have one place in the order and are taken or left together."""
    return mixing.mix_report(docs)


STAGES = [
    ("language", language),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]
#: Fingerprints and the random field are beyond SQL. Tests hold quality, near-dedup, decontamination and mixing against brute force or SQL, the language stage against held-out
#: labels, and the pipeline against its stages and on odd tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
