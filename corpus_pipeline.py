"""From raw documents to a training mix: drop toxic text, near copies and benchmark text, redact, mix sources.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and all but the last return the columns of
``documents``. Between stages the rows lie in Parquet files, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm import decontamination, mixing, near_copies, pii, simhash, toxicity
from roadpulse.llm.common import stored
from roadpulse.session import ship

#: Stages learn, search and draw at random, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns toxicity from the labelled documents among ``docs`` and drops those it predicts to be toxic."""
    ship(spark)
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near copies: SimHash, and 5-word shingles with Jaccard 0.8 or more."""
    ship(spark)
    return simhash.keep_one(docs, rule=near_copies)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; a few hit words below the limit are left."""
    ship(spark)
    return decontamination.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; ``n_chars`` follows the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with their whole passes and the words of the last, cut one."""
    taken = mixing.mix(docs).where(F.col("taken") > 0)
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken",
                        F.floor(F.col("taken") / F.col("size")).alias("whole_passes"), (F.col("taken") % F.col("size")).alias("words_of_last"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("pii", redact),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
