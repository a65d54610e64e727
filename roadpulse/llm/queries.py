"""Registered queries of the numbered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadpulse.llm import compression, conversation, decontamination, lattice, mixing, pii, quality_rules, secrets, simhash, toxicity, urls, variants, warc
from roadpulse.llm.common import stored
from roadpulse.llm.oracles import ORACLES
from roadpulse.plans.lineage import scratch_path
from roadpulse.session import ship

# Rules and hosts that the URL query states.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BLOCKED_HOSTS = ("spam-farm.example.com", "spam-farm.example.org", "cheap-pills.example.com", "cheap-pills.example.org")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def compression_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.components(_table(spark, sf_dir, "documents")))


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES, BLOCKED_HOSTS)


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents")))


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.records(warc.read_archive(spark, path))


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def lattice_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_copies(_table(spark, sf_dir, "embeddings"))


def conversation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation.damaged(_table(spark, sf_dir, "conversations"))
    planned = stored(conversation.plans(rows), "conversation-plans")
    return conversation.digest(planned, conversation.repair(rows, planned))


def variants_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(_table(spark, sf_dir, "documents"))


_ALL = {
    "op1_quality_rules": quality_rules_query,
    "op2_toxicity": toxicity_query,
    "op3_compression_quality": compression_query,
    "op4_simhash": simhash_query,
    "op5_mixing": mixing_query,
    "op6_url_filter": url_query,
    "op7_pii": pii_query,
    "op8_decontamination": decontamination_query,
    "op9_warc": warc_query,
    "op10_secrets": secrets_query,
    "op11_lattice_near_dedup": lattice_query,
    "op12_conversation_repair": conversation_query,
    "op13_spelling_variants": variants_query,
}


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipped(query) for name, query in _ALL.items()}
__all__ = ["ORACLES", "QUERIES"]
