"""Near copies by SimHash, and an exact check by shingles of what its few bits cannot tell (the pipeline's stage).

Both rules link; documents that either brings together, directly or through others, are one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm import shingles, simhash
from roadpulse.llm.common import stored


def fingerprint(text: str | Column) -> Column:
    """One long for both rules' digests of a text."""
    return F.xxhash64(simhash.fingerprint(text), shingles.fingerprint(text))


def _between_texts(links: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """``a, b`` among the ``fp`` of ``texts``: ``links(a, b)`` of ``key``, and what ties all texts of one ``key`` to the first of them."""
    first = stored(texts.groupBy(key).agg(F.min("fp").alias("_first"), F.max("fp").alias("_last")), "first-texts")
    ties = texts.join(first.where("_first <> _last"), key).where("fp <> _first").select(F.col("fp").alias("a"), F.col("_first").alias("b"))
    end = lambda name: first.select(F.col(key).alias(name), F.col("_first").alias(f"_{name}"))
    moved = links.join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return ties.union(moved)


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, fp, group, component_id`` as ``simhash.components`` gives them, linked by bits or by shingles.

    A text is read once for both digests. The links of both rules become links between texts, so what hangs together is
    sought once.
    """
    both = docs.select(F.col(doc_id).alias("doc_id"), simhash.fingerprint(text).alias("_bits"), shingles.sketch(F.col(text)).alias("_s"))
    marked = stored(both.select("doc_id", F.xxhash64("_bits", "_s.fp").alias("fp"), "_bits", F.col("_s.fp").alias("_set"), "_s.n", "_s.bands"), "both-fingerprints")
    texts = stored(marked.groupBy("fp", "_bits", "_set").agg(F.min("doc_id").alias("_least")), "distinct-texts")
    sets = stored(marked.groupBy(F.col("_set").alias("fp")).agg(F.min("doc_id").alias("_least"), F.first("n").alias("n"), F.first("bands").alias("bands")), "distinct-sketches")
    by_bits = stored(simhash.links(stored(texts.select(F.col("_bits").alias("fp")).distinct(), "distinct-fingerprints")).distinct(), "fingerprint-links")
    by_shingles = stored(shingles.links(docs, sets, text, doc_id), "shingle-links")
    edges = stored(_between_texts(by_bits, texts, "_bits").union(_between_texts(by_shingles, texts, "_set")).distinct(), "text-links")
    return simhash.labelled(marked.select("doc_id", "fp"), texts.select("fp", "_least"), edges)
