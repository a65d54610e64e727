"""Mixing sources to target weights by random keys, prefix sums and exact cuts (operator 5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Rows of one range of a source's random order; a source has as many ranges as it needs.
RANGE_ROWS = 5_000


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``target`` words of each row of ``sources(source, source_size)``.

    Sources in code-point order, null last, get the weights in turn and share all words by weight. None gets over ``most``
    times its size; what it cannot take is shared again by weight. Ordered by size over weight, the sources at their limit
    come first, so running sums find the common level of the others without rounds. There is one narrow row a source.
    """
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")) - 1
    weighed = sources.select("*", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).alias("_w"))
    limit = F.col("source_size") * most
    every = Window.partitionBy(F.lit(0))
    rising = every.orderBy(limit / F.col("_w"), F.col("source").isNull(), "source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    left_words = F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    left_weight = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    levels = weighed.select("*", (left_words / left_weight).alias("_level"))
    # The first source below its limit sets the level for itself and all after it; levels fall from there on.
    level = F.max(F.when(F.col("_level") * F.col("_w") <= limit, F.col("_level"))).over(every)
    target = F.least(limit.cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("_w"))
    return levels.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
        weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 5) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every document.

    A source takes all its documents as often as its target holds them whole, then documents in random order up to the
    exact word; the last one is cut. The order is a hash of id and text with ``seed``, so reruns agree. Its top bits deal a
    source into ranges of about RANGE_ROWS rows: sums of the ranges and sums inside them give the prefix sum, so a source
    with a third of all rows is spread over its ranges. Only ids and numbers are shuffled.

    Null or empty texts have size 0 and take nothing. Null sources are one source. Repeated rows count each time; rows with
    the same id and text are interchangeable. An empty table gives an empty result; other columns are ignored.
    """
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), 1)
    sized = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"), key.alias("_key")), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    goals = targets(sources, weights, most).withColumnRenamed("source", "_source")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    plan = stored(
        sources.drop("source_size").join(goals, F.col("source").eqNullSafe(F.col("_source"))).select(
            "source", "source_size", "target", epochs.alias("_epochs"), (budget - epochs * F.col("source_size")).alias("_rest"),
            F.ceil(F.col("_rows") / RANGE_ROWS).cast("int").alias("_ranges")), "mix-plan")
    known = sized.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranged = known.withColumn("_range", F.least(F.floor(F.col("_key") / F.lit(2.0**63) * F.col("_ranges")), F.col("_ranges") - 1).cast("int"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    edges = ranged.groupBy("source", "_range").agg(F.sum("size").alias("_sum")).select(
        F.col("source").alias("_source"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_edge"))
    placed = ranged.join(edges, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")))
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_edge") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - before))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + part).cast("long").alias("taken"))
