"""Trajectory pairs: consecutive matched points of a vehicle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.params import TrafficParams
from roadpulse.plans.ordered import day_chunk, with_previous


def pair_up(matched: DataFrame, columns: list[str], key: str = "suid") -> DataFrame:
    """Adds the previous point of the vehicle as ``pre_*``; drops first points."""
    looked = with_previous(matched, [key], day_chunk(), ["utc"], ["utc", *columns])
    return looked.filter(F.col("pre_utc").isNotNull())


def cut_long_gaps(paired: DataFrame, p: TrafficParams = TrafficParams()) -> DataFrame:
    return paired.filter(F.col("utc") - F.col("pre_utc") <= p.max_gap)


def cut_status_changes(paired: DataFrame) -> DataFrame:
    return paired.filter(F.col("passenger") == F.col("pre_passenger"))


def usable_pairs(paired: DataFrame, p: TrafficParams = TrafficParams()) -> DataFrame:
    return cut_status_changes(cut_long_gaps(paired, p))


def road_use(pairs: DataFrame, batch: Column) -> DataFrame:
    """How often each road occurs in the routes of a batch."""
    return (
        pairs.select(batch.alias("batch"), F.explode("route").alias("road"))
        .groupBy("batch", "road")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def flag_pairs(pairs: DataFrame, batch: Column) -> DataFrame:
    """``flag`` 1 when every road of the route occurs once in its batch."""
    # A batch lasts seconds, so a road occurs few times in one. Only shared roads, and the pairs on them, go on.
    use = Window.partitionBy("batch", "road")
    roads = pairs.select("suid", "utc", batch.alias("batch"), F.explode("route").alias("road"))
    shared = roads.withColumn("n", F.count(F.lit(1)).over(use)).filter(F.col("n") > 1).select("suid", "utc").distinct()
    flag = F.when(F.col("_shared"), 0).otherwise(1).alias("flag")
    return pairs.filter(F.size("route") > 0).join(shared.withColumn("_shared", F.lit(True)), ["suid", "utc"], "left").select(*pairs.columns, flag)


def attach_samples(converged: DataFrame, samples: DataFrame) -> DataFrame:
    """Metadata of the sample each converged candidate belongs to."""
    return converged.join(samples, ["suid", "sample_id"])
