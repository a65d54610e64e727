"""Running values over one global order, without a task that sees all rows.

The rows are range-partitioned and written once; each partition is a chunk of
the order. Running values are computed inside chunks and shifted by a table
with one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.plans.lineage import cut


class SortedScan:
    def __init__(self, df: DataFrame, order: list[str]):
        self.order = order
        ranged = df.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id())
        # Written because the chunk limits come from sampling and must not change.
        self.df = cut(ranged)

    def _shifted(self, chunk_value: Column, across: Column, name: str) -> DataFrame:
        edges = self.df.groupBy("_chunk").agg(chunk_value.alias("_v"))
        # One row per partition of the scan, kept so that later steps do not compute it again.
        return cut(edges.select("_chunk", across.alias(name)))

    def _earlier(self):
        return Window.partitionBy(F.lit(0)).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)

    def _later(self):
        return Window.partitionBy(F.lit(0)).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)

    def _inside(self):
        return Window.partitionBy("_chunk").orderBy(*self.order)

    def _with(self, edges: DataFrame, column: Column, name: str) -> SortedScan:
        joined = self.df.join(F.broadcast(edges), "_chunk", "left")
        following = object.__new__(SortedScan)
        following.order = self.order
        following.df = joined.withColumn(name, column).drop("_edge")
        return following

    def running_sum(self, value: str, name: str) -> SortedScan:
        """Sum of ``value`` up to and including each row."""
        edges = self._shifted(F.sum(value), F.sum("_v").over(self._earlier()), "_edge")
        inside = F.sum(value).over(self._inside().rowsBetween(Window.unboundedPreceding, 0))
        return self._with(edges, inside + F.coalesce("_edge", F.lit(0)), name)

    def running_max(self, value: str, name: str, until: int = 0) -> SortedScan:
        """Largest ``value`` seen up to each row; ``until=-1`` leaves the row out."""
        edges = self._shifted(F.max(value), F.max("_v").over(self._earlier()), "_edge")
        inside = F.max(value).over(self._inside().rowsBetween(Window.unboundedPreceding, until))
        return self._with(edges, F.greatest(inside, F.col("_edge")), name)

    def following_min(self, value: str, name: str) -> SortedScan:
        """Smallest ``value`` after each row."""
        edges = self._shifted(F.min(value), F.min("_v").over(self._later()), "_edge")
        # Read backwards: a frame that reaches to the end is recomputed for every row.
        backwards = Window.partitionBy("_chunk").orderBy(*[F.desc(c) for c in self.order])
        inside = F.min(value).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
        return self._with(edges, F.least(inside, F.col("_edge")), name)

    def define(self, name: str, column: Column) -> SortedScan:
        following = object.__new__(SortedScan)
        following.order = self.order
        following.df = self.df.withColumn(name, column)
        return following

    def result(self) -> DataFrame:
        return self.df.drop("_chunk")
