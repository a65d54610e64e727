"""Looking back in time order without sending a whole key to one task.

Rows of a key are split into chunks along the order; a window runs inside one
chunk, and a small table with one row per chunk carries values over its edge.
A hot key is therefore spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.params import DAY_SECONDS


def day_chunk(utc: str = "utc") -> Column:
    return F.floor(F.col(utc) / DAY_SECONDS)


def with_previous(df: DataFrame, keys: list[str], chunk: Column, order: list[str], columns: list[str], prefix: str = "pre_") -> DataFrame:
    """Adds ``columns`` of the previous row of the key; NULL on the first row.

    ``chunk`` has to grow with ``order``, whose values are unique within a key.
    """
    marked = df.withColumn("_chunk", chunk)
    carried = F.struct(*columns)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    edges = (
        marked.groupBy(*keys, "_chunk")
        .agg(F.max_by(carried, F.struct(*order)).alias("_last"))
        .select(*keys, "_chunk", F.lag("_last").over(across).alias("_edge"))
        .filter(F.col("_edge").isNotNull())
    )
    looked = marked.withColumn("_inner", F.lag(carried).over(inside))
    joined = looked.join(edges, [*keys, "_chunk"], "left")
    previous = F.coalesce("_inner", "_edge")
    return joined.select(*df.columns, *[previous[c].alias(f"{prefix}{c}") for c in columns])


def with_running_max(df: DataFrame, keys: list[str], chunk: Column, order: list[str], column: str, name: str) -> DataFrame:
    """Adds the maximum of ``column`` over earlier rows of the key."""
    marked = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        marked.groupBy(*keys, "_chunk")
        .agg(F.max(column).alias("_top"))
        .select(*keys, "_chunk", F.max("_top").over(across).alias("_edge"))
        .filter(F.col("_edge").isNotNull())
    )
    looked = marked.withColumn("_inner", F.max(column).over(inside))
    return looked.join(edges, [*keys, "_chunk"], "left").select(
        *df.columns, "_chunk", F.greatest("_inner", "_edge").alias(name)
    )
