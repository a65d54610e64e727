"""Partitioned tables written by a run."""

from __future__ import annotations

from pyspark.sql import DataFrame

from roadpulse.plans.lineage import shuffles_dropped


def write_slices(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Road or turning rows, one folder per date and slice.

    Rebalancing brings a slice to few tasks and splits one that is too large;
    rows are sorted by road so that a lookup by road skips row groups.
    """
    with shuffles_dropped(rows.sparkSession):
        (
            rows.hint("rebalance", "date", "seq")
            .sortWithinPartitions("date", "seq", "gid")
            .write.mode(mode).option("compression", "zstd").partitionBy("date", "seq").parquet(path)
        )


def write_history(history: DataFrame, path: str) -> None:
    """Replaces the slices present in ``history`` and leaves the others."""
    with shuffles_dropped(history.sparkSession):
        (
            history.hint("rebalance", "seq")
            .sortWithinPartitions("seq", "gid")
            .write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("seq").parquet(path)
        )
