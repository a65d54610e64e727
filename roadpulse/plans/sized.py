"""Broadcasting behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 2_000_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table of narrow rows has at most ``rows`` of them."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks ``df`` for broadcast when it fits; otherwise the join shuffles."""
    return F.broadcast(df) if fits(df, rows) else df
