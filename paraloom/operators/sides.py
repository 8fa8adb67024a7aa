"""Join sides that are small by their nature, checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a definition table that go to every executor at most.
SMALL_ROWS = 100_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df marked for broadcast if it has so few rows, else as it is; for definition tables and other sides that are cheap to count."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
