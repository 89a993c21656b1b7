"""Running states over ordered events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_state(events: DataFrame, key: str, order: list[str], delta: str) -> DataFrame:
    """events plus state, the sum of delta up to each event of its key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("state", F.sum(delta).over(w))
