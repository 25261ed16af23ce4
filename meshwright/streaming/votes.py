"""Events as votes; `ledger` keeps them as keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_votes(events: DataFrame, objects: int = 97) -> DataFrame:
    """Events as votes on `objects` objects: purchases and clicks up, errors down, others take back."""
    vote = F.when(F.col("event_type").isin("purchase", "click"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return events.select("user_id", (F.col("event_id") % objects).alias("object_id"), vote.alias("vote"), "ts", "event_id")
