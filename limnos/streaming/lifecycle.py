"""Requests as a stream of status events: counts in windows, and the steps that the status machine forbids."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.catalog import EDGES

VIOLATION = "request long, event_id long, before string, after string"


def counts(events: DataFrame, late: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """Events by window and status; a window is put out once it is closed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("since"), "status", "n")


def violations(events: DataFrame) -> DataFrame:
    """The forbidden steps of each request; the state is its last status, kept from batch to batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        rows = []
        for batch in batches:
            for event in batch.sort_values(["ts", "event_id"]).itertuples():
                if before is not None and before != event.status and (before, event.status) not in EDGES:
                    rows.append((key[0], event.event_id, before, event.status))
                before = event.status
        state.update((before,))
        yield pd.DataFrame(rows, columns=["request", "event_id", "before", "after"])

    return events.groupBy("request").applyInPandasWithState(step, VIOLATION, "status string", "append", GroupStateTimeout.NoTimeout)
