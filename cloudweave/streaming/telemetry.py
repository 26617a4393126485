"""Metrics that come with the query that makes them: observed on a stream or a selection, heard by a listener."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

LOG = logging.getLogger("cloudweave")
POOL = "cloudweave_pool"


class Selection:
    """A selection of points whose survivors are counted by the query that draws it, not by one of its own."""

    def __init__(self, selected: DataFrame, capacity: int) -> None:
        self.capacity, self._seen = capacity, Observation()
        self.points = selected.observe(self._seen, F.count(F.lit(1)).alias("appended"))

    @property
    def stats(self) -> dict[str, int]:
        """appended, overflow beyond the capacity, kept; waits for the first query over `points`."""
        n = self._seen.get["appended"]
        return {"appended": n, "overflow": max(n - self.capacity, 0), "kept": min(n, self.capacity)}


def observed(told: DataFrame) -> DataFrame:
    """A stream of telemetry whose batches tell their sums to a PoolListener."""
    blocked = F.col("blocked_on_full_pool").cast("int") if "blocked_on_full_pool" in told.columns else F.lit(0)
    return told.observe(
        POOL, F.count(F.lit(1)).alias("ticks"), F.sum(blocked).alias("blocked"), F.max("starved_ticks").alias("starved_ticks"),
        F.sum("pending_chunks").alias("pending_chunks"), F.sum("resident_points").alias("resident_points"), F.count("last_error").alias("errors"), F.max("last_error").alias("last_error"),
    )


class PoolListener(StreamingQueryListener):
    """Keeps what each query's last batch told, and the sums over its batches; errors are logged once each.

    spark.streams.addListener(listener); listener.latest[query name].
    """

    def __init__(self) -> None:
        self.latest: dict[str, dict] = {}
        self.ticks: dict[str, int] = {}
        self.errors: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(POOL)
        if row is None or not row["ticks"]:
            return
        name = event.progress.name or str(event.progress.id)
        self.latest[name] = row.asDict() | {"batch": event.progress.batchId}
        self.ticks[name] = self.ticks.get(name, 0) + row["ticks"]
        if row["last_error"] and row["last_error"] not in self.errors:
            self.errors.add(row["last_error"])
            LOG.warning("%s: %s", name, row["last_error"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
