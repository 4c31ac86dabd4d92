"""Event-time watermarks of log partitions, lateness and finality.

Rows have ``p`` (partition), ``ts`` and the order columns ``arrival, id``.  The
watermark of a partition is the latest accepted event time less the allowed
lateness; it moves with every accepted event and never back.  Late events
can't move it, so a running maximum over all non-conflicting rows is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import epoch_ms, from_epoch_ms, minutes
from .scan import with_running_max

ORDER = ("arrival", "id")


def with_watermarks(rows: DataFrame, lateness: int, moves: Column | None = None, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds ``wm_before`` and ``wm_after`` of each row's arrival; ``wm_before``
    is null before the first event of a partition.  Rows for which ``moves`` is
    false don't move the watermark."""
    time = F.col("ts") if moves is None else F.when(moves, F.col("ts"))
    seen = with_running_max(rows, "_max", time, ["p"], order)
    late = minutes(lateness)
    return seen.withColumn("wm_before", F.col("_max") - late).withColumn("wm_after", F.greatest(F.col("_max"), time) - late).drop("_max")


def is_late() -> Column:
    """Strictly below the watermark; an event at it is accepted."""
    return F.coalesce(F.col("ts") < F.col("wm_before"), F.lit(False))


def accepted(rows: DataFrame, lateness: int) -> DataFrame:
    return with_watermarks(rows, lateness).where(~is_late())


def final_watermarks(rows: DataFrame) -> DataFrame:
    """``p, max_event_time`` of each partition."""
    return rows.groupBy("p").agg(F.max("ts").alias("max_event_time"))


def stored_watermarks(state: DataFrame) -> DataFrame:
    """``partition_no, max_event_time, max_event_time_epoch_ms`` of ``p, max_event_time``."""
    return state.select(F.col("p").alias("partition_no"), "max_event_time", epoch_ms("max_event_time").alias("max_event_time_epoch_ms"))


def restored_watermarks(stored: DataFrame) -> DataFrame:
    """The state of a restart, from the stored numbers."""
    return stored.select(F.col("partition_no").alias("p"), from_epoch_ms("max_event_time_epoch_ms").alias("max_event_time"))


def upsert_watermarks(state: DataFrame, observed: DataFrame) -> DataFrame:
    """Monotone upsert: both have ``p, max_event_time``."""
    return state.select("p", "max_event_time").unionByName(observed.select("p", "max_event_time")).groupBy("p").agg(F.max("max_event_time").alias("max_event_time"))


def global_minimum(watermarks: DataFrame) -> DataFrame:
    """The least of the partitions' latest event times: one row."""
    return watermarks.agg(F.min("max_event_time").alias("min_event_time"))


def eviction_cutoff(minimum: Column, lateness: int, window: int) -> Column:
    """Clicks strictly before it can't be attributed any more."""
    return minimum - minutes(lateness) - minutes(window)
