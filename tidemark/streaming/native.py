"""Attribution by Spark's own stream-stream join.

Differences from the exact mode, by design of the engine: one watermark for
both inputs in place of one for each log partition; it moves once per
micro-batch; late rows are counted by the engine but not listed; an event
exactly at the watermark may count as late.  On input in order both agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Settings


def attribute_stream(events: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Output rows, appended once final.  ``events`` is a stream of ``kind, id,
    user_id, ts (timestamp), campaign_id, url``.  Rows leave the join's state
    by the time range in its condition."""
    s = settings or Settings()
    late, window = f"{s.allowed_lateness_minutes} minutes", s.attribution_window_minutes
    views = events.where("kind = 'view'").select(F.col("id").alias("page_view_id"), "user_id", F.col("ts").alias("event_time"), "url").withWatermark("event_time", late)
    clicks = events.where("kind = 'click'").select(F.col("user_id").alias("click_user"), F.col("ts").alias("click_time"), F.col("id").alias("click_id"), "campaign_id").withWatermark("click_time", late)
    near = F.expr(f"user_id = click_user AND click_time <= event_time AND click_time >= event_time - INTERVAL {window} MINUTES")
    joined = views.join(clicks, near, "leftOuter")
    best = F.max(F.when(F.col("click_id").isNotNull(), F.struct("click_time", "click_id", "campaign_id"))).alias("click")
    final = joined.groupBy("event_time", "page_view_id", "user_id", "url").agg(best)
    return final.select("page_view_id", "user_id", "event_time", "url", F.col("click.campaign_id").alias("attributed_campaign_id"), F.col("click.click_id").alias("attributed_click_id"))
