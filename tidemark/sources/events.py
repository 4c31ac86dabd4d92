"""The ``events`` table as a stream of page views and ad clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Log partitions that the table is dealt over.
PARTITIONS = 3


def load(spark: SparkSession, sf_dir: str, disorder: int = 97, truncate: str | None = None) -> DataFrame:
    """``kind, id, user_id, ts, campaign_id, url, p, offset_no, arrival``.

    ``disorder`` spreads arrivals over so many minutes after the event;
    ``truncate`` coarsens times ('hour') to make ties.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type IN ('view', 'click')")
    ts = F.col("ts") if truncate is None else F.date_trunc(truncate, "ts").cast("timestamp_ntz")
    rows = events.select(
        F.when(F.col("event_type") == "view", "view").otherwise(F.lit("click")).alias("kind"),
        F.col("event_id").alias("id"),
        "user_id",
        ts.alias("ts"),
        F.col("ts").alias("sent"),
        F.concat(F.lit("campaign_"), F.get_json_object("props", "$.k")).alias("campaign_id"),
        F.concat(F.lit("https://example.com/p/"), (F.col("event_id") % 50).cast("string")).alias("url"),
        (F.col("user_id") % PARTITIONS).alias("p"),
        F.col("event_id").alias("offset_no"),
    )
    delay = F.make_dt_interval(F.lit(0), F.lit(0), F.pmod(F.col("id") * 7919, F.lit(disorder)).cast("int"))
    return rows.withColumn("arrival", F.col("sent") + delay).drop("sent")


def with_resent(rows: DataFrame) -> DataFrame:
    """Adds events sent again a day later: every tenth unchanged at a new
    offset, every 17th with other content, every 13th at its old offset."""
    day = F.expr("INTERVAL '1' DAY")
    again = rows.where("id % 10 = 0").withColumns({"offset_no": F.col("offset_no") + 10_000_000, "arrival": F.col("arrival") + day})
    changed = rows.where("id % 17 = 0").withColumns(
        {
            "offset_no": F.col("offset_no") + 20_000_000,
            "arrival": F.col("arrival") + day,
            "campaign_id": F.concat("campaign_id", F.lit("_x")),
            "url": F.concat("url", F.lit("/x")),
        }
    )
    replayed = rows.where("id % 13 = 0").withColumn("arrival", F.col("arrival") + day)
    return rows.unionByName(again).unionByName(changed).unionByName(replayed)
