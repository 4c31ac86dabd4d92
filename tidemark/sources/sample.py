"""A small scenario: six users, in order of arrival, with late and missing clicks."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from ..schema import CLICKS_TOPIC, ENVELOPE, VIEWS_TOPIC

BASE = datetime(2024, 1, 1, 12)

#: Kind, id, user, event minute after noon, campaign or page.
EVENTS = (
    ("click", "click_1", "user_1", 5, "campaign_A"),
    ("view", "pv_1", "user_1", 10, "/product1"),
    ("view", "pv_2", "user_2", 15, "/product2"),
    ("click", "click_2", "user_2", 12, "campaign_B"),
    ("click", "click_3a", "user_3", 20, "campaign_C"),
    ("click", "click_3b", "user_3", 25, "campaign_D"),
    ("view", "pv_3", "user_3", 30, "/product3"),
    ("click", "click_4", "user_4", 35, "campaign_E"),
    ("view", "pv_5", "user_5", 45, "/product5"),
    ("click", "click_5", "user_5", 40, "campaign_F"),
    ("view", "pv_4", "user_4", 70, "/product4"),
    ("view", "pv_6", "user_6", 80, "/product6"),
)

#: Log partition of each user among three.
USER_PARTITION = {"user_1": 0, "user_2": 1, "user_3": 0, "user_4": 2, "user_5": 1, "user_6": 2}


def envelope_rows(partitions: int = 3) -> list[tuple]:
    """Rows of the envelope schema, with 1 or 3 partitions."""
    rows, offsets = [], {}
    for seq, (kind, id_, user, minute, detail) in enumerate(EVENTS):
        topic = CLICKS_TOPIC if kind == "click" else VIEWS_TOPIC
        p = USER_PARTITION[user] if partitions == 3 else 0
        offset = offsets[topic, p] = offsets.get((topic, p), -1) + 1
        time = (BASE + timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%S")
        own = {"campaign_id": detail, "click_id": id_} if kind == "click" else {"url": f"https://example.com{detail}", "event_id": id_}
        rows.append((topic, p, offset, user, json.dumps({"user_id": user, "event_time": time, **own}), seq))
    return rows


def envelopes(spark: SparkSession, partitions: int = 3) -> DataFrame:
    return spark.createDataFrame(envelope_rows(partitions), ENVELOPE)
