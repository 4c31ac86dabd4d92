import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from simulator import simulate

from tidemark.operators import attribution, scan, watermark

BASE = datetime(2026, 8, 24, 12)
SCHEMA = "kind string, id long, user_id long, ts timestamp_ntz, campaign_id string, url string, p long, arrival timestamp_ntz"


def row(kind, id_, user, minutes, arrival, p=0):
    ts = BASE + timedelta(minutes=minutes)
    return (kind, id_, user, ts, f"c{id_}" if kind == "click" else None, f"/{id_}" if kind == "view" else None, p, BASE + timedelta(seconds=arrival))


def winners(df):
    return {r["id"]: r["click_id"] for r in df.select("id", F.col("click.click_id").alias("click_id")).collect()}


CASES = [
    ("at the view's time", [("click", 1, 0)], 1),
    ("at the window's start", [("click", 1, -30)], 1),
    ("before the window", [("click", 1, -31)], None),
    ("a later click is skipped", [("click", 1, 1), ("click", 2, -10), ("click", 3, -1)], 3),
    ("equal times: the greater id", [("click", 1, -1), ("click", 2, -1)], 2),
    ("no click", [], None),
]


@pytest.mark.parametrize("name,clicks,expected", CASES, ids=[c[0] for c in CASES])
def test_window_bounds(spark, name, clicks, expected):
    rows = [row(k, i, 7, m, i) for k, i, m in clicks] + [row("view", 99, 7, 0, 50), row("click", 50, 8, 0, 51)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert winners(attribution.attribute(df, 30)) == {99: expected}
    joined = attribution.attribute_by_join(df.where("kind = 'view'"), df.where("kind = 'click'"), 30)
    assert winners(joined) == {99: expected}


@pytest.fixture(params=[1_000_000, 37], ids=["one chunk", "chunks"])
def chunk_rows(request, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK_ROWS", request.param)


def random_events(seed, n=400, disorder=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        minute = rng.randrange(0, 240, 5)  # many ties
        rows.append(row(rng.choice(["view", "click"]), i, rng.randrange(6), minute, minute * 60 + rng.randrange(disorder), p=i % 3))
    # a user belongs to one partition
    return [(*r[:6], r[2] % 3, r[7]) for r in rows]


@pytest.mark.parametrize("lateness", [0, 1, 2, 3, 15])
def test_watermarked_equals_sequential_model(spark, chunk_rows, lateness):
    rows = random_events(lateness)
    df = spark.createDataFrame(rows, SCHEMA)
    events = [dict(kind=r[0], id=r[1], user_id=r[2], ts=r[3], p=r[6]) for r in sorted(rows, key=lambda r: (r[7], r[1]))]
    expected, late = simulate(events, timedelta(minutes=lateness), timedelta(minutes=30))
    assert winners(attribution.attribute_watermarked(df, lateness, 30)) == expected
    found = watermark.with_watermarks(df, lateness).where(watermark.is_late())
    assert sorted(r["id"] for r in found.collect()) == sorted(late)


def test_click_after_emission_is_not_used(spark):
    # the view at minute 0 is final at once; a click of the same time that arrives later is accepted, but too late
    df = spark.createDataFrame([row("view", 1, 7, 0, 1), row("click", 2, 7, 0, 2)], SCHEMA)
    assert winners(attribution.attribute_watermarked(df, 0, 30)) == {1: None}


def test_first_event_and_event_at_watermark_are_on_time(spark):
    df = spark.createDataFrame([row("view", 1, 7, 10, 1), row("click", 2, 7, 8, 2), row("click", 3, 7, 7, 3)], SCHEMA)
    late = watermark.with_watermarks(df, 2).where(watermark.is_late())
    assert [r["id"] for r in late.collect()] == [3]


def test_pending_views(spark):
    df = spark.createDataFrame([row("view", 1, 7, 0, 1), row("view", 2, 7, 2, 2), row("view", 3, 7, 3, 3)], SCHEMA)
    assert sorted(r["id"] for r in attribution.pending_views(df, 1).collect()) == [3]
    assert set(winners(attribution.attribute_watermarked(df, 1, 30))) == {1, 2}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert attribution.attribute(df, 30).count() == 0
    assert attribution.attribute_watermarked(df, 2, 30).count() == 0


def test_one_shuffle(spark):
    df = spark.createDataFrame([row("view", 1, 7, 0, 1)], SCHEMA)
    plan = attribution.attribute(df, 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
