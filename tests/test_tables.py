import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup, ingest, ledger, maintenance, scan, tables, watermark
from tidemark.schema import ENVELOPE, Settings
from tidemark.functions.columns import click_archive_minutes

T = datetime(2026, 8, 24, 12)


@pytest.mark.parametrize("bad", [-1, 16, 2.5, True, None])
def test_lateness_is_checked(bad):
    with pytest.raises(ValueError):
        Settings(allowed_lateness_minutes=bad)


@pytest.mark.parametrize("good", [0, 15])
def test_lateness_bounds(good):
    assert Settings(allowed_lateness_minutes=good).allowed_lateness_minutes == good


CLICK = '{"user_id":"u","event_time":"2024-01-01T12:10:00Z","campaign_id":"a","click_id":"c"}'
VIEW = '{"user_id":"u","event_time":"2024-01-01T12:10:00","url":"/","event_id":"v"}'
RECORDS = [
    ("ad_clicks", CLICK, None),
    ("page_views", VIEW, None),
    ("ad_clicks", CLICK.replace("00Z", "00+02:00"), None),
    ("ad_clicks", " ", "blank record"),
    ("page_views", None, "blank record"),
    ("ad_clicks", "{", "not a JSON object"),
    ("ad_clicks", "null", "not a JSON object"),
    ("ad_clicks", "[1]", "not a JSON object"),
    ("ad_clicks", CLICK.replace("00Z", "00.123Z"), "event_time is not a time"),
    ("ad_clicks", CLICK.replace('"c"', '" "'), "click_id is missing"),
    ("ad_clicks", CLICK.replace('"campaign_id"', '"x"'), "campaign_id is missing"),
    ("page_views", VIEW.replace('"v"', "null"), "event_id is missing"),
    ("page_views", VIEW.replace('"url"', '"x"'), "url is missing"),
    ("page_views", VIEW.replace('"event_time"', '"x"'), "event_time is missing"),
]


def records(spark, values):
    return spark.createDataFrame([(t, 0, i, None, v, i) for i, (t, v) in enumerate(values)], ENVELOPE)


def test_validation(spark):
    found = ingest.parse(records(spark, [r[:2] for r in RECORDS])).orderBy("offset").collect()
    assert [r["reason"] for r in found] == [r[2] for r in RECORDS]
    assert found[0]["event_time"] == datetime(2024, 1, 1, 12, 10) and found[2]["event_time"] == datetime(2024, 1, 1, 10, 10)
    assert found[4]["event_key"] is None and found[13]["event_key"] == "v"
    letters = ingest.invalid_dead_letters(ingest.parse(records(spark, [r[:2] for r in RECORDS]))).collect()
    assert len(letters) == 11 and {r["error_type"] for r in letters} == {"INVALID_KAFKA_RECORD"}


def test_records_of_other_topics_are_ignored(spark):
    assert ingest.parse(records(spark, [(None, None), ("other", CLICK)])).count() == 0


def test_strict_fields(spark):
    extra = CLICK.replace("{", '{"more":1,')
    assert ingest.parse(records(spark, [("ad_clicks", extra)])).first()["reason"] is None
    assert ingest.parse(records(spark, [("ad_clicks", extra)]), strict_fields=True).first()["reason"] == "unknown field"
    tolerated = CLICK.replace("{", '{"partition":1,"offset":2,')
    assert ingest.parse(records(spark, [("ad_clicks", tolerated)]), strict_fields=True).first()["reason"] is None


LOG = "kind string, id string, user_id string, ts timestamp_ntz, campaign_id string, url string, p long, offset_no long, arrival long"


def click(id_, offset, arrival, campaign="a", minutes=0, p=0):
    return ("click", id_, "u", T + timedelta(minutes=minutes), campaign, None, p, offset, arrival)


def test_classification(spark):
    df = spark.createDataFrame([click("c", 1, 1), click("c", 1, 2), click("c", 2, 3), click("c", 3, 4, "b"), click("d", 4, 5)], LOG)
    found = {r["arrival"]: r["status"] for r in dedup.classify(df, dedup.CLICK_CONTENT).collect()}
    assert found == {1: "INSERTED", 2: "REPLAY", 3: "DUPLICATE", 4: "CONFLICT", 5: "INSERTED"}


def verdicts(spark, rows, lateness=2, **more):
    df = spark.createDataFrame(rows, LOG).withColumn("payload", F.lit("sent"))
    found = ledger.input_ledger(df, lateness, **more)
    return {r["offset_no"]: (r["status"], r["processing_status"]) for r in found.collect()}, found


@pytest.fixture(params=[1_000_000, 2], ids=["one chunk", "chunks"])
def chunk_rows(request, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK_ROWS", request.param)


def test_ledger_dedup_precedes_lateness(spark, chunk_rows):
    rows = [click("c", 1, 1), click("x", 2, 2, minutes=60), click("c", 3, 3), click("y", 4, 4, minutes=1), click("c", 5, 5, "b")]
    found, book = verdicts(spark, rows)
    assert found == {1: ("INSERTED", "PROCESSED"), 2: ("INSERTED", "PROCESSED"), 3: ("DUPLICATE", "PROCESSED"), 4: ("INSERTED", "DROPPED_LATE"), 5: ("CONFLICT", "DEAD_LETTER")}
    letter = ledger.conflict_letters(book).first()
    assert (letter["event_key"], letter["payload"], letter["error_type"], letter["event_type"], letter["attempt_count"]) == ("c", "sent", "CLICK_ID_CONFLICT", "ad_clicks", 1)


def test_a_late_click_is_not_stored(spark, chunk_rows):
    rows = [click("x", 1, 1, minutes=60), click("c", 2, 2, minutes=1), click("c", 3, 3, "b", minutes=61), click("c", 4, 4, "b", minutes=61), click("c", 5, 5, minutes=1)]
    found, _ = verdicts(spark, rows)
    assert found == {1: ("INSERTED", "PROCESSED"), 2: ("INSERTED", "DROPPED_LATE"), 3: ("INSERTED", "PROCESSED"), 4: ("DUPLICATE", "PROCESSED"), 5: ("CONFLICT", "DEAD_LETTER")}


def test_conflicts_do_not_move_watermarks(spark, chunk_rows):
    # the conflict at offset 2 is far ahead; what comes after it is on time
    rows = [click("c", 1, 1), click("c", 2, 2, "b", minutes=300), click("d", 3, 3, minutes=1)]
    found, _ = verdicts(spark, rows)
    assert found[2] == ("CONFLICT", "DEAD_LETTER") and found[3] == ("INSERTED", "PROCESSED")


def test_views_of_an_id(spark):
    def view(id_, offset, minutes, url="/"):
        return ("view", id_, "u", T + timedelta(minutes=minutes), None, url, 0, offset, offset)

    rows = [view("v", 1, 0), view("v", 2, 30, "/other"), view("v", 3, 0), view("w", 4, 29)]
    found, _ = verdicts(spark, rows)
    assert found == {1: ("INSERTED", "PROCESSED"), 2: ("DUPLICATE", "PROCESSED"), 3: ("DUPLICATE", "DROPPED_LATE"), 4: ("INSERTED", "PROCESSED")}
    strict, _ = verdicts(spark, rows, view_conflicts=True)
    assert strict == {1: ("INSERTED", "PROCESSED"), 2: ("CONFLICT", "DEAD_LETTER"), 3: ("DUPLICATE", "PROCESSED"), 4: ("INSERTED", "PROCESSED")}


def sequential(rows, lateness):
    """Verdicts one event after another."""
    latest, clicks, views, out = {}, {}, {}, {}
    for kind, id_, user, ts, campaign, url, p, offset, arrival in sorted(rows, key=lambda r: (r[8], r[7])):
        late = p in latest and ts < latest[p] - timedelta(minutes=lateness)
        known = (clicks if kind == "click" else views).get(id_)
        content = (user, ts, campaign or url)
        status = "INSERTED"
        if known:
            status = "CONFLICT" if kind == "click" and known[0] != content else "REPLAY" if known == (content, p, offset) else "DUPLICATE"
        if kind == "click" and known:
            out[offset] = (status, "DEAD_LETTER" if status == "CONFLICT" else "PROCESSED")
            continue
        out[offset] = (status, "DROPPED_LATE" if late else "PROCESSED")
        if not late:
            latest[p] = max(latest.get(p, ts), ts)
            (clicks if kind == "click" else views).setdefault(id_, (content, p, offset))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ledger_equals_sequential_model(spark, seed):
    rng = random.Random(seed)
    rows = []
    for n in range(160):
        kind, id_ = rng.choice(["click", "click", "view"]), f"i{rng.randrange(40)}"
        detail = rng.choice("ab")
        rows.append((kind, id_, "u", T + timedelta(minutes=n // 3 + rng.choice([0, 0, -9, 25])), detail if kind == "click" else None, detail if kind == "view" else None, rng.randrange(2), n, n))
    found, _ = verdicts(spark, rows, 4)
    assert found == sequential(rows, 4)


def test_classification_against_stored_clicks(spark):
    rows = spark.createDataFrame([click("c", 1, 1), click("c", 9, 2), click("d", 3, 3, "b"), click("e", 4, 4), click("e", 5, 5)], LOG)
    stored = spark.createDataFrame([("c", 0, 1, "u", T, "a"), ("d", 0, 7, "u", T, "a")], "id string, p long, offset_no long, user_id string, ts timestamp_ntz, campaign_id string")
    found = {r["offset_no"]: r["status"] for r in dedup.classify(rows, dedup.CLICK_CONTENT, stored=stored).collect()}
    assert found == {1: "REPLAY", 9: "DUPLICATE", 3: "CONFLICT", 4: "INSERTED", 5: "DUPLICATE"}


OUT = "page_view_id string, user_id string, event_time timestamp_ntz, url string, attributed_campaign_id string, attributed_click_id string"


def test_output_sink(spark):
    stored = spark.createDataFrame([("1", "u", T, "/", "a", "c"), ("2", "u", T, "/", None, None)], OUT)
    new = spark.createDataFrame([("1", "u", T, "/", "a", "c"), ("2", "u", T, "/", "a", "c"), ("3", "u", T, "/", None, None), ("4", "u", T, "/", "a", None), ("5", " ", T, "/", None, None), ("6", "u", None, "/", None, None)], OUT)
    append, refused = tables.write_output(new, stored)
    assert [r["page_view_id"] for r in append.collect()] == ["3"]
    assert {r["page_view_id"]: r["problem"] for r in refused.collect()} == {"2": "page_view_id is stored with other content", "4": "attribution is incomplete", "5": "user_id is missing", "6": "event_time is missing"}


def test_of_rows_of_one_key_the_first_is_written(spark):
    stored = spark.createDataFrame([], OUT)
    rows = [("1", "u", T, url, None, None, n) for n, url in enumerate(["/b", "/a", "/b"])]
    for step in (1, -1):
        new = spark.createDataFrame(rows[::step], OUT + ", n int")
        append, refused = tables.write_output(new, stored, ["n"])
        assert [r["url"] for r in append.collect()] == ["/b"] and [r["url"] for r in refused.collect()] == ["/a"]
        letter = ledger.exhausted_letters(refused).first()
        assert (letter["error_type"], letter["attempt_count"], letter["error_message"]) == ("PROCESSING_RETRY_EXHAUSTED", 4, "page_view_id is stored with other content")


def test_archived_counts(spark):
    rows = [("ad_clicks", 0, i, T - timedelta(hours=i), None) for i in range(30)]
    book = spark.createDataFrame(rows, "topic string, partition_no long, offset_no long, received_at timestamp_ntz, processed_at timestamp_ntz")
    move = maintenance.archive_ledger(book, F.lit(T).cast("timestamp_ntz"), batch_size=10)
    assert tuple(maintenance.archived_counts(move, move.moved, ("topic", "partition_no", "offset_no")).first()) == (10, 10, 0)
    assert tuple(maintenance.archived_counts(move, move.moved.limit(4), ("topic", "partition_no", "offset_no")).first()) == (10, 4, 0)


def test_eviction_keeps_the_cutoff(spark):
    clicks = spark.createDataFrame([("a", T - timedelta(minutes=33), "ACTIVE"), ("b", T - timedelta(minutes=32), "ACTIVE")], "click_id string, ts timestamp_ntz, state_status string")
    cutoff = watermark.eviction_cutoff(F.lit(T).cast("timestamp_ntz"), 2, 30)
    assert {r["click_id"]: r["state_status"] for r in tables.evict(clicks, cutoff).collect()} == {"a": "EVICTED", "b": "ACTIVE"}
    assert tables.active_clicks(tables.evict(clicks, cutoff)).count() == 1


def test_archival(spark):
    rows = [(f"c{i}", T - timedelta(minutes=i), "ACTIVE" if i == 5 else "EVICTED") for i in range(10)]
    clicks = spark.createDataFrame(rows, "click_id string, ts timestamp_ntz, state_status string")
    move = maintenance.archive_clicks(clicks, F.lit(T - timedelta(minutes=3)).cast("timestamp_ntz"), F.lit(T), batch_size=3).verified(clicks)
    assert sorted(r["click_id"] for r in move.moved.collect()) == ["c7", "c8", "c9"]
    assert move.remaining.count() == 7
    with pytest.raises(ValueError):
        maintenance.archive_clicks(clicks, F.lit(T), F.lit(T), batch_size=0)


@pytest.mark.parametrize("lag,kept", [(-5, 30), (5, 30), (10, 30), (15, 45), (30, 90), (45, 90)])
def test_archive_duration(spark, lag, kept):
    assert spark.range(1).select(click_archive_minutes(F.lit(lag)).alias("m")).first()["m"] == kept


def test_watermark_upsert_never_falls(spark):
    a = spark.createDataFrame([(0, T), (1, T)], "p long, max_event_time timestamp_ntz")
    b = spark.createDataFrame([(0, T - timedelta(hours=1)), (1, T + timedelta(hours=1)), (2, T)], "p long, max_event_time timestamp_ntz")
    assert {r["p"]: r["max_event_time"] for r in watermark.upsert_watermarks(a, b).collect()} == {0: T, 1: T + timedelta(hours=1), 2: T}


def test_state_before_history(spark):
    state = spark.createDataFrame([("a", 1)], "id string, v int")
    history = spark.createDataFrame([("a", 2), ("b", 3)], "id string, v int")
    assert {r["id"]: (r["v"], r["found_in"]) for r in dedup.lookup_with_history(state, history, "id").collect()} == {"a": (1, "state"), "b": (3, "history")}


def test_restore_fails_on_broken_state(spark):
    good = ("c", "u", "a", T, "ACTIVE")
    schema = "click_id string, user_id string, campaign_id string, ts timestamp_ntz, state_status string"
    assert tables.restored_clicks(spark.createDataFrame([good, ("d", "u", " ", T, "EVICTED")], schema)).count() == 1
    with pytest.raises(Exception, match="click state holds"):
        tables.restored_clicks(spark.createDataFrame([good, ("d", "u", " ", T, "ACTIVE")], schema)).collect()


def test_ledger_skips_recorded_places(spark):
    schema = "topic string, partition_no int, offset_no long"
    new = spark.createDataFrame([("ad_clicks", 0, 1), ("ad_clicks", 1, 1), ("page_views", 0, 1)], schema)
    old = spark.createDataFrame([("ad_clicks", 0, 1)], schema)
    assert tables.skip_recorded(new, old).count() == 2
    history = old.selectExpr("*", "current_timestamp() AS archived_at")
    assert tables.latest_ledger(new, history).count() == 3


def test_unknown_topic_is_its_own_type(spark):
    from tidemark.functions.columns import event_type

    df = spark.createDataFrame([("ad_clicks",), ("page_views",), ("other",)], "t string")
    assert [r[0] for r in df.select(event_type("t")).collect()] == ["ad_clicks", "page_views", "other"]
