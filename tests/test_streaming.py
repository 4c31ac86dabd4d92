import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest, tables
from tidemark.schema import Settings
from tidemark.sources import sample, streams
from tidemark.streaming import engine, exact, native, sink

GOLDEN = {
    (1, 2): ({"pv_1": "click_1", "pv_2": None, "pv_3": "click_3b", "pv_5": None, "pv_4": None}, {"click_2", "click_5"}),
    (1, 5): ({"pv_1": "click_1", "pv_2": "click_2", "pv_3": "click_3b", "pv_5": "click_5", "pv_4": None}, set()),
    (3, 2): ({"pv_1": "click_1", "pv_2": None, "pv_4": None}, {"click_2", "click_5"}),
    (3, 5): ({"pv_1": "click_1", "pv_2": "click_2", "pv_4": None}, set()),
}


def write(path, rows, name):
    path.mkdir(parents=True, exist_ok=True)
    keys = ("topic", "partition", "offset", "key", "value", "arrival_seq")
    (path / name).write_text("".join(json.dumps(dict(zip(keys, r))) + "\n" for r in rows))
    at = 1_700_000_000 + 60 * int(name.split(".")[0])  # files are taken by age
    os.utime(path / name, (at, at))


def run(spark, path, lateness, **more):
    envelopes = streams.from_files(spark, f"{path}/in", max_files=1)
    engine.start(envelopes, f"{path}/out", f"{path}/checkpoint", Settings(allowed_lateness_minutes=lateness, **more), available_now=True).awaitTermination()
    out = {r["page_view_id"]: r["attributed_click_id"] for r in sink.read_table(spark, f"{path}/out", "output").collect()}
    ledger = {r["event_key"]: r["processing_status"] for r in sink.read_table(spark, f"{path}/out", "ledger").collect()}
    letters = sorted((r["event_key"] or "", r["error_type"]) for r in sink.read_table(spark, f"{path}/out", "dead_letter").collect())
    return out, ledger, letters


@pytest.mark.parametrize("partitions,lateness", [(1, 2), (3, 5)])
def test_scenario_with_restart(spark, tmp_path, partitions, lateness):
    rows = sample.envelope_rows(partitions)
    for n, at in enumerate(range(0, 8, 4)):
        write(tmp_path / "in", rows[at : at + 4], f"{n}.json")
    run(spark, tmp_path, lateness)
    write(tmp_path / "in", rows[8:], "9.json")  # the query stops and starts again on its checkpoint
    out, ledger, _ = run(spark, tmp_path, lateness)
    expected, late = GOLDEN[partitions, lateness]
    assert out == expected
    assert {k for k, v in ledger.items() if v == "DROPPED_LATE"} == late


def test_duplicates_and_conflicts(spark, tmp_path):
    one = sample.envelope_rows(1)
    again = [(t, p, o + 100, k, v, s + 100) for t, p, o, k, v, s in one[:2]]
    changed = [(t, p, o + 200, k, v.replace("campaign_A", "campaign_Z").replace("product1", "other"), s + 200) for t, p, o, k, v, s in one[:2]]
    write(tmp_path / "in", one + again, "0.json")
    write(tmp_path / "in", changed, "1.json")
    out, _, letters = run(spark, tmp_path, 5, view_conflicts=True)
    assert out == GOLDEN[1, 5][0]
    assert letters == [("click_1", "CLICK_ID_CONFLICT"), ("pv_1", "PAGE_VIEW_ID_CONFLICT")]
    status = sink.read_table(spark, f"{tmp_path}/out", "ledger").where("offset_no >= 100")
    assert sorted((r["event_key"], r["status"]) for r in status.collect()) == [("click_1", "CONFLICT"), ("click_1", "DUPLICATE"), ("pv_1", "CONFLICT"), ("pv_1", "DUPLICATE")]


def test_a_second_view_is_processed_without_effect(spark, tmp_path):
    one = [r for r in sample.envelope_rows(1) if "pv_1" in r[4]]
    changed = [(t, p, o + 200, k, v.replace("product1", "other"), s + 200) for t, p, o, k, v, s in one]
    later = json.dumps({"user_id": "z", "event_time": "2024-01-01T20:00:00", "url": "/", "event_id": "z"})
    write(tmp_path / "in", one + changed, "0.json")
    write(tmp_path / "in", [("page_views", 0, 900, "z", later, 900), *[(t, p, o + 300, k, v, s + 901) for t, p, o, k, v, s in one]], "1.json")
    out, _, letters = run(spark, tmp_path, 5)
    assert out == {"pv_1": None} and not letters
    book = {r["offset_no"]: (r["status"], r["processing_status"]) for r in sink.read_table(spark, f"{tmp_path}/out", "ledger").collect()}
    assert book == {one[0][2]: ("INSERTED", "PROCESSED"), one[0][2] + 200: ("DUPLICATE", "PROCESSED"), 900: ("INSERTED", "PROCESSED"), one[0][2] + 300: ("DUPLICATE", "DROPPED_LATE")}


def test_broken_records_are_dead_letters(spark, tmp_path):
    good = sample.envelope_rows(1)
    bad = [("ad_clicks", 0, 500, "k", None, 500), ("ad_clicks", 0, 501, "k", "{", 501), ("page_views", 0, 502, "k", good[1][4].replace("user_1", " "), 502), ("other", 0, 503, "k", "{", 503)]
    write(tmp_path / "in", good + bad, "0.json")
    out, ledger, _ = run(spark, tmp_path, 5)
    assert out == GOLDEN[1, 5][0] and len(ledger) == len(good)
    letters = {r["offset_no"]: r for r in sink.read_table(spark, f"{tmp_path}/out", "dead_letter").collect()}
    assert {k: (r["error_message"], r["payload"], r["event_key"]) for k, r in letters.items()} == {500: ("blank record", None, None), 501: ("not a JSON object", "{", None), 502: ("user_id is missing", bad[2][4], "pv_1")}
    assert all(r["error_type"] == "INVALID_KAFKA_RECORD" and r["attempt_count"] == 1 and r["event_type"] == r["topic"] for r in letters.values())


def test_click_ids_over_partitions(spark, tmp_path):
    click = lambda p, o, user, s, id_="c": ("ad_clicks", p, o, user, json.dumps({"user_id": user, "event_time": "2024-01-01T12:00:00", "campaign_id": "a", "click_id": id_}), s)
    write(tmp_path / "in", [click(0, 1, "u", 1), click(0, 2, "u", 2, "d")], "0.json")
    write(tmp_path / "in", [click(1, 1, "w", 3), click(1, 2, "u", 4, "d")], "1.json")
    _, _, letters = run(spark, tmp_path, 5)
    book = {(r["partition_no"], r["offset_no"]): (r["status"], r["processing_status"]) for r in sink.read_table(spark, f"{tmp_path}/out", "ledger").collect()}
    assert book == {(0, 1): ("INSERTED", "PROCESSED"), (0, 2): ("INSERTED", "PROCESSED"), (1, 1): ("CONFLICT", "DEAD_LETTER"), (1, 2): ("DUPLICATE", "PROCESSED")}
    assert letters == [("c", "CLICK_ID_CONFLICT")]


def test_refused_output_is_a_dead_letter(spark, tmp_path):
    # one view id in two partitions, with different content: the second one is final later
    view = lambda p, o, id_, user, minute, s: ("page_views", p, o, user, json.dumps({"user_id": user, "event_time": f"2024-01-01T{12 + minute // 60}:{minute % 60:02d}:00", "url": "/", "event_id": id_}), s)
    write(tmp_path / "in", [view(0, 1, "v", "u", 0, 1), view(0, 2, "end0", "u", 90, 2)], "0.json")
    write(tmp_path / "in", [view(1, 1, "v", "w", 0, 3), view(1, 2, "end1", "w", 90, 4)], "1.json")
    out, _, letters = run(spark, tmp_path, 5)
    assert out == {"v": None} and letters == [("v", "PROCESSING_RETRY_EXHAUSTED")]
    letter = sink.read_table(spark, f"{tmp_path}/out", "dead_letter").first()
    assert (letter["partition_no"], letter["offset_no"], letter["attempt_count"], letter["error_message"]) == (1, 1, 4, "page_view_id is stored with other content")


def test_output_checks_agree(spark):
    rows = [("1", "u", 0, "/", "a", "c"), (None, "u", 0, "/", None, None), ("2", "\u2003", 0, "/", None, None), ("3", "u", None, "/", None, None), ("4", "u", 0, "", None, None), ("5", "u", 0, "/", "a", " ")]
    keys = ("id", "user_id", "ts", "url", "campaign_id", "click_id")
    own = [exact.output_problem(dict(zip(keys, r))) for r in rows]
    df = spark.createDataFrame(rows, "page_view_id string, user_id string, event_time long, url string, attributed_campaign_id string, attributed_click_id string")
    assert own == [r[0] for r in df.select(tables.output_problem()).collect()]
    assert own == [None, "page_view_id is missing", "user_id is missing", "event_time is missing", "url is missing", "attribution is incomplete"]


def test_batch_replaces_itself(spark, tmp_path):
    rows = [{"record_kind": "output", "id": "v1", "user_id": "u", "ts": 0, "url": "/"}, {"record_kind": "ledger", "id": "v1", "topic": "page_views", "p": 0, "offset_no": 3, "ts": 0, "status": "INSERTED"}]
    records = spark.createDataFrame(rows, exact.RECORD)
    writer = sink.batch_writer(str(tmp_path))
    for batch in (0, 0):
        writer(records, batch)
    assert sink.read_table(spark, str(tmp_path), "output").count() == 1
    writer(records.where("record_kind = 'ledger'"), 1)  # a place in the log that has its row
    assert sink.read_table(spark, str(tmp_path), "ledger").count() == 1


def test_failed_writes_are_repeated(spark, tmp_path, monkeypatch):
    tries = []
    real = sink._append
    monkeypatch.setattr(sink, "_append", lambda *a: tries.append(a[2]) or (real(*a) if len(tries) > 2 else 1 / 0))
    records = spark.createDataFrame([{"record_kind": "output", "id": "v1"}], exact.RECORD)
    sink.batch_writer(str(tmp_path), Settings(backoff_seconds=0))(records, 0)
    assert tries[:3] == ["output"] * 3 and sink.read_table(spark, str(tmp_path), "output").count() == 1
    monkeypatch.setattr(sink, "_append", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        sink.batch_writer(str(tmp_path), Settings(backoff_seconds=0, max_retries=1))(records, 1)


def test_ledger_is_archived_by_batch(spark, tmp_path):
    book = lambda n: spark.createDataFrame([{"record_kind": "ledger", "id": f"v{n}", "topic": "page_views", "p": 0, "offset_no": n, "ts": 0, "status": "INSERTED"}], exact.RECORD)
    writer, root = sink.batch_writer(str(tmp_path)), str(tmp_path)
    for n in range(3):
        writer(book(n), n)
    now = datetime.now()
    assert sink.archive_ledger(spark, root, now) == 0
    assert sink.archive_ledger(spark, root, now + timedelta(hours=13)) == 3
    assert sink.archive_ledger(spark, root, now + timedelta(hours=13)) == 0
    assert sink.read_table(spark, root, "ledger").count() == 0 and sink.read_table(spark, root, "ledger_history").count() == 3
    writer(book(1), 7)  # in the history already
    assert sink.read_table(spark, root, "ledger").count() == 0


def test_native_agrees_on_input_in_order(spark, tmp_path):
    rows = [r for r in sample.envelope_rows(1) if json.loads(r[4]).get("click_id") not in ("click_2", "click_5")]
    last = json.dumps({"user_id": "z", "event_time": "2024-01-01T20:00:00", "campaign_id": "z", "click_id": "z", "url": "/", "event_id": "z"})
    # both inputs need a late event: the watermark is the lesser of theirs
    rows += [("ad_clicks", 0, 900, "z", last, 900), ("page_views", 0, 900, "z", last, 901)]
    for n, r in enumerate(rows):
        write(tmp_path / "in", [r], f"{n:02d}.json")
    parsed = ingest.parse(streams.from_files(spark, f"{tmp_path}/in", max_files=1))
    events = ingest.events(parsed)
    query = native.attribute_stream(events, Settings()).writeStream.format("memory").queryName("native").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    found = {r["page_view_id"]: r["attributed_click_id"] for r in spark.table("native").collect()}
    assert found == {"pv_1": "click_1", "pv_2": None, "pv_3": "click_3b", "pv_5": None, "pv_4": None, "pv_6": None}


def test_kafka_options():
    options = streams.kafka_options("host:9092", max_per_trigger=100)
    assert options["startingOffsets"] == "earliest" and options["kafka.isolation.level"] == "read_committed" and options["maxOffsetsPerTrigger"] == "100"


def test_sample_is_in_order_of_arrival(spark):
    df = sample.envelopes(spark)
    assert df.count() == 12 and df.select(F.countDistinct("partition")).first()[0] == 3


def test_output_as_json_lines(spark, tmp_path):
    rows = [(f"v{n}", "u", datetime(2024, 1, 1, 12, n), "/", *w) for n, w in enumerate([("a", "c"), (None, None)])]
    df = spark.createDataFrame(rows, "page_view_id string, user_id string, event_time timestamp, url string, attributed_campaign_id string, attributed_click_id string")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = sink.start_json_lines(stream, f"{tmp_path}/out", f"{tmp_path}/c")
    query.processAllAvailable()
    query.stop()
    found = sorted((json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/out").collect()), key=lambda r: r["page_view_id"])
    assert found[1] == {"page_view_id": "v1", "user_id": "u", "event_time": "2024-01-01T12:01:00Z", "url": "/", "attributed_campaign_id": None, "attributed_click_id": None}
    assert found[0]["attributed_click_id"] == "c"


def test_kafka_needs_its_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        streams.from_kafka(spark, "localhost:9092")
