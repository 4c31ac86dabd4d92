"""The registered queries: each operator applied to the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import format_time
from ..operators import attribution, dedup, ingest, ledger, maintenance, tables, watermark
from ..schema import ACTIVE, CLICKS_TOPIC, EVICTED, LEDGER_KEY, VIEWS_TOPIC
from ..sources import events

DAY = 24 * 60
L = 15
#: Archival runs are given their clock.
NOW = "TIMESTAMP_NTZ '2024-01-20 00:00:00'"


def _attributed(found: DataFrame) -> DataFrame:
    return attribution.output_rows(found)


def attribution_asof_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(attribution.attribute(events.load(spark, sf_dir), 30))


def attribution_asof_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(attribution.attribute(events.load(spark, sf_dir), DAY))


def attribution_join_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.load(spark, sf_dir)
    found = attribution.attribute_by_join(rows.where("kind = 'view'"), rows.where("kind = 'click'"), DAY)
    return found.select(F.col("id").alias("page_view_id"), "user_id", F.col("ts").alias("event_time"), F.col("click.click_id").alias("attributed_click_id"))


def attribution_watermarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(attribution.attribute_watermarked(events.load(spark, sf_dir), L, DAY))


def attribution_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(attribution.attribute_watermarked(events.load(spark, sf_dir, truncate="hour"), 0, DAY))


def running_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watermark.with_watermarks(events.load(spark, sf_dir), L).select("id", "p", "wm_before", "wm_after")


def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = watermark.with_watermarks(events.load(spark, sf_dir), L).where(watermark.is_late())
    return late.select("id", "kind", "p", "ts", "wm_before")


def partition_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watermark.stored_watermarks(watermark.final_watermarks(events.load(spark, sf_dir))).orderBy("partition_no")


def restored_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = watermark.restored_watermarks(watermark.stored_watermarks(watermark.final_watermarks(events.load(spark, sf_dir))))
    return found.select("p", format_time("max_event_time").alias("max_event_time"))


def global_min_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watermark.global_minimum(watermark.final_watermarks(events.load(spark, sf_dir)))


def watermark_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.load(spark, sf_dir)
    state, seen = (watermark.final_watermarks(rows.where(f"id % 2 = {k}")) for k in (0, 1))
    return watermark.upsert_watermarks(state, seen)


def pending_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = attribution.pending_views(events.load(spark, sf_dir), L)
    return found.select("id", "p", "user_id", "ts", "url").orderBy("ts", "id")


def pending_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(attribution.flush_pending(events.load(spark, sf_dir), L, DAY))


def pending_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.load(spark, sf_dir)
    views = watermark.accepted(rows, L).where("kind = 'view'").select("id", "user_id", "ts")
    return tables.pending_status(views, attribution_watermarked(spark, sf_dir))


def click_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.with_resent(events.load(spark, sf_dir)).where("kind = 'click'")
    return dedup.classify(rows, dedup.CLICK_CONTENT).select("id", "offset_no", "arrival", "campaign_id", "status")


def first_arrival_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.with_resent(events.load(spark, sf_dir)).where("kind = 'view'")
    return dedup.first_arrivals(rows).select("id", "user_id", "ts", "url", "offset_no", "arrival")


def input_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.input_ledger(events.with_resent(events.load(spark, sf_dir)), L)
    topic = F.when(F.col("kind") == "click", CLICKS_TOPIC).otherwise(VIEWS_TOPIC)
    return found.select(topic.alias("topic"), F.col("p").alias("partition_no"), "offset_no", "arrival", F.col("id").alias("event_key"), "status", "processing_status")


def conflict_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.with_resent(events.load(spark, sf_dir))
    sent = F.to_json(F.struct(F.col("user_id").cast("string").alias("user_id"), format_time("ts").alias("event_time"), "campaign_id", F.col("id").cast("string").alias("click_id")))
    return ledger.conflict_letters(ledger.input_ledger(rows.withColumn("payload", sent), L))


def click_classification_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks sent again, against those of state and history and one another."""
    rows = events.load(spark, sf_dir).where("kind = 'click'")
    columns = ("id", "p", "offset_no", *dedup.CLICK_CONTENT)
    state = rows.where("id % 4 = 0").select(*columns)
    history = rows.where("id % 6 = 0").select(*columns)
    stored = dedup.lookup_with_history(state, history, "id")
    again = events.with_resent(rows)
    return dedup.classify(again, dedup.CLICK_CONTENT, stored=stored).select("id", "offset_no", "arrival", "campaign_id", "status")


def envelopes(spark: SparkSession, sf_dir: str, resent: bool = False) -> DataFrame:
    """Log records of the events, some of them broken on purpose."""
    rows = events.load(spark, sf_dir)
    rows = events.with_resent(rows) if resent else rows
    click = F.col("kind") == "click"
    q = lambda name, v: F.concat(F.lit(f'"{name}":"'), v, F.lit('"'))
    key = F.when(click, q("click_id", F.concat(F.lit("c"), F.col("id")))).otherwise(q("event_id", F.concat(F.lit("v"), F.col("id"))))
    rest = F.when(click, q("campaign_id", F.col("campaign_id"))).otherwise(q("url", F.col("url")))
    second = F.date_trunc("second", "ts")
    time = F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss")
    user = F.concat(F.lit("u"), F.col("user_id"))
    case = F.col("id") % 12
    join = lambda *parts: F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    ok = (key, q("user_id", user), q("event_time", F.concat(time, F.lit("Z"))), rest)
    value = (
        F.when(case == 0, F.lit(" \t"))
        .when(case == 1, F.lit("{"))
        .when(case == 2, F.lit("null"))
        .when(case == 3, join(*ok[1:]))
        .when(case == 4, join(ok[0], q("user_id", F.lit("  ")), *ok[2:]))
        .when(case == 5, join(*ok[:2], q("event_time", F.concat(time, F.lit(".123Z"))), ok[3]))
        .when(case == 6, join(*ok[:3]))
        .when(case == 7, join(*ok[:2], q("event_time", time), ok[3]))
        .when(case == 8, join(*ok[:2], ok[3]))
        .otherwise(join(*ok))
    )
    return rows.select(
        F.when(click, CLICKS_TOPIC).otherwise(VIEWS_TOPIC).alias("topic"),
        F.col("p").cast("int").alias("partition"),
        F.col("offset_no").alias("offset"),
        user.alias("key"),
        F.when(case != 11, value).alias("value"),
        F.col("id").alias("arrival_seq"),
        "arrival",
    )


def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.parse(envelopes(spark, sf_dir))
    return found.select("topic", "partition", "offset", "event_key", format_time("event_time").alias("event_time"), "reason")


def invalid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = ingest.invalid_dead_letters(ingest.parse(envelopes(spark, sf_dir)))
    return letters.groupBy("topic", "error_type", "error_message").agg(F.count("*").alias("n"))


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.load(spark, sf_dir)
    clicks = watermark.accepted(rows, L).where("kind = 'click'").withColumn("state_status", F.lit(ACTIVE))
    return clicks.select(F.col("id").alias("click_id"), "user_id", "ts", "campaign_id", "p", "state_status")


def _evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = watermark.global_minimum(watermark.final_watermarks(events.load(spark, sf_dir)))
    return tables.evict(_clicks(spark, sf_dir), watermark.eviction_cutoff(least.scalar(), L, DAY))


def evict_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evicted(spark, sf_dir).select("click_id", "ts", "state_status")


def click_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evict_clicks(spark, sf_dir).groupBy("state_status").agg(F.count("*").alias("n"))


def active_clicks_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.active_clicks(_evicted(spark, sf_dir)).select("user_id", "ts", "click_id", "campaign_id").orderBy("user_id", "ts", "click_id")


def _archived(spark: SparkSession, sf_dir: str) -> maintenance.Move:
    clicks = _clicks(spark, sf_dir).withColumn("state_status", F.when(F.col("click_id") % 5 == 0, ACTIVE).otherwise(EVICTED))
    return maintenance.archive_clicks(clicks, F.expr(f"{NOW} - INTERVAL '45' MINUTE"), F.expr(NOW))


def archive_clicks_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archived(spark, sf_dir).moved.drop("p")


def archive_clicks_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archived(spark, sf_dir).remaining.select("click_id", "state_status")


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.load(spark, sf_dir)
    topic = F.when(F.col("kind") == "click", CLICKS_TOPIC).otherwise(VIEWS_TOPIC)
    done = F.when(F.col("id") % 5 != 0, F.col("arrival") + F.expr("INTERVAL '1' MINUTE"))
    return rows.select(topic.alias("topic"), F.col("p").alias("partition_no"), "offset_no", F.col("arrival").alias("received_at"), done.alias("processed_at"))


def archive_ledger_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.archive_ledger(_ledger(spark, sf_dir), F.expr(NOW)).moved


def archive_ledger_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.archive_ledger(_ledger(spark, sf_dir), F.expr(NOW)).remaining.select(*LEDGER_KEY, "received_at", "processed_at")


def archive_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a ledger move whose history held some of the rows already."""
    move = maintenance.archive_ledger(_ledger(spark, sf_dir), F.expr(NOW))
    history = move.moved.unionByName(_ledger(spark, sf_dir).where("offset_no % 9 = 0").withColumn("archived_at", F.expr(NOW)))
    return maintenance.archived_counts(move, history.dropDuplicates(list(LEDGER_KEY)), LEDGER_KEY)


def ledger_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _ledger(spark, sf_dir).where("offset_no % 7 = 0").select(*LEDGER_KEY)
    return _ledger(spark, sf_dir).join(stored, list(LEDGER_KEY), "left_semi").select(*LEDGER_KEY)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution_asof_24h(spark, sf_dir).where("page_view_id % 3 = 0")


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.insert_if_absent(attribution_asof_24h(spark, sf_dir), _stored(spark, sf_dir), ["page_view_id"])


def output_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = attribution_asof_24h(spark, sf_dir).withColumn("url", F.when(F.col("page_view_id") % 9 == 0, F.concat("url", F.lit("/y"))).otherwise(F.col("url")))
    return tables.conflicts(changed, _stored(spark, sf_dir), ["page_view_id"], attribution_columns())


def output_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored output of every click's id and of every tenth view's."""
    asked = events.load(spark, sf_dir).where("kind = 'click' OR id % 10 = 0").select(F.col("id").alias("page_view_id"))
    return tables.output_by_id(attribution_asof_24h(spark, sf_dir), asked)


def _broken_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output rows, some invalid, some sent twice with other content."""
    rows = attribution_asof_24h(spark, sf_dir)
    id_ = F.col("page_view_id")
    broken = rows.select(
        "page_view_id",
        F.when(id_ % 11 == 0, F.lit(" ")).otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(id_ % 13 != 0, F.col("event_time")).alias("event_time"),
        F.when(id_ % 17 == 0, F.lit("")).otherwise(F.col("url")).alias("url"),
        "attributed_campaign_id",
        F.when(id_ % 5 != 0, F.col("attributed_click_id")).alias("attributed_click_id"),
    )
    return broken.unionByName(broken.where("page_view_id % 7 = 0").withColumn("url", F.concat("url", F.lit("/z"))))


def output_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broken_outputs(spark, sf_dir).select("page_view_id", "url", tables.output_problem().alias("problem"))


def output_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the validating, emit-once table appends of them."""
    stored = attribution_asof_24h(spark, sf_dir).where("page_view_id % 3 = 0").withColumn("user_id", F.col("user_id").cast("string"))
    return tables.write_output(_broken_outputs(spark, sf_dir), stored, ["url"])[0]


def retry_exhausted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters of what it refuses."""
    stored = attribution_asof_24h(spark, sf_dir).where("page_view_id % 3 = 0").withColumn("user_id", F.col("user_id").cast("string"))
    refused = tables.write_output(_broken_outputs(spark, sf_dir), stored, ["url"])[1]
    return ledger.exhausted_letters(refused).select("event_type", "event_key", "event_time", "error_type", "error_message", "attempt_count")


def attribution_columns() -> tuple[str, ...]:
    return ("user_id", "event_time", "url", "attributed_campaign_id", "attributed_click_id")


def state_or_history_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = events.load(spark, sf_dir).where("kind = 'click'").select(F.col("id").alias("click_id"), "user_id", "campaign_id")
    history = clicks.where("click_id % 4 = 0 OR click_id % 6 = 0").withColumn("campaign_id", F.concat("campaign_id", F.lit("_old")))
    return dedup.lookup_with_history(clicks.where("click_id % 4 <> 0"), history, "click_id")


def output_contract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.sink import json_lines

    return json_lines(attribution_asof_24h(spark, sf_dir)).withColumnRenamed("value", "json")


def offset_replay_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _ledger(spark, sf_dir)
    return tables.skip_recorded(book, book.where("offset_no % 7 = 0")).select(*LEDGER_KEY)


def restored_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = _clicks(spark, sf_dir).withColumn("state_status", F.when(F.col("click_id") % 5 == 0, ACTIVE).otherwise(EVICTED))
    return tables.restored_clicks(clicks.withColumn("click_id", F.col("click_id").cast("string")).withColumn("user_id", F.col("user_id").cast("string"))).select("user_id", "ts", "click_id", "campaign_id")


def click_archive_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.columns import click_archive_cutoff

    marks = watermark.final_watermarks(events.load(spark, sf_dir))
    lagged = marks.select("*", F.explode(F.array(*[F.lit(x) for x in (-5, 5, 10, 15, 30, 45)])).alias("lag"))
    now = F.col("max_event_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("lag"))
    return lagged.select("p", "lag", click_archive_cutoff(now, F.col("max_event_time")).alias("cutoff"))


def _in_three(df: DataFrame, run) -> str:
    """Writes ``df`` (with ``arrival``) as files in three parts by arrival, and
    runs a stream over what is there after each; returns the folder."""
    from uuid import uuid4

    from ..functions.columns import shared_dir

    spark = df.sparkSession
    root = f"{shared_dir(spark)}/replay-{uuid4().hex}"
    third = df.select(F.percentile_approx("arrival", [0.33, 0.66]).alias("c")).first()["c"]
    parts = (df.where(F.col("arrival") <= third[0]), df.where((F.col("arrival") > third[0]) & (F.col("arrival") <= third[1])), df.where(F.col("arrival") > third[1]))
    for n, part in enumerate(parts):
        part.write.parquet(f"{root}/in/part={n}")
        run(spark.readStream.schema(df.schema).parquet(f"{root}/in/part=*"), root).awaitTermination()
    return root


def stream_exact_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact streaming mode over the events in three micro-batches."""
    from ..schema import Settings
    from ..streaming import exact, sink

    rows = events.load(spark, sf_dir)
    topic = F.when(F.col("kind") == "click", CLICKS_TOPIC).otherwise(VIEWS_TOPIC)
    sent = rows.withColumn("topic", topic).withColumn("arrival", F.unix_micros(F.col("arrival").cast("timestamp"))).withColumn("ts", F.col("ts").cast("timestamp"))
    settings = Settings(allowed_lateness_minutes=L, attribution_window_minutes=DAY)

    def run(stream: DataFrame, root: str):
        return sink.start(exact.attribution_records(stream, settings), f"{root}/out", f"{root}/checkpoint", available_now=True)

    root = _in_three(sent, run)
    return sink.read_table(spark, f"{root}/out", "output").withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


#: Tables of a stream that this application has run.
_RUNS: dict[tuple[str, str], str] = {}


def _engine(spark: SparkSession, sf_dir: str) -> str:
    """The whole stream over log records, broken and sent again; returns its
    tables.  One run serves the three queries that read them."""
    from ..schema import Settings
    from ..streaming import engine

    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _RUNS:
        return _RUNS[key]
    sent = envelopes(spark, sf_dir, resent=True).withColumn("arrival", F.unix_micros(F.col("arrival").cast("timestamp"))).withColumn("arrival_seq", F.col("arrival"))
    settings = Settings(allowed_lateness_minutes=L, attribution_window_minutes=DAY)
    _RUNS[key] = _in_three(sent, lambda stream, root: engine.start(stream, f"{root}/out", f"{root}/checkpoint", settings, available_now=True)) + "/out"
    return _RUNS[key]


def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import sink

    return sink.read_table(spark, _engine(spark, sf_dir), "ledger").select("topic", "partition_no", "offset_no", "event_type", "event_key", format_time("event_time").alias("event_time"), "status", "processing_status")


def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import sink

    return sink.read_table(spark, _engine(spark, sf_dir), "dead_letter").withColumn("event_time", format_time("event_time"))


def stream_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import sink

    return sink.read_table(spark, _engine(spark, sf_dir), "output").withColumn("event_time", format_time("event_time"))
