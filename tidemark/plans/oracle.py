"""The same queries in DuckDB's SQL, written independently of the plans."""

from __future__ import annotations

from ..schema import CLICK_CONFLICT_MESSAGE


def base(truncate: bool = False) -> str:
    ts = "date_trunc('hour', ts)::TIMESTAMP" if truncate else "ts"
    return f"""
rows AS (
  SELECT CASE event_type WHEN 'view' THEN 'view' ELSE 'click' END AS kind, event_id AS id, user_id, {ts} AS ts,
         'campaign_' || json_extract_string(props, '$.k') AS campaign_id, 'https://example.com/p/' || (event_id % 50) AS url,
         user_id % 3 AS p, event_id AS offset_no, ts + to_minutes(((event_id * 7919) % 97)::INT) AS arrival
  FROM events WHERE event_type IN ('view', 'click')
)"""


SENT = """
sent AS (
  SELECT * FROM rows
  UNION ALL SELECT kind, id, user_id, ts, campaign_id, url, p, offset_no + 10000000, arrival + INTERVAL 1 DAY FROM rows WHERE id % 10 = 0
  UNION ALL SELECT kind, id, user_id, ts, campaign_id || '_x', url || '/x', p, offset_no + 20000000, arrival + INTERVAL 1 DAY FROM rows WHERE id % 17 = 0
  UNION ALL SELECT kind, id, user_id, ts, campaign_id, url, p, offset_no, arrival + INTERVAL 1 DAY FROM rows WHERE id % 13 = 0
)"""

RESENT = SENT + """, firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY arrival, offset_no) AS n FROM sent) WHERE n = 1
), classed AS (
  SELECT s.*, CASE WHEN NOT (s.user_id = f.user_id AND s.ts = f.ts AND (CASE s.kind WHEN 'click' THEN s.campaign_id = f.campaign_id ELSE s.url = f.url END)) THEN 'CONFLICT'
                   WHEN s.p = f.p AND s.offset_no = f.offset_no AND s.arrival = f.arrival THEN 'INSERTED'
                   WHEN s.p = f.p AND s.offset_no = f.offset_no THEN 'REPLAY' ELSE 'DUPLICATE' END AS status
  FROM sent s JOIN firsts f ON s.kind = f.kind AND s.id = f.id
)"""


def judged(source: str) -> str:
    """Verdicts of the ledger.  An event sent again has the time of the first
    one, so none of them, conflicts included, moves a watermark that the first
    one didn't move."""
    return f"""
{marks(source, 15)}, clocked AS (
  SELECT *, coalesce(ts < wm_before, false) AS late FROM marked
), stored AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY arrival, offset_no) AS n FROM clocked WHERE NOT late) WHERE n = 1
), compared AS (
  SELECT t.*, s.id IS NULL OR (t.arrival, t.offset_no) < (s.arrival, s.offset_no) AS unknown, coalesce((t.arrival, t.offset_no) = (s.arrival, s.offset_no), false) AS own,
         coalesce(t.user_id = s.user_id AND t.ts = s.ts AND CASE t.kind WHEN 'click' THEN t.campaign_id = s.campaign_id ELSE t.url = s.url END, false) AS same, coalesce(t.offset_no = s.offset_no, false) AS place
  FROM clocked t LEFT JOIN stored s ON s.kind = t.kind AND s.id = t.id
), classes AS (
  SELECT *, CASE WHEN unknown OR own THEN 'INSERTED' WHEN kind = 'click' AND NOT same THEN 'CONFLICT' WHEN same AND place THEN 'REPLAY' ELSE 'DUPLICATE' END AS status FROM compared
), judged AS (
  SELECT *, CASE kind WHEN 'click' THEN 'ad_clicks' ELSE 'page_views' END AS topic,
         CASE WHEN status = 'CONFLICT' THEN 'DEAD_LETTER' WHEN kind = 'click' AND unknown OR kind = 'view' AND late THEN 'DROPPED_LATE' ELSE 'PROCESSED' END AS processing_status
  FROM classes
)"""


def marks(source: str, lateness: int) -> str:
    frame = "OVER (PARTITION BY p ORDER BY arrival, id ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""
marked AS (
  SELECT *, max(ts) {frame} 1 PRECEDING) - INTERVAL {lateness} MINUTE AS wm_before,
         max(ts) {frame} CURRENT ROW) - INTERVAL {lateness} MINUTE AS wm_after,
         row_number() OVER (PARTITION BY p ORDER BY arrival, id) AS seq
  FROM {source}
), accepted AS (
  SELECT * FROM marked WHERE wm_before IS NULL OR ts >= wm_before
)"""


def asof(window: str) -> str:
    return f"""
joined AS (
  SELECT v.*, c.id AS click_id, c.campaign_id AS won,
         row_number() OVER (PARTITION BY v.id ORDER BY c.ts DESC NULLS LAST, c.id DESC) AS n
  FROM (SELECT * FROM rows WHERE kind = 'view') v
  LEFT JOIN (SELECT * FROM rows WHERE kind = 'click') c
    ON c.user_id = v.user_id AND c.ts BETWEEN v.ts - INTERVAL {window} AND v.ts
), output AS (
  SELECT id AS page_view_id, user_id, ts AS event_time, url, won AS attributed_campaign_id, click_id AS attributed_click_id FROM joined WHERE n = 1
)"""


def watermarked(lateness: int) -> str:
    return f"""
{marks("rows", lateness)}, emitted AS (
  SELECT a.id, a.user_id, a.ts, a.url, min(x.seq) AS emit_seq, a.p FROM accepted a
  JOIN accepted x ON x.p = a.p AND x.seq >= a.seq AND x.wm_after >= a.ts
  WHERE a.kind = 'view' GROUP BY ALL
), joined AS (
  SELECT v.*, c.id AS click_id, c.campaign_id AS won, row_number() OVER (PARTITION BY v.id ORDER BY c.ts DESC NULLS LAST, c.id DESC) AS n
  FROM emitted v LEFT JOIN accepted c ON c.kind = 'click' AND c.user_id = v.user_id AND c.ts BETWEEN v.ts - INTERVAL 24 HOUR AND v.ts AND c.seq <= v.emit_seq
), output AS (
  SELECT id AS page_view_id, user_id, ts AS event_time, url, won AS attributed_campaign_id, click_id AS attributed_click_id FROM joined WHERE n = 1
)"""


def envelopes(source: str = "rows") -> str:
    return """
env AS (
  SELECT *, CASE kind WHEN 'click' THEN 'ad_clicks' ELSE 'page_views' END AS topic,
         CASE kind WHEN 'click' THEN '"click_id":"c' || id || '"' ELSE '"event_id":"v' || id || '"' END AS k,
         '"user_id":"u' || user_id || '"' AS u, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t,
         CASE kind WHEN 'click' THEN '"campaign_id":"' || campaign_id || '"' ELSE '"url":"' || url || '"' END AS z
  FROM SOURCE
), records AS (
  SELECT topic, kind, id, user_id, ts, campaign_id, url, p, offset_no, arrival, p::INT AS "partition", offset_no AS "offset",
    CASE id % 12 WHEN 0 THEN ' ' || chr(9) WHEN 1 THEN '{' WHEN 2 THEN 'null'
      WHEN 3 THEN '{' || u || ',"event_time":"' || t || 'Z",' || z || '}'
      WHEN 4 THEN '{' || k || ',"user_id":"  ","event_time":"' || t || 'Z",' || z || '}'
      WHEN 5 THEN '{' || k || ',' || u || ',"event_time":"' || t || '.123Z",' || z || '}'
      WHEN 6 THEN '{' || k || ',' || u || ',"event_time":"' || t || 'Z"}'
      WHEN 7 THEN '{' || k || ',' || u || ',"event_time":"' || t || '",' || z || '}'
      WHEN 8 THEN '{' || k || ',' || u || ',' || z || '}'
      WHEN 11 THEN NULL
      ELSE '{' || k || ',' || u || ',"event_time":"' || t || 'Z",' || z || '}' END AS value
  FROM env
), fields AS (
  SELECT *, coalesce(json_valid(value) AND json_type(CASE WHEN json_valid(value) THEN value END) = 'OBJECT', false) AS ok FROM records
), read AS (
  SELECT *, CASE WHEN ok THEN json_extract_string(value, CASE kind WHEN 'click' THEN '$.click_id' ELSE '$.event_id' END) END AS event_key,
         CASE WHEN ok THEN json_extract_string(value, '$.user_id') END AS uid,
         CASE WHEN ok THEN json_extract_string(value, CASE kind WHEN 'click' THEN '$.campaign_id' ELSE '$.url' END) END AS rest,
         CASE WHEN ok THEN json_extract_string(value, '$.event_time') END AS tm
  FROM fields
), timed AS (
  SELECT *, CASE WHEN regexp_full_match(tm, '\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(Z|[+-]\\d\\d:\\d\\d)?') THEN left(tm, 19) || 'Z' END AS good FROM read
), checked AS (
  SELECT *, CASE WHEN value IS NULL OR regexp_full_match(value, '\\s*') THEN 'blank record' WHEN NOT coalesce(ok, false) THEN 'not a JSON object'
       WHEN tm IS NOT NULL AND good IS NULL THEN 'event_time is not a time'
       WHEN trim(coalesce(uid, '')) = '' THEN 'user_id is missing'
       WHEN kind = 'click' AND trim(coalesce(rest, '')) = '' THEN 'campaign_id is missing'
       WHEN kind = 'view' AND trim(coalesce(rest, '')) = '' THEN 'url is missing'
       WHEN kind = 'click' AND trim(coalesce(event_key, '')) = '' THEN 'click_id is missing'
       WHEN kind = 'view' AND trim(coalesce(event_key, '')) = '' THEN 'event_id is missing'
       WHEN good IS NULL THEN 'event_time is missing' END AS reason
  FROM timed
)""".replace("SOURCE", source)

CLICKS = """
least_mark AS (SELECT min(m) AS m FROM (SELECT max(ts) AS m FROM rows GROUP BY p)), clicks AS (
  SELECT id AS click_id, user_id, ts, campaign_id, CASE WHEN ts < (SELECT m FROM least_mark) - INTERVAL 15 MINUTE - INTERVAL 24 HOUR THEN 'EVICTED' ELSE 'ACTIVE' END AS state_status
  FROM accepted WHERE kind = 'click'
)"""

ARCHIVE = """
state AS (
  SELECT id AS click_id, user_id, ts, campaign_id, CASE WHEN id % 5 = 0 THEN 'ACTIVE' ELSE 'EVICTED' END AS state_status FROM accepted WHERE kind = 'click'
), batch AS (
  SELECT * FROM state WHERE state_status <> 'ACTIVE' AND ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 45 MINUTE ORDER BY ts, click_id LIMIT 500
)"""

LEDGER = """
book AS (
  SELECT CASE kind WHEN 'click' THEN 'ad_clicks' ELSE 'page_views' END AS topic, p AS partition_no, offset_no, arrival AS received_at,
         CASE WHEN id % 5 <> 0 THEN arrival + INTERVAL 1 MINUTE END AS processed_at
  FROM rows
)"""


#: Valid log records as events: their time has whole seconds.
VALID = """
valid AS (
  SELECT kind, id, user_id, uid, date_trunc('second', ts)::TIMESTAMP AS ts, campaign_id, url, p, offset_no, arrival, event_key, value AS payload FROM checked WHERE reason IS NULL
)"""

BROKEN = """
once AS (
  SELECT page_view_id, CASE WHEN page_view_id % 11 = 0 THEN ' ' ELSE user_id::VARCHAR END AS user_id, CASE WHEN page_view_id % 13 <> 0 THEN event_time END AS event_time,
         CASE WHEN page_view_id % 17 = 0 THEN '' ELSE url END AS url, attributed_campaign_id, CASE WHEN page_view_id % 5 <> 0 THEN attributed_click_id END AS attributed_click_id FROM output
), broken AS (
  SELECT * FROM once UNION ALL SELECT page_view_id, user_id, event_time, url || '/z', attributed_campaign_id, attributed_click_id FROM once WHERE page_view_id % 7 = 0
), checked AS (
  SELECT *, CASE WHEN trim(user_id) = '' THEN 'user_id is missing' WHEN trim(url) = '' THEN 'url is missing' WHEN event_time IS NULL THEN 'event_time is missing'
                 WHEN (attributed_campaign_id IS NULL) <> (attributed_click_id IS NULL) THEN 'attribution is incomplete' END AS problem FROM broken
), winners AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_view_id ORDER BY url) AS n FROM checked WHERE problem IS NULL) WHERE n = 1
)"""


def sql(*ctes: str, select: str) -> str:
    return "WITH" + ",".join(ctes) + "\n" + select


def oracle_sql() -> dict[str, str]:
    rows, day, marked = base(), asof("24 HOUR"), marks("rows", 15)
    return {
        "attribution_asof_30m": sql(rows, asof("30 MINUTE"), select="SELECT * FROM output"),
        "attribution_asof_24h": sql(rows, day, select="SELECT * FROM output"),
        "attribution_join_form": sql(rows, day, select="SELECT page_view_id, user_id, event_time, attributed_click_id FROM output"),
        "attribution_watermarked": sql(rows, watermarked(15), select="SELECT * FROM output"),
        "attribution_ties": sql(base(truncate=True), watermarked(0), select="SELECT * FROM output"),
        "stream_exact_replay": sql(rows, watermarked(15), select="SELECT page_view_id::VARCHAR AS page_view_id, user_id::VARCHAR AS user_id, event_time, url, attributed_campaign_id, attributed_click_id::VARCHAR AS attributed_click_id FROM output"),
        "running_watermark": sql(rows, marked, select="SELECT id, p, wm_before, wm_after FROM marked"),
        "late_events": sql(rows, marked, select="SELECT id, kind, p, ts, wm_before FROM marked WHERE ts < wm_before"),
        "partition_watermarks": sql(rows, select="SELECT p AS partition_no, max(ts) AS max_event_time, epoch_us(max(ts)) // 1000 AS max_event_time_epoch_ms FROM rows GROUP BY p"),
        "global_min_watermark": sql(rows, select="SELECT min(m) AS min_event_time FROM (SELECT max(ts) AS m FROM rows GROUP BY p)"),
        "watermark_upsert": sql(rows, select="SELECT p, max(ts) AS max_event_time FROM rows GROUP BY p"),
        "pending_views": sql(rows, marked, select="SELECT id, p, user_id, ts, url FROM accepted a WHERE kind = 'view' AND ts > (SELECT max(ts) FROM rows r WHERE r.p = a.p) - INTERVAL 15 MINUTE"),
        "pending_flush": sql(rows, marked, select="""SELECT id AS page_view_id, user_id, ts AS event_time, url, won AS attributed_campaign_id, click_id AS attributed_click_id FROM (
  SELECT v.*, c.id AS click_id, c.campaign_id AS won, row_number() OVER (PARTITION BY v.id ORDER BY c.ts DESC NULLS LAST, c.id DESC) AS n
  FROM (SELECT * EXCLUDE (campaign_id) FROM accepted a WHERE kind = 'view' AND ts > (SELECT max(ts) FROM rows r WHERE r.p = a.p) - INTERVAL 15 MINUTE) v
  LEFT JOIN accepted c ON c.kind = 'click' AND c.user_id = v.user_id AND c.ts BETWEEN v.ts - INTERVAL 24 HOUR AND v.ts) WHERE n = 1"""),
        "restored_watermarks": sql(rows, select="SELECT p, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS max_event_time FROM rows GROUP BY p"),
        "output_lookup": sql(rows, day, select="SELECT * FROM output WHERE page_view_id % 10 = 0"),
        "pending_status": sql(rows, watermarked(15), select="SELECT id, user_id, ts, CASE WHEN id IN (SELECT page_view_id FROM output) THEN 'EMITTED' ELSE 'PENDING' END AS pending_status FROM accepted WHERE kind = 'view'"),
        "click_classification": sql(rows, RESENT, select="SELECT id, offset_no, arrival, campaign_id, status FROM classed WHERE kind = 'click'"),
        "first_arrival_views": sql(rows, RESENT, select="SELECT id, user_id, ts, url, offset_no, arrival FROM firsts WHERE kind = 'view'"),
        "input_ledger": sql(rows, SENT, judged("sent"), select="SELECT topic, p AS partition_no, offset_no, arrival, id AS event_key, status, processing_status FROM judged"),
        "conflict_letters": sql(rows, SENT, judged("sent"), select=f"""SELECT topic, p AS partition_no, offset_no, topic AS event_type, id AS event_key, ts AS event_time,
  json_object('user_id', user_id::VARCHAR, 'event_time', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 'campaign_id', campaign_id, 'click_id', id::VARCHAR)::VARCHAR AS payload,
  'CLICK_ID_CONFLICT' AS error_type, '{CLICK_CONFLICT_MESSAGE}' AS error_message, 1 AS attempt_count FROM judged WHERE status = 'CONFLICT'"""),
        "click_classification_stored": sql(rows, SENT, select="""SELECT s.id, s.offset_no, s.arrival, s.campaign_id, CASE WHEN f.campaign_id <> s.campaign_id THEN 'CONFLICT'
  WHEN (s.id % 4 <> 0 AND s.id % 6 <> 0) AND s.arrival = f.arrival THEN 'INSERTED' WHEN s.offset_no = f.offset_no THEN 'REPLAY' ELSE 'DUPLICATE' END AS status
  FROM sent s JOIN rows f ON f.kind = s.kind AND f.id = s.id WHERE s.kind = 'click'"""),
        "validation_split": sql(rows, envelopes(), select="""SELECT topic, "partition", "offset", CASE WHEN reason IS NULL OR reason LIKE '%is missing' THEN event_key END AS event_key, CASE WHEN reason IS NULL OR reason LIKE '%is missing' THEN good END AS event_time, reason FROM checked"""),
        "invalid_records": sql(rows, envelopes(), select="SELECT topic, 'INVALID_KAFKA_RECORD' AS error_type, reason AS error_message, count(*) AS n FROM checked WHERE reason IS NOT NULL GROUP BY topic, reason"),
        "evict_clicks": sql(rows, marked, CLICKS, select="SELECT click_id, ts, state_status FROM clicks"),
        "click_state_counts": sql(rows, marked, CLICKS, select="SELECT state_status, count(*) AS n FROM clicks GROUP BY state_status"),
        "active_clicks_scan": sql(rows, marked, CLICKS, select="SELECT user_id, ts, click_id, campaign_id FROM clicks WHERE state_status = 'ACTIVE'"),
        "archive_clicks_batch": sql(rows, marked, ARCHIVE, select="SELECT click_id, user_id, ts, campaign_id, TIMESTAMP '2024-01-20 00:00:00' AS archived_at FROM batch"),
        "archive_clicks_remaining": sql(rows, marked, ARCHIVE, select="SELECT click_id, state_status FROM state WHERE click_id NOT IN (SELECT click_id FROM batch)"),
        "archive_ledger_batch": sql(rows, LEDGER, select="SELECT *, TIMESTAMP '2024-01-20 00:00:00' AS archived_at FROM book WHERE coalesce(processed_at, received_at) < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 12 HOUR ORDER BY coalesce(processed_at, received_at), topic, partition_no, offset_no LIMIT 500"),
        "archive_ledger_remaining": sql(rows, LEDGER, "old AS (SELECT topic, partition_no, offset_no FROM book WHERE coalesce(processed_at, received_at) < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 12 HOUR ORDER BY coalesce(processed_at, received_at), topic, partition_no, offset_no LIMIT 500)", select="SELECT * FROM book ANTI JOIN old USING (topic, partition_no, offset_no)"),
        "archive_verified": sql(rows, LEDGER, select="SELECT least(500, count(*)) AS expected, least(500, count(*)) AS found, 0 AS left_behind FROM book WHERE coalesce(processed_at, received_at) < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 12 HOUR"),
        "ledger_semi_join": sql(rows, LEDGER, select="SELECT topic, partition_no, offset_no FROM book WHERE offset_no % 7 = 0"),
        "offset_replay_skip": sql(rows, LEDGER, select="SELECT topic, partition_no, offset_no FROM book WHERE offset_no % 7 <> 0"),
        "restored_clicks": sql(rows, marked, ARCHIVE, select="SELECT user_id::VARCHAR AS user_id, ts, click_id::VARCHAR AS click_id, campaign_id FROM state WHERE state_status = 'ACTIVE'"),
        "click_archive_cutoffs": sql(rows, select="SELECT p, lag, m + to_minutes(lag) - to_minutes(CASE WHEN lag < 10 THEN 30 ELSE least(3 * lag, 90) END) AS cutoff FROM (SELECT p, max(ts) AS m FROM rows GROUP BY p), (SELECT unnest([-5, 5, 10, 15, 30, 45]) AS lag)"),
        "insert_if_absent": sql(rows, day, select="SELECT * FROM output WHERE page_view_id % 3 <> 0"),
        "output_conflicts": sql(rows, day, select="SELECT page_view_id, user_id, event_time, url || '/y' AS url, attributed_campaign_id, attributed_click_id FROM output WHERE page_view_id % 9 = 0"),
        "output_validity": sql(rows, day, BROKEN, select="SELECT page_view_id, url, problem FROM checked"),
        "output_writes": sql(rows, day, BROKEN, select="SELECT page_view_id, user_id, event_time, url, attributed_campaign_id, attributed_click_id FROM winners WHERE page_view_id % 3 <> 0"),
        "retry_exhausted": sql(rows, day, BROKEN, select="""SELECT 'page_views' AS event_type, page_view_id AS event_key, event_time, 'PROCESSING_RETRY_EXHAUSTED' AS error_type, problem AS error_message, 4 AS attempt_count FROM (
  SELECT page_view_id, event_time, problem FROM checked WHERE problem IS NOT NULL
  UNION ALL SELECT c.page_view_id, c.event_time, 'page_view_id is stored with other content' FROM checked c
  JOIN (SELECT * EXCLUDE (n, problem) FROM winners WHERE page_view_id % 3 <> 0 UNION ALL SELECT page_view_id, user_id::VARCHAR, event_time, url, attributed_campaign_id, attributed_click_id FROM output WHERE page_view_id % 3 = 0) w USING (page_view_id)
  WHERE c.problem IS NULL AND (c.user_id, c.event_time, c.url, c.attributed_campaign_id, c.attributed_click_id) IS DISTINCT FROM (w.user_id, w.event_time, w.url, w.attributed_campaign_id, w.attributed_click_id))"""),
        "stream_ledger": sql(rows, SENT, envelopes("sent"), VALID, judged("valid"), select="""SELECT topic, p AS partition_no, offset_no, topic AS event_type, event_key, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS event_time, status, processing_status
  FROM (SELECT *, row_number() OVER (PARTITION BY topic, p, offset_no ORDER BY arrival) AS n FROM judged) WHERE n = 1"""),
        "stream_dead_letters": sql(rows, SENT, envelopes("sent"), VALID, judged("valid"), select=f"""SELECT topic, p AS partition_no, offset_no, topic AS event_type, event_key, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS event_time, payload, 'CLICK_ID_CONFLICT' AS error_type,
  '{CLICK_CONFLICT_MESSAGE}' AS error_message, 1 AS attempt_count FROM judged WHERE status = 'CONFLICT'
UNION ALL SELECT topic, p, offset_no, topic, CASE WHEN reason LIKE '%is missing' THEN event_key END, CASE WHEN reason LIKE '%is missing' THEN good END, value, 'INVALID_KAFKA_RECORD', reason, 1
  FROM (SELECT *, row_number() OVER (PARTITION BY topic, p, offset_no ORDER BY arrival) AS n FROM checked WHERE reason IS NOT NULL) WHERE n = 1"""),
        "stream_output": sql(rows, SENT, envelopes("sent"), VALID, judged("valid"), select="""SELECT page_view_id, user_id, strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') AS event_time, url, attributed_campaign_id, attributed_click_id FROM (
  SELECT v.event_key AS page_view_id, v.uid AS user_id, v.ts AS event_time, v.url, c.campaign_id AS attributed_campaign_id, c.event_key AS attributed_click_id,
         row_number() OVER (PARTITION BY v.id ORDER BY c.ts DESC NULLS LAST, c.event_key DESC) AS n
  FROM (SELECT j.*, (SELECT min(x.seq) FROM judged x WHERE x.p = j.p AND x.seq >= j.seq AND x.wm_after >= j.ts) AS emit_seq FROM judged j WHERE kind = 'view' AND status = 'INSERTED' AND processing_status = 'PROCESSED') v
  LEFT JOIN (SELECT * FROM judged WHERE kind = 'click' AND status = 'INSERTED' AND processing_status = 'PROCESSED') c
    ON c.user_id = v.user_id AND c.p = v.p AND c.ts BETWEEN v.ts - INTERVAL 24 HOUR AND v.ts AND c.seq <= v.emit_seq
  WHERE emit_seq IS NOT NULL) WHERE n = 1"""),
        "state_or_history_lookup": sql(rows, select="SELECT id AS click_id, user_id, CASE WHEN id % 4 <> 0 THEN campaign_id ELSE campaign_id || '_old' END AS campaign_id, CASE WHEN id % 4 <> 0 THEN 'state' ELSE 'history' END AS found_in FROM rows WHERE kind = 'click'"),
        "output_contract_json": sql(rows, day, select="SELECT json_object('page_view_id', page_view_id::VARCHAR, 'user_id', user_id::VARCHAR, 'event_time', strftime(event_time, '%Y-%m-%dT%H:%M:%SZ'), 'url', url, 'attributed_campaign_id', attributed_campaign_id, 'attributed_click_id', attributed_click_id::VARCHAR)::VARCHAR AS json FROM output"),
    }
