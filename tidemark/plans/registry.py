"""Queries of the attribution engine and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle, queries as q

NAMES = (
    "attribution_asof_30m",
    "attribution_asof_24h",
    "attribution_join_form",
    "attribution_watermarked",
    "attribution_ties",
    "running_watermark",
    "late_events",
    "partition_watermarks",
    "restored_watermarks",
    "global_min_watermark",
    "watermark_upsert",
    "pending_views",
    "pending_flush",
    "pending_status",
    "click_classification",
    "click_classification_stored",
    "first_arrival_views",
    "input_ledger",
    "conflict_letters",
    "validation_split",
    "invalid_records",
    "evict_clicks",
    "click_state_counts",
    "active_clicks_scan",
    "archive_clicks_batch",
    "archive_clicks_remaining",
    "archive_ledger_batch",
    "archive_ledger_remaining",
    "archive_verified",
    "ledger_semi_join",
    "offset_replay_skip",
    "restored_clicks",
    "click_archive_cutoffs",
    "insert_if_absent",
    "output_conflicts",
    "output_lookup",
    "output_validity",
    "output_writes",
    "retry_exhausted",
    "state_or_history_lookup",
    "output_contract_json",
    "stream_exact_replay",
    "stream_ledger",
    "stream_dead_letters",
    "stream_output",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(q, name) for name in NAMES}


def oracle_sql() -> dict[str, str]:
    known = queries()
    return {k: v for k, v in oracle.oracle_sql().items() if k in known}
