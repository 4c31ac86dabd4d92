"""Archival: evicted clicks and old ledger rows move to history in batches."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ACTIVE, LEDGER_KEY


class Move(NamedTuple):
    moved: DataFrame
    """Rows for the history table."""
    remaining: DataFrame
    """What the live table keeps."""

    def verified(self, live: DataFrame) -> Move:
        """Fails unless every row is in exactly one of both parts."""
        n, m, r = live.count(), self.moved.count(), self.remaining.count()
        if n != m + r:
            raise RuntimeError(f"{n} rows, but {m} to move and {r} to keep")
        return self


def archived_counts(move: Move, history: DataFrame, key: Sequence[str]) -> DataFrame:
    """``expected, found, left_behind``: rows to move, those of them that the
    history holds, and those that the live table still holds.  A move is
    complete if the first two agree and the last is 0."""
    keys = move.moved.select(*key)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    expected, found = n(keys, "expected"), n(history.join(keys, list(key), "left_semi"), "found")
    return expected.select("expected", found.scalar().alias("found"), n(move.remaining.join(keys, list(key), "left_semi"), "left_behind").scalar().alias("left_behind"))


def _move(live: DataFrame, eligible: Column, order: Sequence, key: Sequence[str], batch_size: int, now: Column) -> Move:
    if batch_size <= 0:
        raise ValueError(f"batch_size must be positive, not {batch_size}")
    batch = live.where(eligible).orderBy(*order).limit(batch_size)
    return Move(batch.withColumn("archived_at", now), live.join(batch.select(*key), list(key), "left_anti"))


def archive_clicks(clicks: DataFrame, cutoff: Column, now: Column, batch_size: int = 500) -> Move:
    """The oldest clicks that aren't active and lie strictly before ``cutoff``."""
    eligible = (F.col("state_status") != ACTIVE) & (F.col("ts") < cutoff)
    move = _move(clicks, eligible, ["ts", "click_id"], ["click_id"], batch_size, now)
    return Move(move.moved.drop("state_status"), move.remaining)


def archive_ledger(ledger: DataFrame, now: Column, batch_size: int = 500, retention_hours: int = 12) -> Move:
    """The oldest ledger rows, by processing or else receipt, past retention."""
    at = F.coalesce("processed_at", "received_at")
    cutoff = now - F.expr(f"INTERVAL '{int(retention_hours)}' HOUR")
    return _move(ledger, at < cutoff, [at, *LEDGER_KEY], LEDGER_KEY, batch_size, now)
