"""Replays, duplicates and conflicts of ids, against the first arrival.

The horizon is unlimited.  The first row of an id comes from a grouped minimum
(combined before the shuffle), so an id that is sent very often is no skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CONFLICT, DUPLICATE, INSERTED, REPLAY

CLICK_CONTENT = ("user_id", "ts", "campaign_id")
VIEW_CONTENT = ("user_id", "ts", "url")


def classify(rows: DataFrame, content: Sequence[str], order: Sequence[str] = ("arrival", "offset_no"), stored: DataFrame | None = None) -> DataFrame:
    """Adds ``status``: INSERTED for the first arrival of an id, else REPLAY
    (same content and place in the log), DUPLICATE (same content) or CONFLICT.

    ``stored`` (``id, p, offset_no`` and the content; of state and history) holds
    ids known before: its row of an id is the first, and none of ``rows`` is.
    """
    key = [*order, "p"]
    named = dict.fromkeys([*key, "offset_no", *content])
    kinds = dict(rows.dtypes)
    first = rows.groupBy("id").agg(F.min(F.struct(*named)).alias("first"))
    if stored is not None:
        absent = [c for c in order if c not in stored.columns]
        known = stored.select("id", F.struct(*[F.lit(None).cast(kinds[c]).alias(c) if c in absent else F.col(c).cast(kinds[c]).alias(c) for c in named]).alias("known"))
        first = first.join(known, "id", "left").select("id", F.coalesce("known", "first").alias("first"), F.col("known").isNotNull().alias("was"))
    joined = rows.join(first, "id")
    same = F.lit(True)
    for c in content:
        same = same & F.col(c).eqNullSafe(F.col(f"first.{c}"))
    place = (F.col("p") == F.col("first.p")) & (F.col("offset_no") == F.col("first.offset_no"))
    is_first = place if stored is None else place & ~F.col("was")
    for c in order:
        is_first = is_first & F.col(c).eqNullSafe(F.col(f"first.{c}"))
    status = F.when(is_first & same, INSERTED).when(~same, CONFLICT).when(place, REPLAY).otherwise(DUPLICATE)
    return joined.withColumn("status", status).drop("first", "was")


def first_arrivals(rows: DataFrame, order: Sequence[str] = ("arrival", "offset_no")) -> DataFrame:
    """One row for each id: the first in ``order``."""
    rest = [c for c in rows.columns if c != "id"]
    first = rows.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select("id", "r.*")


def lookup_with_history(state: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """One row for each key of either table, the state's if it has one."""
    both = state.withColumn("found_in", F.lit("state")).unionByName(history.withColumn("found_in", F.lit("history")), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(F.col("found_in").desc())
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
