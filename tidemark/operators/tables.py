"""Durable tables: insert if absent, conflicts, conditional updates, state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import differs, is_blank
from ..schema import ACTIVE, EMITTED, EVICTED, LEDGER_KEY, OUTPUT, PENDING


def _first(new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the least in ``order``, then by all columns."""
    rest = [c for c in new.columns if c not in key]
    least = new.groupBy(*key).agg(F.min(F.struct(F.struct(*order, *[c for c in rest if c not in order]).alias("o"), F.struct(*rest).alias("r"))).alias("f"))
    return least.select(*key, "f.r.*").select(*new.columns)


def insert_if_absent(new: DataFrame, stored: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` whose key is not stored; of several with one key the
    first in ``order``."""
    return _first(new, key, order).join(stored.select(*key), list(key), "left_anti")


def conflicts(new: DataFrame, stored: DataFrame, key: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is stored with other content."""
    joined = new.alias("n").join(stored.alias("s"), list(key))
    return joined.where(differs("n", "s", tuple(content))).select(*[F.col(c) for c in key], *[F.col(f"n.{c}").alias(c) for c in content])


def output_problem() -> Column:
    """Why an output row may not be written, or null."""
    out = F.lit(None).cast("string")
    for c in ("page_view_id", "user_id", "url"):
        out = F.when(out.isNull() & is_blank(c), f"{c} is missing").otherwise(out)
    out = F.when(out.isNull() & F.col("event_time").isNull(), "event_time is missing").otherwise(out)
    one = is_blank("attributed_campaign_id") != is_blank("attributed_click_id")
    return F.when(out.isNull() & one, "attribution is incomplete").otherwise(out)


def write_output(new: DataFrame, stored: DataFrame, order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows to append and rows to refuse (with ``problem``): invalid ones, and
    ones that differ from the stored row of their key or from the one that is
    appended.  Rows equal to it are neither."""
    checked = new.withColumn("problem", output_problem())
    good = checked.where("problem IS NULL").drop("problem")
    append = insert_if_absent(good, stored, ["page_view_id"], order)
    winners = append.select(*OUTPUT).unionByName(stored.select(*OUTPUT))
    same = F.lit(True)
    for c in OUTPUT[1:]:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"w.{c}"))
    other = good.alias("n").join(winners.alias("w"), F.col("n.page_view_id") == F.col("w.page_view_id")).where(~same).select("n.*")
    return append, checked.where("problem IS NOT NULL").unionByName(other.withColumn("problem", F.lit("page_view_id is stored with other content")))


def output_by_id(output: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored output rows of the ids in ``page_view_id``."""
    return output.join(ids.select("page_view_id").distinct(), "page_view_id", "left_semi")


def pending_status(pending: DataFrame, output: DataFrame) -> DataFrame:
    """``pending`` with its status derived from the output table."""
    done = output.select(F.col("page_view_id").alias("id")).distinct().withColumn("_done", F.lit(True))
    return pending.join(done, "id", "left").withColumn("pending_status", F.when(F.col("_done"), EMITTED).otherwise(PENDING)).drop("_done")


def evict(clicks: DataFrame, cutoff: Column) -> DataFrame:
    """Active clicks strictly before ``cutoff`` become evicted."""
    gone = (F.col("state_status") == ACTIVE) & (F.col("ts") < cutoff)
    return clicks.withColumn("state_status", F.when(gone, EVICTED).otherwise(F.col("state_status")))


def skip_recorded(new: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events whose place in the log has no ledger row yet."""
    return new.join(ledger.select(*LEDGER_KEY), list(LEDGER_KEY), "left_anti")


def latest_ledger(current: DataFrame, history: DataFrame) -> DataFrame:
    """Ledger rows of both tables, for look-ups past retention."""
    return current.unionByName(history.drop("archived_at"), allowMissingColumns=True).dropDuplicates(list(LEDGER_KEY))


def restored_clicks(clicks: DataFrame) -> DataFrame:
    """Active clicks for a restart, in order; a broken row fails the restart
    rather than being left out."""
    broken = is_blank("click_id") | is_blank("user_id") | is_blank("campaign_id") | F.col("ts").isNull()
    checked = active_clicks(clicks).withColumn("user_id", F.when(broken, F.raise_error(F.lit("click state holds a row without id, user, campaign or time"))).otherwise(F.col("user_id")))
    return checked.orderBy("user_id", "ts", "click_id")


def active_clicks(clicks: DataFrame) -> DataFrame:
    return clicks.where(F.col("state_status") == ACTIVE)
