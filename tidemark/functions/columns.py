"""Column expressions used throughout the engine; all JVM-side."""

from __future__ import annotations

import tempfile
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CLICKS_TOPIC, TIME_FORMAT, VIEWS_TOPIC


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_blank(x: str | Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(col(x).rlike("^[\\s\\p{Z}]*$"), F.lit(True))


def text_is_blank(x: str | None) -> bool:
    """The same of a Python string."""
    return x is None or all(c.isspace() or unicodedata.category(c).startswith("Z") for c in x)


def minutes(n: int) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' MINUTE")


def parse_time(x: str | Column) -> Column:
    """An event time, or null where the text isn't one."""
    return F.try_to_timestamp(col(x), F.lit(TIME_FORMAT))


def format_time(x: str | Column) -> Column:
    return F.date_format(col(x), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_ms(x: str | Column) -> Column:
    return F.unix_millis(col(x).cast("timestamp"))


def from_epoch_ms(x: str | Column) -> Column:
    """The time that ``epoch_ms`` stored, to the millisecond."""
    return F.timestamp_millis(col(x))


def differs(left: str, right: str, columns: tuple[str, ...]) -> Column:
    """Whether any of ``columns`` differs, nulls being equal to nulls."""
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def event_type(topic: str | Column) -> Column:
    """The event type of a topic; an unknown topic is its own type."""
    t = col(topic)
    return F.when(t == CLICKS_TOPIC, CLICKS_TOPIC).when(t == VIEWS_TOPIC, VIEWS_TOPIC).otherwise(t)


def click_archive_minutes(lag_minutes: Column) -> Column:
    """How long evicted clicks are kept, by watermark lag: 30 below 10 minutes
    of lag, else three times the lag, 90 at most."""
    lag = F.greatest(lag_minutes, F.lit(0))
    return F.when(lag < 10, 30).otherwise(F.least(3 * lag, F.lit(90)))


def click_archive_cutoff(now: Column, watermark: Column) -> Column:
    """Evicted clicks strictly before it are archived; a watermark ahead of the
    clock counts as no lag, and a lag counts in whole minutes."""
    lag = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(watermark.cast("timestamp"))) / 60_000_000)
    kept = click_archive_minutes(F.coalesce(lag, F.lit(0)))
    return now - F.make_dt_interval(F.lit(0), F.lit(0), kept.cast("int"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.  Where a session
    names none (``spark.checkpoint.dir``), one machine's own folder does for a
    local master only; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and stored in the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
