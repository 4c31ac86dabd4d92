"""Running aggregates in two levels.

A window over a whole message-log partition is one task, and there are few
partitions.  Here rows are cut into chunks along their order; a window runs in
each chunk, a second one over one row for each chunk, and both are combined.
Chunks are stretches of equal length, as many as hold ``CHUNK_ROWS`` rows each
on average; the length comes from one pass that reads nothing but the order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of all partitions together in a chunk, on average.
CHUNK_ROWS = 1_000_000


def _number(rows: DataFrame, x: str) -> Column:
    """A number that grows with ``x``; times count microseconds."""
    kind = dict(rows.dtypes)[x]
    if kind == "timestamp":
        return F.unix_micros(x)
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{x}`)")
    return F.col(x).cast("double") if kind in ("float", "double") else F.col(x).cast("long")


def chunks(rows: DataFrame, by: str) -> Callable[[DataFrame, str], Column]:
    """A function that gives the chunk of a column of the kind of ``by``, which
    doesn't decrease along it."""
    at = _number(rows, by)
    n, low, high = rows.agg(F.count("*"), F.min(at), F.max(at)).first()
    parts = math.ceil(n / CHUNK_ROWS)
    if parts < 2 or low == high:
        return lambda df, x: F.lit(0)
    width = max(1, math.ceil((high - low + 1) / parts))
    return lambda df, x: F.floor((_number(df, x) - F.lit(low)) / F.lit(width))


def with_running_max(rows: DataFrame, name: str, value: Column, keys: Sequence[str], order: Sequence[str], inclusive: bool = False) -> DataFrame:
    """Adds ``name``: the maximum of ``value`` over the rows before each one
    (and itself, if ``inclusive``) in ``order`` inside ``keys``."""
    cut = rows.withColumn("_chunk", chunks(rows, order[0])(rows, order[0])).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    over = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = cut.groupBy(*keys, "_chunk").agg(F.max("_v").alias("_m")).select(*keys, "_chunk", F.max("_m").over(over).alias("_carry"))
    out = cut.withColumn("_local", F.max("_v").over(inside)).join(carry, [*keys, "_chunk"])
    return out.withColumn(name, F.greatest("_local", "_carry")).drop("_chunk", "_v", "_m", "_local", "_carry")


def with_min_from(rows: DataFrame, name: str, value: Column, at: Column, keys: Sequence[str]) -> DataFrame:
    """Adds ``name``: the minimum of ``value`` over rows whose ``ts`` is ``at``
    or later."""
    probes = rows.withColumn("_at", at)
    steps = rows.select(*keys, F.col("ts").alias("_at"), value.alias("_v")).groupBy(*keys, "_at").agg(F.min("_v").alias("_v"))
    both = probes.withColumn("_v", F.lit(None).cast(steps.schema["_v"].dataType)).withColumn("_row", F.lit(True)).unionByName(steps.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("_chunk", chunks(rows, "ts")(both, "_at"))
    # backwards: a frame that grows with the rows is one pass, one that shrinks is a pass for each row
    after = Window.partitionBy(*keys, "_chunk").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = both.groupBy(*keys, "_chunk").agg(F.min("_v").alias("_m")).select(*keys, "_chunk", F.min("_m").over(later).alias("_carry"))
    out = both.withColumn("_local", F.min("_v").over(after)).where("_row").join(carry, [*keys, "_chunk"])
    return out.withColumn(name, F.least("_local", "_carry")).drop("_at", "_v", "_row", "_chunk", "_local", "_carry")
