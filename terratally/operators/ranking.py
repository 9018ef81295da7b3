"""Running numbers and carried values that stay spread out when one group is huge."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from terratally.session import TASK_ROWS, by_key, dealt


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str, start: int = 1, parts: int | None = None) -> DataFrame:
    """Number rows 1, 2, ... within ``keys`` in ``(bucket, order)`` order.

    ``bucket`` must not decrease along the order. Rows are ranked inside a bucket and
    shifted by the size of the buckets before it, so no task sorts a whole group; only
    the small table of bucket sizes is ordered per group. ``parts``: over how many partitions rows and
    sizes are dealt out, if not the session's number.
    """
    df = dealt(df.withColumn("_b", bucket), parts, *keys, "_b")
    sizes = dealt(df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")), parts, *keys)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    return (
        df.withColumn("_r", local)
        .join(by_key(offsets), [*keys, "_b"])
        .withColumn(name, (F.col("_r") + F.col("_off") + (start - 1)).cast("int"))
        .drop("_b", "_r", "_off")
    )


def crowded(df: DataFrame, keys: list[str], rows: int, limit: int = TASK_ROWS) -> Column | None:
    """Condition for the rows of all groups with more than ``limit`` rows, and perhaps of some others; None if there are no such rows.

    ``rows``: of ``df``. Groups are counted by slots of their hash, of which each holds an eighth of ``limit`` on average.
    """
    if rows <= limit:
        return None
    slot = F.pmod(F.xxhash64(*keys), F.lit(max(1024, 8 * rows // limit)))
    full = [r[0] for r in df.groupBy(slot.alias("slot")).count().where(F.col("count") > limit).select("slot").collect()]
    return slot.isin(full) if full else None


def carry_last(df: DataFrame, keys: list[str], order: str, cols: list[str], block: int = 4096) -> DataFrame:
    """Fill nulls in ``cols`` with the last known value of the group, in ``order``.

    ``order`` is a whole number. The group is cut into blocks of ``block`` positions:
    the last value of every block is carried over the short block table first.
    """
    df = df.withColumn("_blk", F.floor(F.col(order) / block))
    vals = F.struct(*cols)
    known = F.when(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cols]), vals)
    tails = df.groupBy(*keys, "_blk").agg(F.max_by(vals, F.when(known.isNotNull(), F.col(order))).alias("_tail"))
    prev = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    heads = tails.select(*keys, "_blk", F.last("_tail", ignorenulls=True).over(prev).alias("_head"))
    run = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_cur", F.last(known, ignorenulls=True).over(run)).join(by_key(heads), [*keys, "_blk"])
    out = out.withColumn("_cur", F.coalesce("_cur", "_head"))
    for c in cols:
        out = out.withColumn(c, F.col("_cur")[c])
    return out.drop("_blk", "_cur", "_head")
