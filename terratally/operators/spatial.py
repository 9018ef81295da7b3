"""Rectangle overlap joins.

Rectangles meet on the cells of grids (32, 128, 512, ... wide, up to more than 100 million)
instead of on their image alone, so an image that holds a large share of all rows is spread
over its cells and only neighbours are ever compared. A rectangle has a grid as wide as
itself, so it covers at most four cells of it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terratally.session import by_key

BASE, STEP, LEVELS = 32.0, 4.0, 12


def _level(extent: Column) -> Column:
    """Finest grid whose cells are at least as wide as the rectangle."""
    out = F.lit(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        out = F.when(extent <= BASE * STEP ** i, i).otherwise(out)
    return out


def _width(level: Column) -> Column:
    out = F.lit(BASE * STEP ** (LEVELS - 1))
    for i in reversed(range(LEVELS - 1)):
        out = F.when(level == i, BASE * STEP ** i).otherwise(out)
    return out


def _cells(df: DataFrame, rect: list[str], up: int) -> DataFrame:
    """One row per cell the rectangle touches, on its own grid and ``up`` coarser ones."""
    x0, y0, x1, y1 = (F.col(c) for c in rect)
    df = df.withColumn("_own", _level(F.greatest(x1 - x0, y1 - y0)))
    df = df.withColumn("_lv", F.explode(F.sequence(F.col("_own"), F.least(F.col("_own") + up, F.lit(LEVELS - 1)))))
    df = df.withColumn("_w", _width(F.col("_lv")))
    for name, a, b in (("_gx", x0, x1), ("_gy", y0, y1)):
        w = F.col("_w")
        df = df.withColumn(name, F.explode(F.sequence(F.floor(a / w), F.floor(b / w))))
    return df


def rect_join(left: DataFrame, right: DataFrame, keys: list[str], up: int = LEVELS) -> DataFrame:
    """Every pair of overlapping rectangles (bounds inclusive) with equal ``keys``, once.

    Rectangles are ``l_x0, l_y0, l_x1, l_y1`` and ``r_x0, ...``; other columns of the two
    sides must have different names. A pair meets on the coarser of the two own grids, in
    the one cell that holds the upper left corner of the overlap.
    """
    lc = _cells(left, ["l_x0", "l_y0", "l_x1", "l_y1"], up).withColumnRenamed("_own", "_lown")
    rc = _cells(right, ["r_x0", "r_y0", "r_x1", "r_y1"], up).withColumnRenamed("_own", "_rown").drop("_w")
    on = [*keys, "_lv", "_gx", "_gy"]
    left_edge = F.greatest("l_x0", "r_x0")
    top_edge = F.greatest("l_y0", "r_y0")
    return (
        lc.join(by_key(rc), on)
        .where(
            (F.col("_lv") == F.greatest("_lown", "_rown"))
            & (F.col("l_x0") <= F.col("r_x1")) & (F.col("r_x0") <= F.col("l_x1"))
            & (F.col("l_y0") <= F.col("r_y1")) & (F.col("r_y0") <= F.col("l_y1"))
            & (F.floor(left_edge / F.col("_w")) == F.col("_gx"))
            & (F.floor(top_edge / F.col("_w")) == F.col("_gy"))
        )
        .drop("_lv", "_gx", "_gy", "_w", "_lown", "_rown")
    )
