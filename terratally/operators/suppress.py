"""Greedy overlap suppression without overlap pairs.

Boxes with an IoU over ``t`` differ in size by less than ``1/t``, so their size levels (powers of two) are at most ``log2(1/t)``
apart, rounded up, and their centres lie in the same or in neighbouring cells of the coarser level's grid. That is used
three times: a sweep inside a task looks for kept boxes in such cells only; occupied cells, not boxes, are linked to
clusters; and kept boxes find what they suppress. Kept boxes do not overlap each other, so a cell holds few of them,
and m shifted copies of one object cost m look-ups.
"""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from terratally.operators.regions import contract
from terratally.session import by_key, cut_lineage, ship_package

#: Boxes that one task sweeps, about.
SWEEP = 200_000
#: Boxes of a group up to which the sweep compares with all kept ones.
FEW = 48
BOX = ["image_id", "cls_id", "box_idx", "conf", "x1", "y1", "x2", "y2"]


def levels_apart(threshold: float) -> int:
    return max(0, math.ceil(math.log2(1.0 / max(threshold, 2.0**-30))))


def _iou_over(a, b, threshold: float) -> bool:
    iw, ih = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if iw <= 0.0 or ih <= 0.0:
        return False
    inter = iw * ih
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter) > threshold


def swept(boxes: list[tuple], threshold: float, apart: int) -> list[int]:
    """Positions of the kept boxes among ``boxes`` (x1, y1, x2, y2), the best first."""
    kept = []
    if len(boxes) <= FEW:
        for i, b in enumerate(boxes):
            if not any(_iou_over(boxes[j], b, threshold) for j in kept):
                kept.append(i)
        return kept
    cells = {}
    for i, b in enumerate(boxes):
        own = math.frexp(max(b[2] - b[0], b[3] - b[1]))[1]
        cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
        gone = False
        for lv in range(own, own + apart + 1):
            w = 2.0**lv
            gx, gy = math.floor(cx / w), math.floor(cy / w)
            for x in (gx - 1, gx, gx + 1):
                for y in (gy - 1, gy, gy + 1):
                    for k, j in cells.get((lv, x, y), ()):
                        # a pair meets on the coarser of its two levels
                        if (lv == own or k == lv) and _iou_over(boxes[j], b, threshold):
                            gone = True
                            break
                    if gone:
                        break
                if gone:
                    break
            if gone:
                break
        if not gone:
            kept.append(i)
            for lv in range(own, own + apart + 1):
                w = 2.0**lv
                cells.setdefault((lv, math.floor(cx / w), math.floor(cy / w)), []).append((own, i))
    return kept


def sweep(threshold: float, columns: list[str]):
    """Function from boxes that overlap none outside to the kept ones, with ``columns`` of theirs."""
    apart = levels_apart(threshold)

    def run(t: pa.Table) -> pa.Table:
        col = {c: t.column(c).to_numpy() for c in BOX}
        order = np.lexsort((col["box_idx"], -col["conf"], col["cls_id"], col["image_id"]))
        image, cls = col["image_id"][order], col["cls_id"][order]
        new = np.append(np.flatnonzero((np.diff(image, prepend=image[0] - 1) != 0) | (np.diff(cls, prepend=cls[0] - 1) != 0)), len(order))
        rect = list(zip(*[col[c][order].tolist() for c in ("x1", "y1", "x2", "y2")]))
        kept = []
        for a, b in zip(new[:-1], new[1:]):
            kept += [int(a) + k for k in swept(rect[a:b], threshold, apart)] if b - a > 1 else [int(a)]
        return t.select(columns).take(pa.array(order[kept]))

    return run


def _leveled(boxes: DataFrame, apart: int) -> DataFrame:
    """One row per level from the box's own to ``apart`` above, with the cell of its centre."""
    own = (F.floor(F.log2(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))) + 1).cast("int")
    df = boxes.withColumn("_own", own).withColumn("_lv", F.explode(F.sequence(F.col("_own"), F.col("_own") + apart)))
    w = F.pow(F.lit(2.0), F.col("_lv"))
    return df.withColumns({"_gx": F.floor((F.col("x1") + F.col("x2")) / 2 / w), "_gy": F.floor((F.col("y1") + F.col("y2")) / 2 / w)})


def _around(df: DataFrame) -> DataFrame:
    """The nine cells around each."""
    for c in ("_gx", "_gy"):
        df = df.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    return df


KEY = ["image_id", "cls_id"]
CELL = [*KEY, "_lv", "_gx", "_gy"]


def clustered(boxes: DataFrame, threshold: float) -> DataFrame:
    """``boxes`` with ``cluster``: boxes of different clusters of an image and class do not overlap.

    Occupied cells are linked with their parents and occupied neighbours, and the links are contracted.
    """
    node = F.xxhash64("_lv", "_gx", "_gy")  # a clash only makes a cluster larger
    at = _leveled(boxes, levels_apart(threshold))
    cells = cut_lineage(at.select(*CELL, (F.col("_lv") == F.col("_own")).alias("own"), (F.col("_lv") - F.col("_own") < levels_apart(threshold)).alias("up")).groupBy(*CELL).agg(F.max("own").alias("own"), F.max("up").alias("up")))
    near = _around(cells.where("own").select(*CELL, node.alias("u"))).join(by_key(cells.select(*CELL, node.alias("v"))), CELL)
    parent = F.xxhash64(F.col("_lv") + 1, F.floor(F.col("_gx") / 2), F.floor(F.col("_gy") / 2))
    links = near.select(*KEY, "u", "v").unionByName(cells.where("up").select(*KEY, node.alias("u"), parent.alias("v")))
    roots = contract(links, KEY).select(*KEY, F.col("lab").alias("_node"), "root")
    own = at.where("_lv = _own").withColumn("_node", node).drop("_own", "_lv", "_gx", "_gy")
    return own.join(by_key(roots), [*KEY, "_node"], "left").withColumn("cluster", F.coalesce("root", "_node")).drop("root", "_node")


def _over(threshold: float) -> Column:
    iw = F.least("x2", "k_x2") - F.greatest("x1", "k_x1")
    ih = F.least("y2", "k_y2") - F.greatest("y1", "k_y1")
    inter = F.greatest(iw, F.lit(0.0)) * F.greatest(ih, F.lit(0.0))
    union = (F.col("k_x2") - F.col("k_x1")) * (F.col("k_y2") - F.col("k_y1")) + (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) - inter
    return inter / union > threshold


def unsuppressed(boxes: DataFrame, kept: DataFrame, threshold: float) -> DataFrame:
    """The boxes that no kept one overlaps."""
    apart = levels_apart(threshold)
    k = _around(_leveled(kept.select(*KEY, "x1", "y1", "x2", "y2"), apart)).select(
        *CELL, F.col("_own").alias("k_own"), *[F.col(c).alias(f"k_{c}") for c in ("x1", "y1", "x2", "y2")])
    hit = _leveled(boxes.select(*KEY, "box_idx", "x1", "y1", "x2", "y2"), apart).join(by_key(k), CELL).where(
        (F.col("_lv") == F.greatest("_own", "k_own")) & _over(threshold)).select(*KEY, "box_idx").distinct()
    return boxes.join(by_key(hit), [*KEY, "box_idx"], "left_anti")


def best_first(boxes: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The best boxes of each cluster, about ``block`` of them, and the others.

    The cut is a confidence; where boxes of the best confidence alone are too many, it is an index among those.
    """
    key = [*KEY, "cluster"]
    share = F.greatest(F.lit(0.0), 1.0 - F.lit(float(block)) / F.count(F.lit(1)))
    cut = boxes.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), share.alias("share"), F.max("conf").alias("top"), F.percentile_approx("conf", F.array(*[F.lit(i / 64) for i in range(64)]), 10000).alias("marks"))
    # the highest mark that leaves about a block above it
    cut = cut.select(*key, "top", F.when(F.col("n") > block, F.col("marks")[F.floor(F.col("share") * 64).cast("int")]).alias("low"))
    tied = boxes.join(by_key(cut), key).where("conf = top").groupBy(*key).agg(F.count(F.lit(1)).alias("ties"), F.percentile_approx("box_idx", F.array(*[F.lit(i / 64) for i in range(64)]), 10000).alias("marks"))
    tied = tied.select(*key, F.when(F.col("ties") > block, F.col("marks")[F.ceil(F.lit(64.0 * block) / F.col("ties")).cast("int") - 1]).alias("last"))
    both = boxes.join(by_key(cut.join(by_key(tied), key)), key)
    ahead = F.when(F.col("last").isNotNull(), (F.col("conf") == F.col("top")) & (F.col("box_idx") <= F.col("last"))).otherwise(
        F.coalesce((F.col("conf") > F.col("low")) | (F.col("conf") == F.col("top")), F.lit(True)))
    return tuple(both.where(c).drop("top", "low", "last") for c in (ahead, ~ahead))


def suppress(boxes: DataFrame, threshold: float, limit: int | None = None, carry: list[str] = (), written: bool = False) -> DataFrame:
    """The boxes (image_id, cls_id, box_idx, conf and corners, each with an area) that greedy suppression keeps, with the columns ``carry``.

    Groups of an image and class that a task can hold are swept there, many small ones together. Larger groups are split
    into clusters first. A cluster that is still too large goes in blocks of ranks: its best block is swept, what the
    kept boxes overlap goes, and the next block follows; the number of rounds follows the size of the largest cluster
    over ``limit``, however long chains of overlaps are. ``written``: the boxes are read from a written table.
    """
    limit = limit or SWEEP
    ship_package(boxes.sparkSession)
    columns = [*BOX, *carry]
    boxes = boxes.select(*columns) if written else cut_lineage(boxes.select(*columns))
    groups = boxes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    total, most = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    out = boxes.limit(0).schema

    def by(df: DataFrame, *key) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*key), F.lit(max(1, math.ceil(total / limit), df.sparkSession.sparkContext.defaultParallelism if total > 1000 else 1)))
        return df.groupBy(bucket.alias("bucket")).applyInArrow(sweep(threshold, columns), out)

    if most <= limit:
        return by(boxes, *KEY)
    large = groups.where(F.col("n") > limit).select(*KEY)
    kept = [by(boxes.join(large, KEY, "left_anti"), *KEY)]
    parts = cut_lineage(clustered(boxes.join(large, KEY, "left_semi"), threshold))
    sizes = parts.groupBy(*KEY, "cluster").agg(F.count(F.lit(1)).alias("n"))
    huge = sizes.where(F.col("n") > limit).select(*KEY, "cluster")
    kept.append(by(parts.join(huge, [*KEY, "cluster"], "left_anti"), *KEY, "cluster"))
    left = cut_lineage(parts.join(huge, [*KEY, "cluster"], "left_semi"))
    while not left.isEmpty():
        now, later = best_first(left, limit)
        stay = cut_lineage(now.groupBy(*KEY, "cluster").applyInArrow(sweep(threshold, columns), out))
        kept.append(stay)
        left = cut_lineage(unsuppressed(later, stay, threshold))
    return reduce(DataFrame.unionByName, kept)
