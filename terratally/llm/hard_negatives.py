"""Hard negatives by Strassen products of anchor and candidate tiles.

Anchors and candidates meet as (anchor group, candidate part) tiles of fixed size. A tile's scores come from Strassen's
recursion on int64 matrices: odd sides are padded with zeros, seven half-size products are combined by whole-number
additions, and the padding is cut off again. Additions and products modulo 2^64 commute with the recursion, so a score
that fits 64 bits is exact whatever the parts between were; where one may not fit, the same recursion runs on Python's
whole numbers and ends at the 64-bit limits.

Two passes. The first multiplies anchors with the rows of their own label and keeps a heap of the best positives per
anchor. The second multiplies anchors with all rows and keeps, per anchor and positive, a heap of the best rows of other
labels inside the positive's score window. Heaps are short sorted lists: a tile's sub-tiles merge theirs inside the
task, and the tiles of one anchor merge theirs in a ranked window. Parts are dealt by vec_id, so a label with a third of
all rows is spread like any other.

Rows without id, label or vector, and rows with null or non-finite components, take no part. Only vectors of the same
length are compared. Rows with the anchor's id are its own and no partners; a repeated anchor id asks once, with its
smallest (label, vector). Candidates that repeat an id each count. Equal scores go by smaller id. Without positives or
without negatives in the window there are no rows; an empty table gives none.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terratally.llm.common import parts_for, ship_package, written

#: Candidates of a part, anchors of a group, anchors of a sub-tile, and the side below which matrices multiply directly.
PART, GROUP, ROWS, LEAF = 4096, 8192, 512, 16
EXACT = 2.0**53
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def largest(a: np.ndarray) -> float:
    return max(float(a.max()), -float(a.min())) if a.size else 0.0


def multiplied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype != object and largest(a) * largest(b) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two whole-number matrices."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= leaf:
        return multiplied(a, b)
    a = np.pad(a, ((0, n % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, m % 2)))
    r, s, t = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * r, 2 * t), p1.dtype)
    out[:r, :t], out[:r, t:] = p1 + p4 - p5 + p7, p3 + p5
    out[r:, :t], out[r:, t:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:n, :m]


def whole(a: np.ndarray) -> np.ndarray:
    """Whole-valued doubles as int64, or as Python's whole numbers where that is too small."""
    if largest(a) < 2.0**63:
        return a.astype(np.int64)
    return np.array([[int(x) for x in row] for row in a], object).reshape(a.shape)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b`` as int64; beyond 64 bits they end at the limits."""
    if largest(a) * largest(b) * a.shape[1] < 2.0**62:
        return strassen(whole(a), whole(b).T)
    wide = strassen(whole(a).astype(object), whole(b).astype(object).T)
    return np.clip(wide, LOWEST + 1, HIGHEST).astype(np.int64)


def heap_of(s: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k best allowed (score, id); ``ids`` rise, so the first of equal scores has the smallest id."""
    left = np.where(allowed, s, LOWEST)
    k = min(k, s.shape[1])
    best, at, rows = np.empty((len(s), k), np.int64), np.empty((len(s), k), np.int64), np.arange(len(s))
    for i in range(k):
        j = left.argmax(axis=1)
        best[:, i], at[:, i] = left[rows, j], ids[j]
        left[rows, j] = LOWEST
    return best, at


def vectors_of(t: pa.Table) -> np.ndarray:
    v = t.column("v").combine_chunks()
    return np.asarray(v.flatten()).reshape(len(v), -1)


def column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def in_id_order(t: pa.Table) -> pa.Table:
    return t.take(pa.array(np.argsort(column(t, "vec_id"), kind="stable")))


POSITIVES = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
NEGATIVES = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()),
                       ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def usable(vectors: DataFrame, label: Column, scale: float) -> DataFrame:
    """vec_id, label and the floored components as doubles."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select("vec_id", label.cast("long").alias("label"), x.alias("x"), F.coalesce(bad, F.lit(True)).alias("bad"))
    rows = rows.where(~F.col("bad") & F.col("vec_id").isNotNull() & F.col("label").isNotNull())

    def floored(batches):
        for b in batches:
            x = b.column("x")
            values = np.floor(np.asarray(x.flatten()) * scale)
            offsets = np.concatenate([[0], np.cumsum(np.asarray(x.value_lengths()), dtype=np.int32)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["vec_id", "label", "v"])

    return rows.select("vec_id", "label", "x").mapInArrow(floored, "vec_id long, label long, v array<double>")


def spread(df: DataFrame, name: str, n: int) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def mine(vectors: DataFrame, anchors, label: Column | None = None, positives: int = 5, negatives: int = 3,
         window: tuple[int, int] = (50, 95), scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``anchors``: condition on vec_id; ``label``: the label to use; ``window``: least and largest hundredths of the
    positive's score that a negative may have.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = written(usable(vectors, F.col("label") if label is None else label, scale), "vectors")
    n, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(anchors, 1))).first()
    parts, groups = parts_for(n, PART), parts_for(asked, GROUP)
    size = F.size("v").alias("size")
    cand = rows.select("vec_id", "label", "v", size, F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"))
    asking = rows.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select(
        "vec_id", "m.label", "m.v", F.size("m.v").alias("size"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("grp"))
    low, high = window

    def best_positives(a: pa.Table, c: pa.Table) -> pa.Table:
        if not a.num_rows or not c.num_rows:
            return POSITIVES.empty_table()
        c = in_id_order(c)
        ids, cv, av, own = column(c, "vec_id"), vectors_of(c), vectors_of(a), column(a, "vec_id")
        out = []
        for i in range(0, len(own), ROWS):
            mine_, s = own[i:i + ROWS], scores(av[i:i + ROWS], cv)
            best, at = heap_of(s, ids, ids[None, :] != mine_[:, None], positives)
            real = best > LOWEST
            out.append(pa.table([np.repeat(mine_, real.sum(axis=1)), at[real], best[real]], schema=POSITIVES))
        return pa.concat_tables(out)

    keys = ["label", "size", "part", "grp"]
    found = spread(asking, "part", parts).groupBy(*keys).cogroup(spread(cand, "grp", groups).groupBy(*keys)).applyInArrow(
        best_positives, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    heaps = chosen.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("heap"))
    with_windows = written(asking.join(heaps, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "v", "size", "grp", F.col("heap.positive_id").alias("p_id"), F.col("heap.positive_score").alias("p_score")), "positives")

    def best_negatives(a: pa.Table, c: pa.Table) -> pa.Table:
        if not a.num_rows or not c.num_rows:
            return NEGATIVES.empty_table()
        c = in_id_order(c)
        ids, labels, cv, av = column(c, "vec_id"), column(c, "label"), vectors_of(c), vectors_of(a)
        own, own_label, p_ids, p_scores = column(a, "vec_id"), column(a, "label"), a.column("p_id").to_pylist(), a.column("p_score").to_pylist()
        out = []
        for i in range(0, len(own), ROWS):
            some = slice(i, i + ROWS)
            s = scores(av[some], cv)
            other = labels[None, :] != own_label[some][:, None]
            for place in range(positives):
                at = np.array([j for j, p in enumerate(p_scores[some]) if len(p) > place], np.int64)
                if not len(at):
                    break
                pid = np.array([p_ids[i + j][place] for j in at], np.int64)
                p = [p_scores[i + j][place] for j in at]
                least = np.array([min(max(-(-low * x // 100), LOWEST), HIGHEST) for x in p], np.int64)
                most = np.array([min(max(high * x // 100, LOWEST), HIGHEST) for x in p], np.int64)
                part = s[at]
                inside = other[at] & (part >= least[:, None]) & (part <= most[:, None])
                best, neg = heap_of(part, ids, inside, negatives)
                real = best > LOWEST
                reps = real.sum(axis=1)
                out.append(pa.table([np.repeat(own[some][at], reps), np.full(int(reps.sum()), place + 1, np.int32), np.repeat(pid, reps),
                                     np.repeat(np.array(p, np.int64), reps), neg[real], best[real]], schema=NEGATIVES))
        return pa.concat_tables(out) if out else NEGATIVES.empty_table()

    keys = ["size", "part", "grp"]
    found = spread(with_windows, "part", parts).groupBy(*keys).cogroup(spread(cand, "grp", groups).groupBy(*keys)).applyInArrow(
        best_negatives, "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
