"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are dealt to parts, and inside a part lie in blocks of neighbouring ids. A block has a forward index (its
vectors as a matrix) and, per dimension ("term"), the least and the largest weight. For a query, the sum over terms of
query weight times the extreme that fits its sign bounds every score in the block. Queries go through the blocks in
order of falling bound and stop where the bound is below their k-th score so far (an equal bound is still opened, for
ties). Queries and parts meet as (query group, part) pairs of fixed size, so tasks stay small however many rows there
are; the k best of each pair are merged per query at the end.

Components become floor(scale * x), with x as double. Vectors that are null or hold null or non-finite components, and
rows without an id, take no part. Only vectors of the same length are compared. Ids are meant to be unique: rows with
the query's id are its own and no candidates, and a repeated query id asks once, with its smallest vector. Scores beyond
64 bits end at the limits. An empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terratally.llm.common import parts_for, ship_package, written

PART, GROUP, BLOCK = 2048, 2048, 64
EXACT = 2.0**53
LIMIT = (-(2**63), 2**63 - 1)


def usable(vectors: DataFrame) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select("vec_id", x.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact."""
    if a.shape[1] == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(whole, *LIMIT).astype(np.int64)


def search(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, block: int = BLOCK):
    """For each query the k best (score, id) of the candidates: arrays of shape (queries, k), id -1 where there is none."""
    order = np.argsort(c_ids, kind="stable")
    c, c_ids = c[order], c_ids[order]
    cuts = range(0, len(c), block)
    most = np.stack([c[i:i + block].max(axis=0) for i in cuts])
    least = np.stack([c[i:i + block].min(axis=0) for i in cuts])
    bound = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
    bound += np.abs(bound) * 1e-9  # no loss by rounding
    ranked = np.argsort(-bound, axis=1, kind="stable")
    n = len(q)
    score, ids = np.full((n, k), LIMIT[0], np.int64), np.full((n, k), -1, np.int64)
    filled = np.zeros(n, np.int64)
    for r in range(bound.shape[1]):
        b = ranked[:, r]
        going = (filled < k) | (bound[np.arange(n), b] >= score[:, -1])
        if not going.any():
            break
        for one in np.unique(b[going]):
            at = np.flatnonzero(going & (b == one))
            rows = slice(one * block, (one + 1) * block)
            s = products(q[at], c[rows])
            other = c_ids[rows][None, :] != q_ids[at][:, None]
            all_s = np.concatenate([score[at], s], axis=1)
            all_i = np.concatenate([ids[at], np.broadcast_to(c_ids[rows], s.shape)], axis=1)
            real = np.concatenate([np.arange(k)[None, :] < filled[at][:, None], other], axis=1)
            top = np.lexsort((all_i, -all_s.astype(np.float64) if np.abs(all_s[real]).max(initial=0) < EXACT else np.bitwise_not(all_s), ~real), axis=1)[:, :k]
            score[at], ids[at] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
            filled[at] = np.minimum(k, real.sum(axis=1))
    return score, ids, filled


def top_k(vectors: DataFrame, queries, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. ``queries``: condition on vec_id that picks the query rows."""
    ship_package(vectors.sparkSession)
    rows = written(usable(vectors), "vectors")
    n, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(queries, 1))).first()
    parts, groups = parts_for(n, PART), parts_for(asked, GROUP)
    size = F.size("v").alias("size")

    def dealt(df: DataFrame, own: str, m: int, other: str, others: int) -> DataFrame:
        return df.select("vec_id", "v", size, F.pmod(F.xxhash64("vec_id"), F.lit(m)).alias(own)).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))

    q = dealt(rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "grp", groups, "part", parts)
    c = dealt(rows, "part", parts, "grp", groups)

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        whole = [np.floor(np.stack(x["v"]) * scale) if x["size"].iloc[0] else np.zeros((len(x), 0)) for x in (q, c)]
        score, ids, filled = search(whole[0], q["vec_id"].to_numpy(), whole[1], c["vec_id"].to_numpy(), k)
        real = np.arange(k)[None, :] < filled[:, None]
        return pd.DataFrame({"query_id": np.repeat(q["vec_id"].to_numpy(), filled), "vec_id": ids[real], "score": score[real]})

    keys = ["part", "grp", "size"]
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
