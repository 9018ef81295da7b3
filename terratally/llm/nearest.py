"""Approximate nearest neighbours: low-dimensional stable projections indexed by kd-trees.

Vectors are projected to DIMS numbers by Gaussian (2-stable) projections: the squared projected distance over the squared
distance of two vectors is chi-square with DIMS degrees of freedom. A query takes its neighbours in order of projected
distance, verifies each by the distance of the whole vectors, and stops when the next projected distance is so large
that a vector nearer than its k-th neighbour would have been met already with probability SURE.

The kd-tree has two levels. Its upper splits are fitted on a bounded sample (the SAMPLE rows with the smallest hash of
vec_id) and cut space into at most CELLS cells; every row is indexed. A cell is cut into parts of bounded size by a hash
of vec_id (a cell that many near copies fill is one of several parts), and each part has a tree of its own, down to
leaves of LEAF rows, in which its rows lie in order. A query first searches one part of its own cell. That k-th distance
bounds the answer, so that the query then goes only to the cells that the stopping test leaves open. Leaves are opened
in order of their distance; inside an opened leaf, only rows that pass the test are verified.

Score: the Euclidean distance in double precision. Vectors that are null or zero or hold null or non-finite components,
and rows without an id, take no part. Only vectors of the same length are compared. Rows with the query's id are its own
and no candidates; a repeated query id asks once, with its smallest vector. Equal distances go by smaller id. An empty
table gives no rows.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terratally.llm.common import parts_for, renewed, ship_package, written

DIMS, SURE = 12, 0.98
SAMPLE, CELLS, PART, LEAF, GROUP = 20_000, 1024, 4096, 32, 1024


def chi_square(x: float, dims: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for i in range(dims // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1.0 - math.exp(-x / 2) * total


def chi_square_at(p: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < p else (low, mid)
    return high


def projection(size: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng([size, dims]).normal(size=(size, dims))


def list_values(t, name: str) -> np.ndarray:
    v = t.column(name)
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return np.asarray(v.flatten()).reshape(len(v), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, the vector as doubles, its length and its projection."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists(x, lambda v: v != 0)
    rows = vectors.select("vec_id", x.alias("v"), F.coalesce(~bad & some, F.lit(False)).alias("good"))

    def project(batches):
        for b in batches:
            lengths = np.asarray(b.column("v").value_lengths())
            for size in np.unique(lengths):
                one = b.filter(pa.array(lengths == size))
                with np.errstate(over="ignore", invalid="ignore"):
                    p = list_values(one, "v") @ projection(int(size))
                p = np.nan_to_num(p, posinf=1e300, neginf=-1e300)
                p = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, DIMS, dtype=np.int32)), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([one.column("vec_id"), one.column("v"), pa.array(np.full(len(one), size, np.int32)), p], ["vec_id", "v", "size", "p"])

    return rows.where("good AND vec_id IS NOT NULL").select("vec_id", "v").mapInArrow(project, "vec_id long, v array<double>, size int, p array<double>")


def splits(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Axis and value of each inner node of a tree of the given depth, level by level."""
    out, level = [], [points]
    for _ in range(depth):
        deeper = []
        for x in level:
            if not len(x):
                axis, at = 0, 0.0
            else:
                axis = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
                at = float(np.median(x[:, axis]))
            out.append((axis, at))
            deeper += [x[x[:, axis] < at], x[x[:, axis] >= at]]
        level = deeper
    return out


def cell_of(points: np.ndarray, tree: list[tuple[int, float]], depth: int) -> np.ndarray:
    axes, at = np.array([t[0] for t in tree], np.int64), np.array([t[1] for t in tree])
    node = np.zeros(len(points), np.int64)
    for _ in range(depth):
        node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] >= at[node])
    return node - (2**depth - 1)


def leaves(points: np.ndarray, leaf: int) -> np.ndarray:
    """Order of the points along a kd-tree that halves its nodes at the median of their widest axis."""
    order, nodes = np.arange(len(points)), [(0, len(points))]
    while nodes:
        a, b = nodes.pop()
        if b - a > leaf:
            x = points[order[a:b]]
            axis = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
            half = leaf * -(-((b - a) // 2) // leaf)  # whole leaves
            order[a:b] = order[a:b][np.argpartition(x[:, axis], half)]
            nodes += [(a, a + half), (a + half, b)]
    return order


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        x = q[:, j, None]
        with np.errstate(over="ignore"):
            out += np.maximum(np.maximum(low[None, :, j] - x, x - high[None, :, j]), 0) ** 2
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise Euclidean distances."""
    with np.errstate(over="ignore"):
        d = a - b
        square = (d * d).sum(axis=1)
        far = ~np.isfinite(square)
        if far.any():
            top = np.abs(d[far]).max(axis=1)
            square[far] = np.inf
            root = np.sqrt(square)
            root[far] = top * np.sqrt(((d[far] / top[:, None]) ** 2).sum(axis=1))
            return root
    return np.sqrt(square)


def search(q: np.ndarray, qp: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, c: np.ndarray, cp: np.ndarray, c_ids: np.ndarray, k: int, factor: float, leaf: int = LEAF):
    """The k nearest of a part for each query: distances (infinite where there is none) and ids.

    ``bound``: distances that the answers need not exceed; ``factor``: squared projected over squared distance beyond
    which the test says stop.
    """
    order = leaves(cp, leaf)
    c, cp, c_ids = c[order], cp[order], c_ids[order]
    starts = np.arange(0, len(c), leaf)
    low, high = np.minimum.reduceat(cp, starts), np.maximum.reduceat(cp, starts)
    gap = box_distance(qp, low, high)
    rank = np.argsort(gap, axis=1, kind="stable")
    n, rows = len(q), np.arange(len(q))
    dist, ids = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
    lanes = np.arange(leaf)
    for r in range(len(starts)):
        b = rank[:, r]
        kth = np.minimum(dist[:, -1], bound)
        with np.errstate(over="ignore", invalid="ignore"):
            limit = np.where(np.isfinite(kth), factor * kth * kth, np.inf)
        going = np.flatnonzero(gap[rows, b] <= limit)
        if not len(going):
            break
        at = starts[b[going]][:, None] + lanes
        real = at < len(c)
        at = np.minimum(at, len(c) - 1)
        with np.errstate(over="ignore"):
            near = ((cp[at] - qp[going][:, None, :]) ** 2).sum(axis=2)
        open_ = real & (near <= limit[going][:, None]) & (c_ids[at] != q_ids[going][:, None])
        x, y = np.nonzero(open_)
        if not len(x):
            continue
        d = np.full(at.shape, np.inf)
        d[x, y] = distances(q[going[x]], c[at[x, y]])
        d[d > kth[going][:, None]] = np.inf
        better = np.isfinite(d).any(axis=1)
        going, d, at = going[better], d[better], at[better]
        all_d = np.concatenate([dist[going], d], axis=1)
        all_i = np.concatenate([ids[going], np.where(np.isfinite(d), c_ids[at], np.iinfo(np.int64).max)], axis=1)
        top = np.lexsort((all_i, all_d), axis=1)[:, :k]
        dist[going], ids[going] = np.take_along_axis(all_d, top, 1), np.take_along_axis(all_i, top, 1)
    return dist, ids


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def searcher(k: int, factor: float):
    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return FOUND.empty_table()
        own, ids = q.column("vec_id").to_numpy(), c.column("vec_id").to_numpy()
        d, i = search(list_values(q, "v"), list_values(q, "p"), own, q.column("bound").to_numpy(), list_values(c, "v"), list_values(c, "p"), ids, k, factor)
        real = np.isfinite(d)
        return pa.table([np.repeat(own, real.sum(axis=1)), i[real], d[real]], schema=FOUND)

    return run


def nearest(vectors: DataFrame, queries, k: int = 10, sure: float = SURE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. ``queries``: condition on vec_id that picks the query rows."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = written(usable(vectors), "projected")
    n = rows.count()
    factor = chi_square_at(sure, DIMS)
    depth = min(int(math.log2(CELLS)), max(0, math.ceil(math.log2(max(n, 1) / PART))))
    sample = rows.orderBy(F.xxhash64("vec_id")).select("p").limit(SAMPLE).collect() if depth else []
    tree = splits(np.array([r.p for r in sample], np.float64).reshape(-1, DIMS), depth)

    @F.pandas_udf("int")
    def cell(p):
        import pandas as pd
        return pd.Series(cell_of(np.array(p.tolist(), np.float64).reshape(-1, DIMS), tree, depth), dtype="int32")

    # every row in its cell; boxes, row counts and query counts of the cells (CELLS rows at most)
    placed = written(rows.withColumn("cell", cell("p")), "cells")
    edges = [f(F.col("p")[j]).alias(f"{name}{j}") for j in range(DIMS) for name, f in (("low", F.min), ("high", F.max))]
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(queries, 1)).alias("asked"), *edges).orderBy("cell").collect()
    number = np.array([r.cell for r in cells], np.int64)
    low, high = (np.array([[r[f"{e}{j}"] for j in range(DIMS)] for r in cells], np.float64).reshape(-1, DIMS) for e in ("low", "high"))

    def per_cell(sizes):
        pairs = [F.lit(x) for r, m in zip(cells, sizes) for x in (r.cell, m)]
        return F.create_map(*(pairs or [F.lit(0), F.lit(1)]))[F.col("cell")]

    many = per_cell([parts_for(r.n, PART) for r in cells])
    index = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), many))
    # queries of neighbouring cells open much the same cells: about GROUP of them form a group
    first = np.cumsum([0] + [r.asked for r in cells])
    own = placed.where(queries).groupBy("vec_id").agg(F.min(F.struct("v", "p", "size", "cell")).alias("m")).select("vec_id", "m.*")
    own = own.withColumn("grp", F.struct(per_cell([int(x) // GROUP for x in first[:-1]]).alias("group"), F.pmod(F.xxhash64("vec_id"), per_cell([parts_for(r.asked, GROUP) for r in cells])).alias("sub")))
    keys = ["cell", "part", "size", "grp"]

    def visit(asking: DataFrame) -> DataFrame:
        """Search the parts that queries go to; rows of a part travel once per group that visits it."""
        asking = renewed(asking)
        visited = index.join(renewed(asking.select(*keys).distinct()), ["cell", "part", "size"])
        return asking.groupBy(*keys).cogroup(visited.groupBy(*keys)).applyInArrow(searcher(k, factor), "query_id long, vec_id long, score double")

    # the own cell first: any k neighbours bound the answer
    begun = visit(own.withColumn("part", F.pmod(F.xxhash64("vec_id"), many)).withColumn("bound", F.lit(float("inf"))))
    kth = begun.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("bound"))
    bounded = written(own.join(kth, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), "bounded")

    @F.pandas_udf("array<int>")
    def open_cells(p, bound):
        import pandas as pd
        with np.errstate(over="ignore", invalid="ignore"):
            limit = np.where(np.isfinite(bound), factor * bound.to_numpy() ** 2, np.inf)
        gap = box_distance(np.array(p.tolist(), np.float64).reshape(-1, DIMS), low, high)
        return pd.Series([number[g <= x].astype(np.int32) for g, x in zip(gap, limit)])

    going = bounded.withColumn("cell", F.explode(open_cells("p", "bound")))
    going = going.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), (many - 1).cast("long"))))
    found = visit(going)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
