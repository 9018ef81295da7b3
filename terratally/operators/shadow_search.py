"""Best shadow of each building by a search that opens leaves of neighbouring shadows in order of a lower bound.

A shadow's score grows with the distance of its centroid from the building, so a leaf (a few dozen shadows that lie
together) has a least possible score: from the box of its centroids. A building opens leaves in that order and stops at the first
one that cannot beat what it has. It never meets all shadows in its reach.

Images with few shadows and buildings are searched together, many in a task. The shadows of larger ones are cut into
tiles: a pyramid of cell counts gives each shadow the widest cell that a task can hold. A building first searches the tile
around its centre, and then only the tiles that may hold a better score.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terratally import fixed_values as K
from terratally.operators.spatial import rect_join
from terratally.session import by_key, cut_lineage, ship_package

#: Shadows or buildings of a task, shadows of a leaf, width of the finest cells and number of levels of the pyramid.
LIMIT, LEAF, FINEST, LEVELS = 50_000, 32, 16.0, 16
AWAY, PER_RADIUS = 15.0, 0.05
RECT, SHADOW = ["x1", "y1", "x2", "y2"], ["cx", "cy", "sx0", "sy0", "sx1", "sy1"]


def leaf_order(image: np.ndarray, x: np.ndarray, y: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in an order in which neighbours of an image lie together, and the leaves' starts; a leaf has one image."""
    order = np.lexsort((y, x, image))
    cuts = np.append(np.flatnonzero(np.diff(image[order], prepend=image[order[0]] - 1)), len(order))
    starts, nodes = [], [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]
    while nodes:
        a, b = nodes.pop()
        if b - a <= leaf:
            starts.append(a)
            continue
        i = order[a:b]
        by = x[i] if np.ptp(x[i]) >= np.ptp(y[i]) else y[i]
        half = (b - a) // 2
        order[a:b] = i[np.argpartition(by, half)]
        nodes += [(a, a + half), (a + half, b)]
    return order, np.array(sorted(starts), np.int64)


def gap(lo1, hi1, lo2, hi2):
    """Distance of two intervals."""
    return np.maximum(np.maximum(lo1 - hi2, lo2 - hi1), 0.0)


class Leaves:
    """Shadows in leaf order, with the boxes of the leaves."""

    def __init__(self, t: pa.Table, leaf: int):
        image, cx, cy = (t.column(c).to_numpy() for c in ("image_id", "cx", "cy"))
        order, self.start = leaf_order(image, cx.astype(float), cy.astype(float), leaf)
        self.table = t.take(pa.array(order))
        self.col = {c: self.table.column(c).to_numpy().astype(float) for c in SHADOW}
        self.ids = self.table.column("shadow_id").to_numpy()
        self.end = np.append(self.start[1:], len(order))
        self.image = image[order][self.start]
        self.low = {c: np.minimum.reduceat(self.col[c], self.start) for c in ("cx", "cy", "sx0", "sy0")}
        self.high = {c: np.maximum.reduceat(self.col[c], self.start) for c in ("cx", "cy", "sx1", "sy1")}


def bounds(b: dict, s: Leaves, which: slice, factor: float, pad: float) -> np.ndarray:
    """Least possible scores of the buildings ``b`` in the leaves; infinite where no shadow of a leaf can be in reach."""
    c = {k: v[:, None] for k, v in b.items()}
    low, high = ({k: v[which][None, :] for k, v in d.items()} for d in (s.low, s.high))
    near = np.hypot(gap(c["x1"], c["x2"], low["cx"], high["cx"]), gap(c["y1"], c["y2"], low["cy"], high["cy"]))
    mx, my = (c["x1"] + c["x2"]) / 2, (c["y1"] + c["y2"]) / 2
    radial = np.hypot(gap(mx, mx, low["cx"], high["cx"]), gap(my, my, low["cy"], high["cy"]))
    touch = (high["sx1"] >= c["x1"] - pad) & (low["sx0"] <= c["x2"] + pad) & (high["sy1"] >= c["y1"] - pad) & (low["sy0"] <= c["y2"] + pad)
    least = (near + PER_RADIUS * radial + np.where(touch, 0.0, AWAY)) * (1 - 1e-9)  # no loss by rounding
    return np.where((near * (1 - 1e-9) <= c["size"] * factor) | touch, least, np.inf)


def scored(b: dict, rows: np.ndarray, s: Leaves, at: np.ndarray, factor: float, pad: float) -> np.ndarray:
    """Scores of (building, shadow) pairs, infinite out of reach."""
    c = {k: v[rows] for k, v in b.items()}
    d = {k: v[at] for k, v in s.col.items()}
    gx = np.maximum(np.maximum(c["x1"] - d["cx"], 0.0), d["cx"] - c["x2"])
    gy = np.maximum(np.maximum(c["y1"] - d["cy"], 0.0), d["cy"] - c["y2"])
    dist = np.sqrt(gx * gx + gy * gy)
    touch = (d["sx1"] >= c["x1"] - pad) & (d["sx0"] <= c["x2"] + pad) & (d["sy1"] >= c["y1"] - pad) & (d["sy0"] <= c["y2"] + pad)
    ux, uy = d["cx"] - (c["x1"] + c["x2"]) / 2.0, d["cy"] - (c["y1"] + c["y2"]) / 2.0
    score = dist + np.where(touch, 0.0, AWAY) + PER_RADIUS * np.sqrt(ux * ux + uy * uy)
    return np.where((dist <= c["size"] * factor) | touch, score, np.inf)


def searcher(factor: float, pad: float, leaf: int, opened: list | None = None):
    """Function from buildings and shadows of the same images to the best shadow of each building.

    Column ``bound`` of the buildings: a score already found elsewhere, infinite where none.
    """
    def run(buildings: pa.Table, shadows: pa.Table) -> pa.Table:
        names = ["image_id", *RECT]
        if not buildings.num_rows or not shadows.num_rows:
            return answer_schema(buildings, shadows).empty_table()
        s = Leaves(shadows, leaf)
        b = {c: buildings.column(c).to_numpy().astype(float) for c in [*RECT, "size", "bound"]}
        image, n = buildings.column("image_id").to_numpy(), buildings.num_rows
        best, best_id, best_at = b["bound"].copy(), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        order = np.argsort(image, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(image[order], prepend=image[order[0]] - 1)), n)
        first, last = np.searchsorted(s.image, image[order[cuts[:-1]]], "left"), np.searchsorted(s.image, image[order[cuts[:-1]]], "right")

        def look(rows: np.ndarray, leaves: np.ndarray) -> None:
            """Open one leaf for each of the buildings."""
            if opened is not None:
                opened.append(len(rows))
            lengths = s.end[leaves] - s.start[leaves]
            ends = np.cumsum(lengths)
            at = np.repeat(s.start[leaves] - (ends - lengths), lengths) + np.arange(ends[-1])
            score = scored(b, np.repeat(rows, lengths), s, at, factor, pad)
            owner = np.repeat(np.arange(len(rows)), lengths)
            lead = np.lexsort((s.ids[at], score, owner))[np.append(0, ends[:-1])]
            better = (score[lead] < best[rows]) | ((score[lead] == best[rows]) & (s.ids[at[lead]] < best_id[rows]) & np.isfinite(score[lead]))
            r, w = rows[better], lead[better]
            best[r], best_id[r], best_at[r] = score[w], s.ids[at[w]], at[w]

        single = np.repeat(last - first == 1, np.diff(cuts))
        if single.any():
            rows = order[single]
            look(rows, np.repeat(first, np.diff(cuts))[single])
        for g in np.flatnonzero(last - first > 1):
            for a in range(cuts[g], cuts[g + 1], 512):
                rows = order[a:min(a + 512, cuts[g + 1])]
                least = bounds({k: v[rows] for k, v in b.items()}, s, slice(first[g], last[g]), factor, pad)
                rank = np.argsort(least, axis=1, kind="stable")
                for r in range(rank.shape[1]):
                    here = least[np.arange(len(rows)), rank[:, r]]
                    going = np.flatnonzero((here <= best[rows]) & np.isfinite(here))
                    if not len(going):
                        break
                    look(rows[going], first[g] + rank[going, r])
        hit = np.flatnonzero(best_at >= 0)
        one, other = buildings.select(names).take(pa.array(hit)), s.table.take(pa.array(best_at[hit]))
        columns = [*one.columns, pa.array(best[hit]), *[other.column(c) for c in ("shadow_id", *SHADOW)]]
        return pa.table(columns, schema=answer_schema(buildings, shadows))

    return run


def answer_schema(buildings: pa.Table, shadows: pa.Table) -> pa.Schema:
    return pa.schema([*[buildings.schema.field(c) for c in ["image_id", *RECT]], pa.field("score", pa.float64()), *[shadows.schema.field(c) for c in ("shadow_id", *SHADOW)]])


def tiled(shadows: DataFrame) -> DataFrame:
    """``shadows`` with the tile that holds them: the widest cell of the pyramid with at most LIMIT centroids.

    Where even the finest cell has more, its shadows are dealt to several tiles by their id.
    """
    lv = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("lv")
    at = shadows.select("image_id", "shadow_id", *SHADOW, lv)
    w = FINEST * F.pow(F.lit(2.0), F.col("lv"))
    at = at.withColumns({"gx": F.floor(F.col("cx") / w), "gy": F.floor(F.col("cy") / w)})
    counts = cut_lineage(at.groupBy("image_id", "lv", "gx", "gy").agg(F.count(F.lit(1)).alias("n")))
    fits = at.join(by_key(counts.where((F.col("n") <= LIMIT) | (F.col("lv") == 0))), ["image_id", "lv", "gx", "gy"])
    best = fits.groupBy("image_id", "shadow_id", *SHADOW).agg(F.max(F.struct("lv", "gx", "gy", "n")).alias("m"))
    sub = F.pmod(F.xxhash64("shadow_id", *SHADOW), F.ceil(F.col("m.n") / LIMIT).cast("bigint"))
    return best.select("image_id", "shadow_id", *SHADOW, "m.lv", "m.gx", "m.gy", F.when(F.col("m.n") > LIMIT, sub).otherwise(F.lit(0).cast("bigint")).alias("sub"))


def once(shadows: DataFrame, *keys: str) -> DataFrame:
    """Every geometry of an image once, with its first id."""
    return shadows.groupBy(*keys, "image_id", *SHADOW).agg(F.min("shadow_id").alias("shadow_id"))


def best_shadows(buildings: DataFrame, shadows: DataFrame, factor: float, pad: float) -> DataFrame:
    """image_id, the building's corners, score, and its best shadow (id, centroid, bounds); unmatched buildings are left out.

    ``buildings``: image_id, corners and ``size``, each once. ``shadows``: image_id, shadow_id, centroid and bounds; copies of a
    geometry are compared once.
    """
    ship_package(buildings.sparkSession)
    buildings = buildings.select("image_id", *RECT, "size").withColumn("bound", F.lit(float("inf")))
    shadows = shadows.select("image_id", "shadow_id", *SHADOW)
    out = buildings.limit(0).select("image_id", *RECT, F.lit(0.0).alias("score")).crossJoin(shadows.limit(0).drop("image_id")).schema
    # copies are counted too: finding them takes the exchange that the search makes anyway
    counts = (buildings.groupBy("image_id").agg(F.count(F.lit(1)).alias("nb")).join(by_key(shadows.groupBy("image_id").agg(F.count(F.lit(1)).alias("ns"))), "image_id"))
    counts = cut_lineage(counts)
    total, most = counts.agg(F.coalesce(F.sum(F.col("nb") + F.col("ns")), F.lit(0)), F.coalesce(F.max(F.greatest("nb", "ns")), F.lit(0))).first()
    tasks = max(1, math.ceil(total / LIMIT), shadows.sparkSession.sparkContext.defaultParallelism if total > 1000 else 1)
    bucket = F.pmod(F.xxhash64("image_id"), F.lit(tasks)).alias("bucket")

    def search(b: DataFrame, s: DataFrame, *keys) -> DataFrame:
        return b.groupBy(*keys).cogroup(s.groupBy(*keys)).applyInArrow(searcher(factor, pad, LEAF), out)

    def together(b: DataFrame, s: DataFrame) -> DataFrame:
        """Buckets of whole images; copies of a shadow meet in their bucket."""
        return search(b.select("*", bucket), once(s.select("*", bucket).repartition("bucket"), "bucket"), "bucket")

    if most <= LIMIT:
        return together(buildings, shadows)
    large = counts.where(F.greatest("nb", "ns") > LIMIT).select("image_id")
    small = together(buildings.join(large, "image_id", "left_anti"), shadows.join(large, "image_id", "left_anti"))
    return small.unionByName(_by_tiles(buildings.join(large, "image_id", "left_semi"), cut_lineage(tiled(once(shadows.join(large, "image_id", "left_semi")))), factor, pad, search))


def _by_tiles(buildings: DataFrame, shadows: DataFrame, factor: float, pad: float, search) -> DataFrame:
    tile = ["image_id", "lv", "gx", "gy", "sub"]
    boxes = cut_lineage(shadows.groupBy(*tile).agg(
        *[f(c).cast("double").alias(n) for n, f, c in (("c_x0", F.min, "cx"), ("c_y0", F.min, "cy"), ("c_x1", F.max, "cx"), ("c_y1", F.max, "cy"),
                                                         ("s_x0", F.min, "sx0"), ("s_y0", F.min, "sy0"), ("s_x1", F.max, "sx1"), ("s_y1", F.max, "sy1"))]))

    def visit(asking: DataFrame) -> DataFrame:
        """Search the given tiles; buildings of a tile are dealt to groups of LIMIT, each with the tile's shadows."""
        asking = cut_lineage(asking.select([F.col(c).alias(c) for c in asking.columns]))
        groups = asking.groupBy(*[F.col(c).alias(c) for c in tile]).agg(F.ceil(F.count(F.lit(1)) / LIMIT).cast("bigint").alias("groups"))
        b = asking.join(by_key(groups), tile).withColumn("grp", F.pmod(F.xxhash64(*RECT), F.col("groups"))).drop("groups")
        s = shadows.select([F.col(c).alias(c) for c in shadows.columns]).join(by_key(groups.select([F.col(c).alias(c) for c in groups.columns])), tile).withColumn("grp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1))).drop("groups")
        return search(b, s, *tile, "grp")

    # the tile around the centre, which is a cell of one of the levels
    at = buildings.withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    w = FINEST * F.pow(F.lit(2.0), F.col("lv"))
    at = at.withColumns({"gx": F.floor((F.col("x1") + F.col("x2")) / 2 / w), "gy": F.floor((F.col("y1") + F.col("y2")) / 2 / w), "sub": F.lit(0).cast("bigint")})
    key = ["image_id", *RECT]
    begun = cut_lineage(visit(at.join(by_key(boxes.select(*tile)), tile, "left_semi")))
    known = buildings.drop("bound").join(by_key(begun.select(*key, F.col("score").alias("bound"))), key, "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    # the tiles that may hold a better one
    reach = F.least(F.greatest(F.col("size") * factor, F.lit(float(pad))), F.greatest(F.col("bound"), F.lit(float(pad))))
    left = known.select("*", (F.col("x1") - reach).alias("l_x0"), (F.col("y1") - reach).alias("l_y0"), (F.col("x2") + reach).alias("l_x1"), (F.col("y2") + reach).alias("l_y1"))
    ends = {"r_x0": F.least("c_x0", "s_x0"), "r_y0": F.least("c_y0", "s_y0"), "r_x1": F.greatest("c_x1", "s_x1"), "r_y1": F.greatest("c_y1", "s_y1")}
    zero = F.lit(0.0)
    near = F.hypot(F.greatest(F.col("c_x0") - F.col("x2"), F.col("x1") - F.col("c_x1"), zero), F.greatest(F.col("c_y0") - F.col("y2"), F.col("y1") - F.col("c_y1"), zero)) * (1 - 1e-9)
    touch = (F.col("s_x1") >= F.col("x1") - pad) & (F.col("s_x0") <= F.col("x2") + pad) & (F.col("s_y1") >= F.col("y1") - pad) & (F.col("s_y0") <= F.col("y2") + pad)
    pairs = rect_join(left, boxes.withColumns(ends), ["image_id"]).where((near <= F.col("bound")) & ((near <= F.col("size") * factor) | touch))
    found = visit(pairs.select(*key, "size", "bound", "lv", "gx", "gy", "sub"))
    return begun.unionByName(found).groupBy(*key).agg(F.min(F.struct("score", "shadow_id", *SHADOW)).alias("m")).select(*key, "m.*")


def match_shadows(
    buildings: DataFrame, shadows: DataFrame,
    factor: float = K.SHADOW_DISTANCE_FACTOR, pad: float = K.SHADOW_PADDING,
) -> DataFrame:
    """Nearest plausible shadow per building, by score, first shadow on ties.

    ``buildings``: image_id, asset_idx, x1, y1, x2, y2 (pixels).
    ``shadows``: image_id, shadow_id, cx, cy, sx0, sy0, sx1, sy1 (centroid and bounds).
    Identical boxes are matched once and identical shadows compared once; the copies
    share the answer. Returns only matched buildings.
    """
    size = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(1)).cast("double")
    shapes = buildings.select("image_id", *RECT).distinct()
    best = best_shadows(shapes.withColumn("size", size), shadows, factor, pad)
    return buildings.join(by_key(best), ["image_id", *RECT])
