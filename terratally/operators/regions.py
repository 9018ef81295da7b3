"""Connected regions of masks.

A mask row is cut into pieces: stretches of set pixels inside one 64-pixel word. Pieces
are joined inside tiles of bounded size first, one task per tile; only the pieces along
tile borders take part in the merging of labels across an image.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from terratally.operators.raster import KEY, long_masks
from terratally.session import by_key, cut_lineage, ship_package

TILE_ROWS, TILE_WORDS, CALL_ROWS = 1024, 16, 200_000
PIECE = ["image_id", "w", "h", "mask", "y", "x0", "x1"]


def piece_bits(x0: Column, x1: Column) -> Column:
    """Word with the bits of a piece set."""
    return F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (F.lit(63) - (x1 - x0)).cast("int")), (x0 % 64).cast("int"))


def pieces(long: DataFrame, *extra: Column) -> DataFrame:
    """Stretches of set bits per word, in global x coordinates."""
    first = "bits & ~shiftleft(bits, 1)"
    last = "bits & ~shiftrightunsigned(bits, 1)"
    at = "filter(sequence(0, 63), i -> (shiftrightunsigned({}, i) & 1L) = 1L)"
    df = long.where("bits <> 0").withColumns({"_f": F.expr(first), "_l": F.expr(last)})
    df = df.select("*", F.inline(F.arrays_zip(F.expr(at.format("_f")).alias("s"), F.expr(at.format("_l")).alias("e"))))
    base = F.col("xb") * 64
    return df.select("image_id", "w", "h", "mask", "y", (base + F.col("s")).alias("x0"), (base + F.col("e")).alias("x1"), *extra)


def by_tile(df: DataFrame, tile: list[str], run, schema, rows: int = CALL_ROWS) -> DataFrame:
    """``run`` over whole tiles, small ones together until a call has ``rows`` rows.

    Tiles come sorted and are read in batches, so memory follows the largest tile and not the share of a task.
    """
    names = (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).names

    def calls(batches):
        held, n, full = [], 0, rows
        for b in batches:
            held.append(b)
            n += len(b)
            if n < full:
                continue
            pdf = pd.concat(held, ignore_index=True)
            last = (pdf[tile] == pdf[tile].iloc[-1]).all(axis=1).to_numpy()
            cut = n - int(last.sum())
            if cut:
                yield run(pdf.iloc[:cut])[names]
            held, n = [pdf.iloc[cut:]], n - cut
            full = max(rows, 2 * n)
        if n:
            yield run(pd.concat(held, ignore_index=True))[names]

    return df.repartition(*tile).sortWithinPartitions(*tile).mapInPandas(calls, schema)


def united(code: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach) -> np.ndarray:
    """First piece of the region of each piece. Pieces are sorted by (code, y, x0); only pieces of one code are joined.

    ``reach`` is 1 where diagonal neighbours count.
    """
    wide = np.int64(x1.max() + 4)
    row = code * (y.max() + 2) + y
    near = np.flatnonzero((row[1:] == row[:-1]) & (x0[1:] == x1[:-1] + 1))
    lo = np.searchsorted(row * wide + x1 + 1, (row + 1) * wide + x0 + 1 - reach)
    hi = np.searchsorted(row * wide + x0 + 1, (row + 1) * wide + x1 + 1 + reach, side="right")
    n = np.where(y < y.max(), np.maximum(hi - lo, 0), 0)
    a = np.concatenate([near, np.repeat(np.arange(len(y)), n)])
    b = np.concatenate([near + 1, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)])
    root = np.arange(len(y))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def label_tiles(reach: int):
    """Labels inside tiles: each piece gets the raster index of its region's first pixel in the tile."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        code = pdf.groupby(["image_id", "_ty", "_tx", "mask"], sort=False).ngroup().to_numpy()
        order = np.lexsort((pdf["x0"], pdf["y"], code))
        pdf = pdf.iloc[order]
        y, x0, x1, w = (pdf[c].to_numpy(np.int64) for c in ("y", "x0", "x1", "w"))
        root = united(code[order], y, x0, x1, reach)
        return pdf.assign(lab=y[root] * w + x0[root])

    return run


def label(pcs: DataFrame, conn: int = 8,
          rows: int = TILE_ROWS, words: int = TILE_WORDS) -> DataFrame:
    """Pieces with ``lab``, the raster index of the first pixel of their region."""
    reach = 1 if conn == 8 else 0
    df = pcs.withColumns({"_ty": F.floor(F.col("y") / rows), "_tx": F.floor(F.col("x0") / (64 * words))})
    schema = T.StructType(df.schema.fields + [T.StructField("lab", T.LongType())])
    ship_package(df.sparkSession)
    out = cut_lineage(by_tile(df, ["image_id", "_ty", "_tx"], label_tiles(reach), schema))
    links = border_links(out, reach, rows, words)
    roots = contract(links)
    if roots.isEmpty():
        return out.drop("_ty", "_tx")
    key = ["image_id", "mask", "lab"]
    return (out.drop("_ty", "_tx").join(by_key(roots), key, "left")
            .withColumn("lab", F.coalesce("root", "lab")).drop("root"))


def border_links(out: DataFrame, reach: int, rows: int, words: int) -> DataFrame:
    """Label pairs of pieces that touch across a tile border."""
    p = out.select("image_id", "mask", "y", "x0", "x1", "lab")
    side = words * 64
    keys = ["image_id", "mask", "y", "_xb"]
    upper = p.where((F.col("y") + 1) % rows == 0).select(
        "image_id", "mask", (F.col("y") + 1).alias("y"), (F.col("x0") - reach).alias("a0"), (F.col("x1") + reach).alias("a1"),
        F.col("lab").alias("u")).withColumn("_xb", F.explode(F.sequence(F.floor(F.col("a0") / 64), F.floor(F.col("a1") / 64))))
    lower = p.where(F.col("y") % rows == 0).withColumn("_xb", F.floor(F.col("x0") / 64)).withColumnRenamed("lab", "v")
    down = upper.join(by_key(lower), keys).where("a0 <= x1 AND x0 <= a1").select("image_id", "mask", "u", "v")
    ys = F.explode(F.sequence(F.col("y") - reach, F.col("y") + reach))
    left = p.where((F.col("x1") + 1) % side == 0).select("image_id", "mask", ys.alias("y"), (F.col("x1") + 1).alias("x0"), F.col("lab").alias("u"))
    right = p.where((F.col("x0") % side == 0)).select("image_id", "mask", "y", "x0", F.col("lab").alias("v"))
    across = left.join(by_key(right), ["image_id", "mask", "y", "x0"]).select("image_id", "mask", "u", "v")
    return down.unionByName(across).where("u <> v").distinct()


def contract(links: DataFrame, g: list[str] = ("image_id", "mask")) -> DataFrame:
    """Smallest label of every linked group inside ``g``, by alternating large-star and small-star steps.

    Nothing but link pairs moves; each round is written to the shared folder, and its count and hash sum tell whether
    anything moved. Without links the first count ends it.
    """
    g = list(g)

    def step(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = cut_lineage(df.where("u <> v").distinct())
        return df, tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*g, "u", "v").cast("decimal(38,0)"))).first())

    e, mark = step(links.select(*g, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    moved = bool(mark[0])
    while moved:
        both = e.unionByName(e.select(*g, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*g, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(by_key(low), [*g, "u"]).where("v > u").select(*g, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(*g, "u").agg(F.min("v").alias("m"))
        small = large.join(by_key(low), [*g, "u"]).select(*g, "u", "v", "m")
        e, now = step(small.select(*g, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select(*g, "u", F.col("m").alias("v"))))
        moved, mark = now != mark, now
    return e.select(*g, F.col("u").alias("lab"), F.col("v").alias("root"))


def to_words(pcs: DataFrame) -> DataFrame:
    """Pieces back to words: (image_id, w, h, mask, y, xb, bits)."""
    return pcs.groupBy("image_id", "w", "h", "mask", "y", F.floor(F.col("x0") / 64).cast("int").alias("xb")).agg(
        F.bit_or(piece_bits(F.col("x0"), F.col("x1"))).alias("bits"))


def fill_holes(long: DataFrame, rows: int = TILE_ROWS, words: int = TILE_WORDS) -> DataFrame:
    """Masks with interior holes set."""
    from terratally.operators.enclosure import filled_pieces

    empty = long.withColumn("bits", F.lit(0).cast("bigint"))
    both = empty.unionByName(to_words(filled_pieces(long, rows, words)).select(long.columns))
    return both.groupBy("image_id", "w", "h", "mask", "y", "xb").agg(F.bit_or("bits").alias("bits"))


def corner_areas(rows: int, words: int):
    """Function from the pieces of tiles, and those around them, to the tiles' own with ``area2``.

    Twice the outline area is the sum over 2x2 blocks of set pixels: two for a full one, one for one with a corner missing.
    Blocks count at the pixel at their top left, or at the one beside it where that is missing.
    """
    side, one, last = 64 * words, np.uint64(1), np.uint64(63)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = pdf.groupby(["image_id", "_ty", "_tx", "mask"], sort=False).ngroup().to_numpy(np.int64)
        y, x0, x1 = (pdf[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
        # an empty row and empty words lie between tiles
        low, tall, wide = int(y.min()), int(y.max() - y.min()) + 2, int(x0.max()) // 64 + 3
        place = (tile * tall + y - low) * wide + x0 // 64 + 1
        bits = (np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (x1 - x0)).astype(np.uint64)) << (x0 % 64).astype(np.uint64)
        order = np.argsort(place, kind="stable")
        at, first = np.unique(place[order], return_index=True)
        a = np.bitwise_or.reduceat(bits[order], first)

        def near(dy: int, dx: int) -> np.ndarray:
            want = at + dy * wide + dx
            i = np.minimum(np.searchsorted(at, want), len(at) - 1)
            return np.where(at[i] == want, a[i], np.uint64(0))

        c = near(1, 0)
        b, d = (a >> one) | (near(0, 1) << last), (c >> one) | (near(1, 1) << last)
        al, cl = (a << one) | (near(0, -1) >> last), (c << one) | (near(1, -1) >> last)
        full, part, left = a & b & c & d, a & ((b & c & ~d) | (b & ~c & d) | (~b & c & d)), a & ~al & cl & c
        own = (y // rows == pdf["_ty"].to_numpy()) & (x0 // side == pdf["_tx"].to_numpy())
        i, m = np.searchsorted(at, place[own]), bits[own]
        count = lambda q: np.bitwise_count(q[i] & m).astype(np.int32)
        return pdf[own].assign(area2=2 * count(full) + count(part) + count(left))

    return run


def with_corners(pcs: DataFrame, rows: int, words: int) -> DataFrame:
    """Pieces with ``area2``; those at the border of a tile go to the tiles that need them too."""
    side = 64 * words
    ty, tx = F.floor(F.col("y") / rows), F.floor(F.col("x0") / side)
    also = lambda cond: F.when(cond, 1).otherwise(0)
    df = pcs.withColumn("_ty", F.explode(F.sequence(ty - also((F.col("y") % rows == 0) & (F.col("y") > 0)), ty)))
    df = df.withColumn("_tx", F.explode(F.sequence(tx - also((F.col("x0") % side == 0) & (F.col("x0") > 0)), tx + also((F.col("x1") + 1) % side == 0))))
    schema = T.StructType([*pcs.schema.fields, T.StructField("area2", T.IntegerType())])
    ship_package(pcs.sparkSession)
    return by_tile(df, ["image_id", "_ty", "_tx"], corner_areas(rows, words), schema)


def labelled_regions(long: DataFrame, filled: bool = False,
                     rows: int = TILE_ROWS, words: int = TILE_WORDS) -> DataFrame:
    """Pieces of the outer regions of every mask (holes filled, 8-connected) with label and area parts.

    With ``filled`` the masks have no holes and are only labelled.
    """
    from terratally.operators.enclosure import filled_pieces

    pcs = label(pieces(long), 8, rows, words) if filled else filled_pieces(long, rows, words)
    return with_corners(pcs, rows, words)


def region_stats(labelled: DataFrame) -> DataFrame:
    """Bounds, pixel count, outline area and centroid per region."""
    n = F.col("x1") - F.col("x0") + 1
    out = labelled.groupBy("image_id", "w", "h", "mask", F.col("lab").alias("comp_id")).agg(
        F.sum(n).alias("n"), (F.sum("area2") / 2.0).alias("area"),
        F.min("x0").alias("min_x"), F.min("y").alias("min_y"), F.max("x1").alias("max_x"), F.max("y").alias("max_y"),
        F.sum((F.col("x0") + F.col("x1")) * n).alias("_sx"), F.sum(F.col("y") * n).alias("_sy"))
    return out.withColumns({
        "cx": F.col("_sx") / (F.col("n") * 2.0), "cy": F.col("_sy") / F.col("n").cast("double"),
        "bw": F.col("max_x") - F.col("min_x") + 1, "bh": F.col("max_y") - F.col("min_y") + 1}).drop("_sx", "_sy")


def within(min_area=None, max_area=None, min_aspect=None, max_aspect=None, min_extent=None) -> Column:
    """Optional inclusive bounds on area, longer/shorter side, and area over box area."""
    aspect = F.greatest("bw", "bh") / F.greatest(F.least("bw", "bh"), F.lit(1)).cast("double")
    extent = F.col("area") / F.greatest(F.col("bw") * F.col("bh"), F.lit(1)).cast("double")
    ok = F.lit(True)
    for bound, cond in ((min_area, lambda v: F.col("area") >= v), (max_area, lambda v: F.col("area") <= v),
                        (min_aspect, lambda v: aspect >= v), (max_aspect, lambda v: aspect <= v),
                        (min_extent, lambda v: extent >= v)):
        if bound is not None:
            ok = ok & cond(float(bound))
    return ok


def region_filter(regions: DataFrame, *args, **bounds) -> DataFrame:
    """Regions that lie ``within`` the bounds."""
    return regions.where(within(*args, **bounds))


def keep_regions(labelled: DataFrame, kept: DataFrame) -> DataFrame:
    """Pieces of the regions that passed."""
    return labelled.join(by_key(kept.select("image_id", "mask", F.col("comp_id").alias("lab"))), ["image_id", "mask", "lab"], "left_semi")


def add_masks(words: DataFrame, pcs: DataFrame, names: list[str]) -> DataFrame:
    """Word table with the masks ``names`` drawn from pieces, replacing columns of the same name."""
    zero = F.lit(0).cast("bigint")
    base_cols = [c for c in words.columns if c not in KEY and c not in names]
    wide = words.select(*KEY, *base_cols, *[zero.alias(n) for n in names])
    drawn = to_words(pcs).select(
        *KEY, *[zero.alias(c) for c in base_cols], *[F.when(F.col("mask") == n, F.col("bits")).otherwise(zero).alias(n) for n in names])
    return wide.unionByName(drawn).groupBy(*KEY).agg(*[F.bit_or(c).alias(c) for c in base_cols + names])


def components(words: DataFrame, masks: list[str], conn: int = 8,
               rows: int = TILE_ROWS, tile_words: int = TILE_WORDS) -> DataFrame:
    """Region of every piece of the masks as they are, without filling."""
    return label(pieces(long_masks(words, masks)), conn, rows, tile_words)
