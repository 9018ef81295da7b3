"""Masks with holes filled, and the outer regions, from one labelling of foreground and background.

Foreground is 8-connected, background 4-connected. The pixel to the left of a component's first pixel belongs to the
component that encloses it, so all components of a mask form a tree under the outside. A pixel is in the filled mask if an
ancestor is an outer component, a foreground component directly under the outside, and that component names its region.

A task labels tiles and follows the tree inside them. Components that touch a tile border inside the image stay open:
their links across borders are contracted, the tree of what results is followed by pointer jumping, and the pieces below
them look their region up. Many small tiles go to one task call.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from terratally.operators.regions import TILE_ROWS, TILE_WORDS, border_links, by_tile, contract, united
from terratally.session import by_key, cut_lineage, ship_package

OUT = ("image_id bigint, w int, h int, mask string, y int, x0 bigint, x1 bigint, lab bigint, fg boolean, open boolean, edge boolean, "
       "via bigint, under bigint")


def enclosure_tiles(rows: int, words: int):
    """Function from the words of tiles to labelled pieces, without the background that is surely outside.

    ``via`` names the open component (or the one above) whose region decides; ``under`` the region otherwise.
    """
    side = 64 * words

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = pdf.groupby(["image_id", "_ty", "_tx", "mask"], sort=False).ngroup().to_numpy()
        order = np.lexsort((pdf["xb"], pdf["y"], tile))
        pdf, tile = pdf.iloc[order], tile[order]
        w, h, y, xb = (pdf[c].to_numpy(np.int64) for c in ("w", "h", "y", "xb"))
        on = np.unpackbits(pdf["bits"].to_numpy("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        real = np.arange(64)[None, :] < (w - xb * 64)[:, None]
        at, s, e, ground = [], [], [], []
        for fg, bits in ((1, on & real), (0, ~on & real)):
            pad = np.pad(bits, ((0, 0), (1, 1)))
            first, last = pad[:, 1:-1] & ~pad[:, :-2], pad[:, 1:-1] & ~pad[:, 2:]
            i, j = np.nonzero(first)
            at.append(i)
            s.append(j)
            e.append(np.nonzero(last)[1])
            ground.append(np.full(len(i), fg))
        at, s, e, ground = (np.concatenate(v) for v in (at, s, e, ground))
        code = tile[at] * 2 + ground
        order = np.lexsort((s, xb[at], y[at], code))
        at, code, ground = at[order], code[order], ground[order]
        x0, x1 = xb[at] * 64 + s[order], xb[at] * 64 + e[order]
        y, w, h = y[at], w[at], h[at]
        root = united(code, y, x0, x1, ground)
        lab = y[root] * w + x0[root]

        # components: edges, openness, parents
        n = len(root)
        left, right, top, bottom = x0 == 0, x1 == w - 1, y == 0, y == h - 1
        cut = ((x0 % side == 0) & ~left) | ((x1 % side == side - 1) & ~right) | ((y % rows == 0) & ~top) | ((y % rows == rows - 1) & ~bottom)
        open_, edge = np.zeros(n, bool), np.zeros(n, bool)
        np.logical_or.at(open_, root, cut)
        np.logical_or.at(edge, root, left | right | top | bottom)
        comp = np.flatnonzero(root == np.arange(n))
        height, wide = int(y.max()) + 2, int(x1.max()) + 2
        place = (code * height + y) * wide + x1
        want = ((code[comp] ^ 1) * height + y[comp]) * wide + x0[comp] - 1
        found = np.minimum(np.searchsorted(place, want), n - 1)
        parent = np.where((place[found] == want) & (x0[comp] > 0), root[found], -1)
        up = np.full(n, -1)
        up[comp] = parent
        fg = ground == 1
        outside = ~fg & edge & ~open_  # background that the image border closes
        above = np.where(up >= 0, up, 0)
        loose = (up < 0) | outside[above]  # nothing but the outside above
        stop = open_ | outside | (fg & (loose | (open_[above] & ~fg[above])))
        anchor = np.where(stop, np.arange(n), above)
        while True:
            new = anchor[anchor]
            if (new == anchor).all():
                break
            anchor = new
        a = anchor[root]
        hang = ~open_[a] & (up[a] >= 0) & open_[above[a]]  # closed foreground right under open background
        via = np.where(open_[a], lab[a], np.where(hang, lab[above[a]], -1))
        under = np.where(open_[a], -1, lab[a])
        keep = ~outside[a]
        null = lambda v: pd.array(v, "Int64")
        out = pd.DataFrame({
            "image_id": pdf["image_id"].to_numpy()[at], "w": w, "h": h, "mask": pdf["mask"].to_numpy()[at], "y": y, "x0": x0, "x1": x1,
            "lab": lab, "fg": fg, "open": open_[root], "edge": edge[root], "via": null(via), "under": null(under)})
        out.loc[via < 0, "via"] = pd.NA
        out.loc[under < 0, "under"] = pd.NA
        return out[keep]

    return run


G = ["image_id", "mask"]


def outer_of_open(out: DataFrame, rows: int, words: int) -> DataFrame:
    """For every open component: its outer region, null where it is background that reaches the image border."""
    live = out.where("open")
    links = border_links(live.where("fg"), 1, rows, words).unionByName(border_links(live.where(~F.col("fg")), 0, rows, words))
    roots = contract(links)
    named = cut_lineage(live.groupBy(*G, "lab").agg(F.max("fg").alias("fg"), F.max("edge").alias("edge"), F.max("w").alias("w")).join(by_key(roots), [*G, "lab"], "left")
                        .withColumn("root", F.coalesce("root", "lab")))
    comps = named.groupBy(*G, "root").agg(F.max("fg").alias("fg"), F.max("edge").alias("edge"), F.max("w").alias("w"))
    comps = comps.withColumn("outside", ~F.col("fg") & F.col("edge"))
    # the pixel left of the first one
    first = comps.where("NOT outside AND root % w > 0").select(*G, F.col("root").alias("child"), "fg", F.floor(F.col("root") / F.col("w")).cast("int").alias("y"), (F.col("root") % F.col("w") - 1).alias("x1"))
    beside = live.select(*G, "y", "x1", "lab", (~F.col("fg")).alias("fg"))
    parent = first.join(by_key(beside), [*G, "y", "x1", "fg"]).join(by_key(named.select(*G, "lab", "root")), [*G, "lab"]).select(*G, "child", F.col("root").alias("parent"))
    tree = cut_lineage(comps.join(by_key(parent.withColumnRenamed("child", "root")), [*G, "root"], "left").select(*G, "root", "fg", "outside", "parent"))
    over = tree.select(*G, F.col("root").alias("parent"), F.col("outside").alias("p_outside"), F.col("parent").alias("over"))
    # foreground: the foreground around it, or itself where only the outside is around it
    step = tree.where("fg").join(by_key(over), [*G, "parent"], "left").select(*G, "root", F.coalesce(F.when(~F.col("p_outside"), F.col("over")), F.col("root")).alias("up"))
    step = cut_lineage(step)
    while True:
        two = cut_lineage(step.join(by_key(step.select(*G, F.col("root").alias("up"), F.col("up").alias("next"))), [*G, "up"]).select(*G, "root", F.col("next").alias("up"), (F.col("up") != F.col("next")).alias("moved")))
        step = two.drop("moved")
        if two.where("moved").isEmpty():
            break
    holes = tree.where("NOT fg AND NOT outside").select(*G, "root", "parent").join(by_key(step.select(*G, F.col("root").alias("parent"), "up")), [*G, "parent"]).select(*G, "root", "up")
    return named.select(*G, "lab", "root").join(by_key(step.unionByName(holes)), [*G, "root"], "left").select(*G, F.col("lab").alias("via"), F.col("up").alias("outer"))


def filled_pieces(long: DataFrame, rows: int = TILE_ROWS, words: int = TILE_WORDS) -> DataFrame:
    """Pieces of the masks with holes filled: (image_id, w, h, mask, y, x0, x1, lab), ``lab`` the outer region's first pixel.

    Foreground and filled background are pieces of their own.
    """
    ship_package(long.sparkSession)
    tile = {"_ty": F.floor(F.col("y") / rows), "_tx": F.floor(F.col("xb") / words)}
    df = long.select("image_id", "w", "h", "mask", "y", "xb", "bits").withColumns(tile)
    out = cut_lineage(by_tile(df, ["image_id", "_ty", "_tx"], enclosure_tiles(rows, words), OUT))
    cols = ["image_id", "w", "h", "mask", "y", "x0", "x1"]
    if out.where("open").isEmpty():
        return out.select(*cols, F.col("under").alias("lab"))
    done = out.join(by_key(outer_of_open(out, rows, words)), [*G, "via"], "left").select(*cols, F.coalesce("outer", "under").alias("lab"))
    return done.where("lab IS NOT NULL")
