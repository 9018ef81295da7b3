"""Filters that need gray values of neighbours: blur, local mean threshold, edges.

Words with the gray values of 64 pixels are sent to square tiles with a margin; each tile is one bounded array job and
returns mask words. Borders follow the usual image-library rules: mirrored for the blur,
repeated for the local mean and the gradient.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from terratally import fixed_values as K
from terratally.functions.color import gray
from terratally.operators.raster import KEY, pixel_words
from terratally.operators.regions import by_tile, label, pieces, to_words, piece_bits
from terratally.session import by_key, ship_package

TILE = 512
BLUR = np.array([1, 4, 6, 4, 1], np.int64)


def gauss_weights(size: int) -> np.ndarray:
    """Gaussian weights in 16-bit fixed point that sum to 65536."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    g = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    w = np.rint(g / g.sum() * 65536).astype(np.int64)
    w[size // 2] += 65536 - w.sum()
    return w


def smooth(a: np.ndarray, w: np.ndarray, border: str) -> np.ndarray:
    """Separable weighted sums with weights ``w`` along both axes."""
    r = len(w) // 2
    for axis in (0, 1):
        pad = [(r, r) if i == axis else (0, 0) for i in (0, 1)]
        p = np.pad(a, pad, mode=border if a.shape[axis] > 1 else "edge")
        n = a.shape[axis]
        a = sum(k * p.take(range(i, i + n), axis) for i, k in enumerate(w))
    return a


def dark_spots(g: np.ndarray, block: int, c: int) -> np.ndarray:
    blurred = (smooth(g, BLUR, "reflect") + 128) >> 8
    mean = (smooth(blurred, gauss_weights(block), "edge") + (1 << 31)) >> 32
    return blurred - mean <= -c


def ridge(g: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient magnitude and where it is a local maximum above ``low`` along its direction."""
    p = np.pad(g, 1, mode="edge")
    diff_x = p[:, 2:] - p[:, :-2]
    diff_y = p[2:, :] - p[:-2, :]
    dx = diff_x[:-2] + 2 * diff_x[1:-1] + diff_x[2:]
    dy = diff_y[:, :-2] + 2 * diff_y[:, 1:-1] + diff_y[:, 2:]
    mag = np.abs(dx) + np.abs(dy)
    m = np.pad(mag, 1)
    at = lambda sy, sx: m[1 + sy:m.shape[0] - 1 + sy, 1 + sx:m.shape[1] - 1 + sx]
    # 13573 = tan(22.5 degrees) in 15-bit fixed point
    ax, ay = np.abs(dx), np.abs(dy) << 15
    flat, steep = ay < ax * 13573, ay > ax * 13573 + (ax << 16)
    same = (dx ^ dy) >= 0
    first = np.where(same, at(-1, -1), at(-1, 1))
    second = np.where(same, at(1, 1), at(1, -1))
    peak = np.where(flat, (mag > at(0, -1)) & (mag >= at(0, 1)),
                    np.where(steep, (mag > at(-1, 0)) & (mag >= at(1, 0)), (mag > first) & (mag > second)))
    return mag, peak & (mag > low)


#: The gray values of a word's 64 pixels, a byte each: eight BIGINT columns, the first pixel in the lowest byte of the first.
LANES = [f"v{j}" for j in range(8)]


def lanes_of(value) -> dict:
    """Aggregates that put an 8-bit value of the pixels of a word into LANES."""
    byte = F.call_function("shiftleft", value.cast("bigint").bitwiseAND(F.lit(255).cast("bigint")), (F.col("x") % 8 * 8).cast("int"))
    lane = F.floor(F.col("x") / 8) % 8
    return {n: F.coalesce(F.bit_or(F.when(lane == j, byte)), F.lit(0).cast("bigint")) for j, n in enumerate(LANES)}


def gray_words(px: DataFrame, masks: dict | None = None) -> DataFrame:
    """Word rows with LANES of the gray values, and ``masks`` from the same pass over the pixels."""
    return pixel_words(px, masks or {}, lanes_of(gray(F.col("r"), F.col("g"), F.col("b"))))


def _tiles(words: DataFrame, margin: int) -> DataFrame:
    """Words by the tiles that need a pixel of them."""
    df = words.select(*KEY, *LANES)
    first = F.greatest(F.floor((F.col("y") - margin) / TILE), F.lit(0))
    last = F.least(F.floor((F.col("y") + margin) / TILE), F.floor((F.col("h") - 1) / TILE))
    df = df.withColumn("_ty", F.explode(F.sequence(first, last)))
    first = F.greatest(F.floor((F.col("xb") * 64 - margin) / TILE), F.lit(0))
    last = F.least(F.floor((F.col("xb") * 64 + 63 + margin) / TILE), F.floor((F.col("w") - 1) / TILE))
    return df.withColumn("_tx", F.explode(F.sequence(first, last)))


def tile_masks(words: DataFrame, block: int | None = None, c: int = K.SHADOW_C, edges: tuple[int, int] | None = None) -> DataFrame:
    """Word table with ``dark`` (local mean threshold) and/or ``weak`` and ``strong`` edge masks, from gray words."""
    if block is not None:
        block = max(3, int(block) | 1)
    margin = max(2 + block // 2 if block else 0, 2)
    names = (["dark"] if block else []) + (["weak", "strong"] if edges else [])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        image, w, h, ty, tx = (int(pdf[k].iloc[0]) for k in ("image_id", "w", "h", "_ty", "_tx"))
        y0, x0 = max(ty * TILE - margin, 0), max(tx * TILE - margin, 0)
        y9, x9 = min(ty * TILE + TILE + margin, h), min(tx * TILE + TILE + margin, w)
        first, n = x0 // 64, (x9 + 63) // 64 - x0 // 64
        g = np.zeros((y9 - y0, n, 64), np.uint8)
        g[pdf["y"].to_numpy() - y0, pdf["xb"].to_numpy() - first] = np.ascontiguousarray(pdf[LANES].to_numpy("<i8")).view(np.uint8).reshape(-1, 64)
        g = g.reshape(y9 - y0, n * 64)[:, x0 - first * 64:x9 - first * 64].astype(np.int64)
        found = {}
        if block:
            found["dark"] = dark_spots(g, block, c)
        if edges:
            mag, peak = ridge(g, edges[0])
            found["weak"], found["strong"] = peak, peak & (mag > edges[1])
        ya, yz, xa, xz = ty * TILE, min(ty * TILE + TILE, h), tx * TILE, min(tx * TILE + TILE, w)
        nw = (xz - xa + 63) // 64
        out = {"image_id": image, "w": w, "h": h, "y": np.repeat(np.arange(ya, yz), nw),
               "xb": np.tile(np.arange(xa // 64, xa // 64 + nw), yz - ya)}
        for n, m in found.items():
            bits = np.zeros((yz - ya, nw * 64), bool)
            bits[:, :xz - xa] = m[ya - y0:yz - y0, xa - x0:xz - x0]
            out[n] = np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()
        return pd.DataFrame(out)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([one(t) for _, t in pdf.groupby(["image_id", "_ty", "_tx"], sort=False)])

    schema = "image_id bigint, w int, h int, y int, xb int, " + ", ".join(f"{n} bigint" for n in names)
    ship_package(words.sparkSession)
    return by_tile(_tiles(words, margin), ["image_id", "_ty", "_tx"], run, schema)


def local_mean_threshold(px: DataFrame, block: int = K.SHADOW_BLOCK, c: int = K.SHADOW_C) -> DataFrame:
    """Mask ``dark``: blurred gray at least ``c`` below the Gaussian mean of its block."""
    return tile_masks(gray_words(px), block, c)


def edge_map(px: DataFrame, low: int = 60, high: int = 160) -> DataFrame:
    """Words of gradient edges; weak edges stay when their 8-connected line holds a strong pixel."""
    return edge_words(gray_words(px), low, high)


def edge_words(words: DataFrame, low: int = 60, high: int = 160) -> DataFrame:
    """The same from gray words."""
    both = tile_masks(words, edges=(low, high))
    long = both.select("image_id", "w", "h", F.lit("edges").alias("mask"), "y", "xb", F.col("weak").alias("bits"), "strong")
    hit = F.bit_count(F.col("strong").bitwiseAND(piece_bits(F.col("x0"), F.col("x1")))) > 0
    lab = label(pieces(long, "strong").withColumn("hit", hit).drop("strong"), 8)
    live = lab.where("hit").select("image_id", "mask", "lab").distinct()
    return to_words(lab.join(by_key(live), ["image_id", "mask", "lab"], "left_semi"))
