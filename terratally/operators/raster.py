"""Masks as 64-pixel words, and neighbourhood filters on them.

A mask row is stored as BIGINT words: word ``xb`` holds pixels ``64*xb .. 64*xb+63``,
lowest bit first. Set algebra is bitwise arithmetic, coverage a bit count, and one row
stands for 64 pixels in every shuffle. Neighbourhood filters work on horizontal bands of
an image with a margin of rows copied from the bands next to it, so that an image of any
size is spread over many tasks and one exchange serves a whole chain of filters.
"""
from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from terratally import fixed_values as K
from terratally.functions.color import hsv, in_band
from terratally.session import ship_package

KEY = ["image_id", "w", "h", "y", "xb"]
BAND_ROWS = 512


def pixel_words(px: DataFrame, masks: dict[str, Column], more: dict[str, Column] | None = None) -> DataFrame:
    """Pixel rows to word rows with one BIGINT column per mask condition.

    Conditions are tested inside the aggregates, which Spark compiles into methods of their own: one method that makes
    pixels and tests many bands is longer than the JVM compiles, and runs many times slower. ``more``: further aggregates
    of the pixels of a word.
    """
    bit = F.expr("shiftleft(1L, CAST(x % 64 AS INT))")
    zero = F.lit(0).cast("bigint")
    df = px.withColumns({"xb": F.floor(F.col("x") / 64).cast("int"), "_bit": bit})
    return df.groupBy(*KEY).agg(*[F.coalesce(F.bit_or(F.when(c, F.col("_bit"))), zero).alias(n) for n, c in masks.items()],
                                *[c.alias(n) for n, c in (more or {}).items()])


def bands_of(mode: str) -> dict[str, Column]:
    values = hsv(F.col("r"), F.col("g"), F.col("b"))
    return {n: in_band(b, values) for n, b in K.BANDS[mode].items()}


def band_words(px: DataFrame, mode: str) -> DataFrame:
    """All colour bands of a mode in one pass over the pixels."""
    return pixel_words(px, bands_of(mode))


@dataclass(frozen=True)
class Banded:
    """Word rows to be filtered by band: the masks that the steps read, and the steps so far."""

    words: DataFrame
    masks: tuple[str, ...]
    margin: int
    band: int
    steps: tuple[Callable[["Near", dict], dict], ...] = ()

    def then(self, step: Callable[["Near", dict], dict]) -> "Banded":
        return replace(self, steps=(*self.steps, step))


class Near:
    """Places of the neighbours of the words of whole bands, as arrays over all of them."""

    def __init__(self, pdf: pd.DataFrame):
        tile = pdf.groupby(["image_id", "band"], sort=False).ngroup().to_numpy(np.int64)
        self.y, self.xb, w = (pdf[c].to_numpy(np.int64) for c in ("y", "xb", "w"))
        self.low, self.ok, self.n = int(self.y.min()), _inside(w, self.xb), len(pdf)
        self.rows, self.wide = int(self.y.max()) - self.low + 1, int(self.xb.max()) + 1
        self.tile, self.ok_of = tile, {-1: _inside(w, self.xb - 1), 1: _inside(w, self.xb + 1)}
        code = (tile * self.wide + self.xb) * self.rows + self.y - self.low
        self.order = np.argsort(code, kind="stable")
        self.code, self.sorted, self.found = code, code[self.order], {}

    def at(self, dy: int, dx: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of the word ``dy`` rows below and ``dx`` words to the right, and whether there is one."""
        if (dy, dx) not in self.found:
            want = self.code + dx * self.rows + dy
            place = np.minimum(np.searchsorted(self.sorted, want), self.n - 1)
            y, x = self.y + dy - self.low, self.xb + dx
            there = (self.sorted[place] == want) & (y >= 0) & (y < self.rows) & (x >= 0) & (x < self.wide)
            self.found[dy, dx] = self.order[place], there
        return self.found[dy, dx]

    def grown(self, m: np.ndarray, lo: int, hi: int, gap: bool) -> np.ndarray:
        """Pixels with a set pixel at offsets lo..hi in both directions. ``gap``: words that are missing in a row count as set."""
        m = m & self.ok
        side = {}
        for dx in (-1, 1):
            place, there = self.at(0, dx)
            side[dx] = np.where(there, m[place], self.ok_of[dx] if gap else np.uint64(0))
        row = np.zeros_like(m)
        for d in range(lo, hi + 1):
            k, over = np.uint64(abs(d)), np.uint64(64 - abs(d))
            row |= m if d == 0 else (m >> k) | (side[1] << over) if d > 0 else (m << k) | (side[-1] >> over)
        out = np.zeros_like(m)
        for d in range(lo, hi + 1):
            place, there = self.at(d, 0)
            out |= row if d == 0 else np.where(there, row[place], np.uint64(0))
        return out & self.ok


def _inside(w: np.ndarray, xb: np.ndarray) -> np.ndarray:
    """Bits of word ``xb`` that lie inside an image of width ``w``."""
    left = np.where(xb < 0, 0, np.clip(w - xb * 64, 0, 64))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    return np.where(left > 0, full >> (64 - np.maximum(left, 1)).astype(np.uint64), np.uint64(0))


def banded(words: DataFrame, masks: list[str], margin: int, band: int = BAND_ROWS) -> Banded:
    """Word rows to be filtered by band, each with ``margin`` extra rows; ``masks`` are those that the filters read.

    A chain of filters is one array job over many bands, behind one exchange; ``core`` ends it.
    """
    if margin > 64:
        raise ValueError("a chain of filters may reach at most 64 pixels")
    return Banded(words, tuple(masks), margin, band)


def morph(df: Banded, ops: list[tuple[str, str, str, int, int]]) -> Banded:
    """Box filters on several masks at once: (out, source, "erode" | "dilate", low, high).

    The box spans offsets low..high in both directions; pixels outside the image are ignored. A mask shrinks where what
    is left of the image grows.
    """
    def step(near: Near, v: dict) -> dict:
        grow = lambda m, lo, hi: near.grown(m, lo, hi, False)
        shrink = lambda m, lo, hi: ~near.grown(~m, lo, hi, True) & near.ok
        return {**v, **{out: (shrink if kind == "erode" else grow)(v[src], lo, hi) for out, src, kind, lo, hi in ops}}

    return df.then(step)


def span(k: int) -> tuple[int, int]:
    """Offsets of a k x k box; even boxes reach one further to the top left."""
    return -(k // 2), k - 1 - k // 2


def erode(src: str, k: int, out: str):
    return (out, src, "erode", *span(k))


def dilate(src: str, k: int, out: str):
    return (out, src, "dilate", *span(k))


def clean(df: Banded, sizes: dict[str, int]) -> Banded:
    """Opening, then closing with the same box, per mask. The two dilations in the middle are one."""
    df = morph(df, [erode(m, k, m) for m, k in sizes.items()])
    df = morph(df, [(m, m, "dilate", 2 * span(k)[0], 2 * span(k)[1]) for m, k in sizes.items()])
    return morph(df, [erode(m, k, m) for m, k in sizes.items()])


def combine(df: Banded, **masks: str) -> Banded:
    """Masks as bitwise expressions of other masks, written ``{name}``."""
    code = {m: re.sub(r"\{(\w+)\}", r"\1", text) for m, text in masks.items()}
    return df.then(lambda near, v: {**v, **{m: eval(text, {}, v) for m, text in code.items()}})


def core(df: Banded, masks: list[str], band: int | None = None) -> DataFrame:
    """The filtered words, each from its own band, without the margins."""
    from terratally.operators.regions import by_tile

    read, steps, band = df.masks, df.steps, band or df.band
    margin, last = df.margin, F.floor((F.col("h") - 1) / band)
    ids = F.sequence(F.greatest(F.floor((F.col("y") - margin) / band), F.lit(0)), F.least(F.floor((F.col("y") + margin) / band), last))
    there = [m for m in dict.fromkeys([*read, *masks]) if m in df.words.columns]
    words = df.words.select(*KEY, *[F.coalesce(m, F.lit(0).cast("bigint")).alias(m) for m in there], F.explode(ids).alias("band"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = {m: pdf[m].to_numpy(np.int64).view(np.uint64) for m in read}
        near = Near(pdf)
        for step in steps:
            v = step(near, v)
        own = (near.y // band) == pdf["band"].to_numpy()
        return pdf[own].assign(**{m: v[m].view(np.int64)[own] for m in masks if m in v})

    schema = T.StructType([words.schema[k] for k in KEY] + [T.StructField(m, T.LongType()) for m in masks])
    ship_package(words.sparkSession)
    return by_tile(words, ["image_id", "band"], run, schema)


def word_pixels(words: DataFrame, masks: list[str]) -> DataFrame:
    """Word rows back to pixel rows with boolean columns."""
    df = words.select(*KEY, *masks, F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_i"))
    df = df.where(F.col("xb") * 64 + F.col("_i") < F.col("w"))
    bit = lambda m: F.expr(f"(shiftrightunsigned(`{m}`, _i) & 1L) = 1L")
    return df.select("image_id", "y", (F.col("xb") * 64 + F.col("_i")).alias("x"), *[bit(m).alias(m) for m in masks])


def long_masks(words: DataFrame, masks: list[str]) -> DataFrame:
    """One row per word and mask: (image_id, w, h, mask, y, xb, bits)."""
    rows = F.array(*[F.struct(F.lit(m).alias("mask"), F.col(m).alias("bits")) for m in masks])
    return words.select(*KEY, F.inline(rows))


def mask_coverage(words: DataFrame, masks: list[str], mpp: float = 1.0) -> DataFrame:
    """Pixel count, area and coverage per image and mask."""
    px = F.sum(F.bit_count("bits")).cast("bigint")
    out = long_masks(words, masks).groupBy("image_id", "mask").agg(px.alias("pixels"), F.max("w").alias("_w"), F.max("h").alias("_h"))
    return out.select(
        "image_id", "mask", "pixels", F.bround(F.col("pixels") * float(mpp) ** 2, 2).alias("area_sq_m"),
        F.bround(F.col("pixels") / F.greatest((F.col("_w").cast("double") * F.col("_h")), F.lit(1.0)) * 100.0, 4).alias("coverage_percent"))
