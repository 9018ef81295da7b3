"""Hue, saturation, value and luma of 8-bit colours, and block classes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terratally import fixed_values as K


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma in 15-bit fixed point, rounded: 0.299 r + 0.587 g + 0.114 b."""
    return F.shiftright(r * 9798 + g * 19235 + b * 3735 + 16384, 15)


def hsv(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Hue (0..179), sat and val (0..255) in 12-bit fixed point, and gray, straight from the colours."""
    v = F.greatest(r, g, b)
    d = v - F.least(r, g, b)
    s = F.when(v > 0, F.rint(1044480.0 / v).cast("int")).otherwise(0)
    k = F.when(d > 0, F.rint(122880.0 / d).cast("int")).otherwise(0)
    h = F.shiftright(F.when(v == r, g - b).when(v == g, b - r + d * 2).otherwise(r - g + d * 4) * k + 2048, 12)
    return {"hue": F.when(h < 0, h + 180).otherwise(h), "sat": F.shiftright(d * s + 2048, 12), "val": v, "gray": gray(r, g, b)}


def with_hsv(px: DataFrame) -> DataFrame:
    """Add hue (0..179), sat and val (0..255) in 12-bit fixed point, and gray."""
    return px.withColumns(hsv(F.col("r"), F.col("g"), F.col("b")))


def in_band(band: tuple, of: dict[str, Column] | None = None) -> Column:
    """Inclusive colour band: ("hsv", low, high) or ("gray", low, high). ``of`` holds the values, if they are no columns yet."""
    kind, low, high = band
    of = of or {c: F.col(c) for c in ("hue", "sat", "val", "gray")}
    if kind == "gray":
        return of["gray"].between(low, high)
    out = F.lit(True)
    for c, a, z in zip(("hue", "sat", "val"), low, high):
        out = out & of[c].between(a, z)
    return out


def classify_rgb(r: Column, g: Column, b: Column) -> Column:
    """Land-cover class of a block colour."""
    total = (r + g + b + 1).cast("double")
    return (
        F.when((g / total > K.BLOCK_SHARE) & (g > r + K.BLOCK_LEAD) & (g > b + K.BLOCK_LEAD), "Trees & Green Cover")
        .when((b / total > K.BLOCK_SHARE) & (b > r + K.BLOCK_LEAD) & (b > g + K.BLOCK_LEAD), "Water Bodies")
        .when(F.greatest(r, g, b) < K.BLOCK_DARK, "Roads & Footpaths")
        .when(F.least(r, g, b) > K.BLOCK_BRIGHT, "Properties & Buildings")
        .when((F.abs(r - g) < K.BLOCK_GRAY_SPREAD) & (F.abs(g - b) < K.BLOCK_GRAY_SPREAD),
              F.when(r > K.BLOCK_GRAY_BRIGHT, "Properties & Buildings").otherwise("Roads & Footpaths"))
        .when((r > g) & (g > b) & (r / total <= K.BLOCK_PARK_RED_SHARE), "Parks & Open Spaces")
        .otherwise("Properties & Buildings"))
