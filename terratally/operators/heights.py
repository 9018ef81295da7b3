"""Building heights from shadows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terratally import fixed_values as K
from terratally.functions import clean as C, geometry as G
from terratally.operators.shadow_search import match_shadows
from terratally.session import by_key, cut_lineage


def buildings(assets: DataFrame) -> DataFrame:
    """Building assets with a valid whole-pixel box. Needs image_w and image_h columns."""
    fallback = F.concat(F.lit("building_"), F.col("asset_idx").cast("string"))
    df = G.with_pixel_box(assets.where(C.is_building(F.col("category"))), F.col("bounding_box"), F.col("image_w"), F.col("image_h"))
    return df.where(F.col("x1").isNotNull()).select(
        "image_id", "asset_idx", F.coalesce("unique_id", fallback).alias("unique_id"), "x1", "y1", "x2", "y2")


def box_shadows(shadows: DataFrame) -> DataFrame:
    """Shadow boxes (centre and half sizes) as regions with bounds."""
    return shadows.select(
        "image_id", "shadow_id", "cx", "cy",
        (F.col("cx") - F.col("half_w")).alias("sx0"), (F.col("cy") - F.col("half_h")).alias("sy0"),
        (F.col("cx") + F.col("half_w")).alias("sx1"), (F.col("cy") + F.col("half_h")).alias("sy1"))


def box_shadow_points(regions: DataFrame) -> DataFrame:
    """Corner points of shadow boxes."""
    return regions.select("image_id", "shadow_id", F.inline(F.array(*[
        F.struct(F.col(x).alias("px"), F.col(y).alias("py")) for y in ("sy0", "sy1") for x in ("sx0", "sx1")])))


def farthest_point(matched: DataFrame, points: DataFrame) -> DataFrame:
    """Per matched building, the shadow point farthest from the box centre; first by row, then column, on ties.

    Points come from the matched shadow only; buildings with the same box and shadow share one lookup.
    """
    key = ["image_id", "shadow_id", "x1", "y1", "x2", "y2"]
    cx, cy = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    far = F.max(F.struct(G.distance(cx, cy, F.col("px"), F.col("py")).alias("d"), (-F.col("py")).alias("ny"), (-F.col("px")).alias("nx")))
    best = matched.select(*key).distinct().join(by_key(points), ["image_id", "shadow_id"]).groupBy(*key).agg(far.alias("f"))
    best = best.select(*key, (-F.col("f.nx")).alias("far_x"), (-F.col("f.ny")).alias("far_y"))
    return matched.join(by_key(best), key)


def farthest_corner(matched: DataFrame) -> DataFrame:
    """The same for shadows that are boxes: one of the corners of the matched shadow, which its row has."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    far = F.array_max(F.array(*[
        F.struct(G.distance(cx, cy, F.col(x), F.col(y)).alias("d"), (-F.col(y)).alias("ny"), (-F.col(x)).alias("nx")) for y in ("sy0", "sy1") for x in ("sx0", "sx1")]))
    return matched.withColumn("_f", far).withColumns({"far_x": -F.col("_f.nx"), "far_y": -F.col("_f.ny")}).drop("_f")


def shadow_length(matched_points: DataFrame) -> DataFrame:
    """From the point where the ray to the far point leaves the box, to the far point."""
    b = F.struct("x1", "y1", "x2", "y2")
    out = matched_points.withColumn("_e", G.ray_exit(b, F.col("far_x"), F.col("far_y")))
    return out.withColumn(
        "length_px", G.distance(F.col("_e")["x"], F.col("_e")["y"], F.col("far_x"), F.col("far_y"))
    ).withColumn("exit_x", F.col("_e")["x"]).withColumn("exit_y", F.col("_e")["y"]).drop("_e")


def building_heights(
    bld: DataFrame, shadows: DataFrame, points: DataFrame | None = None,
    mpp: Column | float = K.HEIGHT_MPP, angle: Column | float = K.SOLAR_ELEVATION,
) -> DataFrame:
    """Shadow length and height per building; zeros without a shadow. Rounded to 2 decimals.

    ``points`` of the shadows; without them a shadow is the box of its bounds. The buildings are read three times below, so
    they are written out once first.
    """
    bld = cut_lineage(bld.select("image_id", "asset_idx", "x1", "y1", "x2", "y2"))
    m = mpp if isinstance(mpp, Column) else F.lit(max(float(mpp), 1e-6))
    matched = match_shadows(bld, shadows)
    lengths = shadow_length(farthest_corner(matched) if points is None else farthest_point(matched, points)).select(
        "image_id", "asset_idx", "shadow_id", "length_px")
    px = F.coalesce("length_px", F.lit(0.0))
    return bld.join(by_key(lengths), ["image_id", "asset_idx"], "left").select(
        "image_id", "asset_idx", "x1", "y1", "x2", "y2", "shadow_id",
        C.rounded(px, 2).alias("shadow_length_pixels"), C.rounded(px * m, 2).alias("shadow_length_meters"),
        C.rounded(G.height_from_shadow(px * m, angle), 2).alias("estimated_height_meters"))


def heights_to_assets(assets: DataFrame, heights: DataFrame) -> DataFrame:
    """Write the height fields onto the records by index; others keep their values."""
    cols = ["shadow_length_pixels", "shadow_length_meters", "estimated_height_meters"]
    h = heights.select("image_id", "asset_idx", *[F.col(c).alias(f"_{c}") for c in cols])
    out = assets.join(by_key(h), ["image_id", "asset_idx"], "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in cols}).drop(*[f"_{c}" for c in cols])
