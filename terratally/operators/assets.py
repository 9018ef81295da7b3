"""The 18-field asset record: cleaning, defaults and flat rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terratally import fixed_values as K
from terratally.functions import clean as C, geometry as G
from terratally.session import by_key, dealt

ASSET_FIELDS = [
    "image_id", "asset_idx", "unique_id", "category", "subcategory", "confidence_percent", "estimated_count",
    "estimated_area_sq_m", "estimated_dimensions_m", "estimated_coverage_percent", "condition_status",
    "maintenance_priority", "center_coordinates", "bounding_box", "polygon_coordinates", "visual_description",
    "estimation_basis", "shadow_length_pixels", "shadow_length_meters", "estimated_height_meters",
]


def categories(spark: SparkSession) -> DataFrame:
    """The category dimension: nine rows, fixed."""
    rows = [(i, c, layer, color, key) for i, (c, layer, color, _, _, key) in enumerate(K.CATEGORIES, 1)]
    return spark.createDataFrame(rows, "ord int, category string, layer_id string, color string, mask_key string")


def category_ord(category: Column) -> Column:
    pairs = [F.lit(x) for i, row in enumerate(K.CATEGORIES, 1) for x in (row[0], i)]
    return F.coalesce(F.create_map(*pairs)[category], F.lit(len(K.CATEGORIES) + 1))


def _floor0(c: Column) -> Column:
    return F.greatest(C.safe_float(c), F.lit(0.0))


def fill_asset_defaults(raw: DataFrame) -> DataFrame:
    """Full record from loosely typed fields, field by field; keeps extra columns out."""
    b = F.col("bounding_box")
    df = raw.withColumns({n: C.clamp(b[n]) for n in ("x_min", "y_min", "x_max", "y_max")})
    df = df.withColumns({hi: F.when(b[hi].isNull(), F.col(lo)).otherwise(F.col(hi)) for lo, hi in (("x_min", "x_max"), ("y_min", "y_max"))})
    df = df.withColumns({"_x0": F.least("x_min", "x_max"), "_y0": F.least("y_min", "y_max"),
                         "_x9": F.greatest("x_min", "x_max"), "_y9": F.greatest("y_min", "y_max")})
    corners = {"x_min": F.col("_x0"), "y_min": F.col("_y0"), "x_max": F.col("_x9"), "y_max": F.col("_y9")}
    dims = F.col("estimated_dimensions_m")
    fallback_id = F.concat(F.lit("asset_"), F.col("asset_idx").cast("string"))
    return df.select(
        "image_id", "asset_idx",
        C.safe_text(F.col("unique_id"), fallback_id).alias("unique_id"),
        C.normalize_category(F.col("category")).alias("category"),
        C.safe_text(C.either_text(F.col("subcategory"), F.col("subtype")), K.TEXT_SUBCATEGORY).alias("subcategory"),
        C.clamp(F.col("confidence_percent")).alias("confidence_percent"),
        F.greatest(C.safe_int(F.col("estimated_count"), 1), F.lit(0).cast("bigint")).alias("estimated_count"),
        _floor0(F.col("estimated_area_sq_m")).alias("estimated_area_sq_m"),
        F.struct(_floor0(dims["length"]).alias("length"), _floor0(dims["width"]).alias("width")).alias("estimated_dimensions_m"),
        C.clamp(F.col("estimated_coverage_percent")).alias("estimated_coverage_percent"),
        C.safe_text(F.col("condition_status"), K.TEXT_CONDITION).alias("condition_status"),
        C.safe_text(F.col("maintenance_priority"), K.TEXT_PRIORITY).alias("maintenance_priority"),
        G.repair_point(F.col("center_coordinates")).alias("center_coordinates"),
        F.struct(*[c.alias(n) for n, c in corners.items()]).alias("bounding_box"),
        G.repair_polygon(F.col("polygon_coordinates"), corners).alias("polygon_coordinates"),
        C.safe_text(F.col("visual_description"), K.TEXT_DESCRIPTION).alias("visual_description"),
        C.safe_text(F.col("estimation_basis"), K.TEXT_BASIS).alias("estimation_basis"),
        _floor0(F.col("shadow_length_pixels")).alias("shadow_length_pixels"),
        _floor0(F.col("shadow_length_meters")).alias("shadow_length_meters"),
        _floor0(F.col("estimated_height_meters")).alias("estimated_height_meters"),
    )


def default_assets(images: DataFrame) -> DataFrame:
    """One placeholder record per image."""
    zero_pt = G.point(F.lit(0.0), F.lit(0.0))
    return images.select(
        "image_id", F.lit(1).alias("asset_idx"), F.lit("asset_1").alias("unique_id"),
        F.lit(K.DEFAULT_CATEGORY).alias("category"), F.lit("Unknown").alias("subcategory"),
        F.lit(0.0).alias("confidence_percent"), F.lit(0).cast("bigint").alias("estimated_count"),
        F.lit(0.0).alias("estimated_area_sq_m"),
        F.struct(F.lit(0.0).alias("length"), F.lit(0.0).alias("width")).alias("estimated_dimensions_m"),
        F.lit(0.0).alias("estimated_coverage_percent"), F.lit(K.TEXT_CONDITION).alias("condition_status"),
        F.lit(K.TEXT_PRIORITY).alias("maintenance_priority"), zero_pt.alias("center_coordinates"),
        F.struct(*[F.lit(0.0).alias(n) for n in ("x_min", "y_min", "x_max", "y_max")]).alias("bounding_box"),
        F.array(zero_pt).alias("polygon_coordinates"),
        F.lit(K.TEXT_FALLBACK_DESCRIPTION).alias("visual_description"),
        F.lit(K.TEXT_FALLBACK_BASIS).alias("estimation_basis"),
        F.lit(0.0).alias("shadow_length_pixels"), F.lit(0.0).alias("shadow_length_meters"),
        F.lit(0.0).alias("estimated_height_meters"),
    )


def fallback_asset(images: DataFrame, assets: DataFrame, parts: int | None = None) -> DataFrame:
    """Give every image without a record one placeholder. ``parts``: partitions of the look-up, if not the session's number."""
    has = dealt(assets.select("image_id"), parts, "image_id").distinct()
    bare = dealt(images.select("image_id"), parts, "image_id").join(by_key(has), "image_id", "left_anti")
    return assets.unionByName(default_assets(bare))


def row_columns() -> list[Column]:
    c = F.col
    return [
        c("unique_id").alias("id"), c("category"), c("subcategory"),
        c("estimated_count").alias("count"), c("estimated_area_sq_m").alias("area_sq_m"),
        c("estimated_coverage_percent").alias("coverage_percent"), c("confidence_percent"),
        c("maintenance_priority").alias("priority"), c("condition_status").alias("condition"),
        c("center_coordinates.x").alias("center_x"), c("center_coordinates.y").alias("center_y"),
        *map(c, ("visual_description", "estimation_basis", "shadow_length_pixels", "shadow_length_meters", "estimated_height_meters"))]


def asset_rows(assets: DataFrame) -> DataFrame:
    """Flat table rows of the records."""
    return assets.select("image_id", "asset_idx", *row_columns())


def flatten_assets(assets: DataFrame) -> DataFrame:
    """Records without nested fields; the polygon becomes ``x y`` pairs joined by ``;``."""
    return assets.select(
        *[c for c in ASSET_FIELDS if c not in
          ("estimated_dimensions_m", "center_coordinates", "bounding_box", "polygon_coordinates")],
        F.col("estimated_dimensions_m.length").alias("length"), F.col("estimated_dimensions_m.width").alias("width"),
        F.col("center_coordinates.x").alias("center_x"), F.col("center_coordinates.y").alias("center_y"),
        "bounding_box.x_min", "bounding_box.y_min", "bounding_box.x_max", "bounding_box.y_max",
        points_text(F.col("polygon_coordinates")).alias("polygon"),
    )


def points_text(points: Column) -> Column:
    """Points as text with whole thousandths, the same in any engine."""
    def milli(c: Column) -> Column:
        return F.bround(c * 1000).cast("bigint").cast("string")
    return F.array_join(F.transform(points, lambda p: F.concat(milli(p["x"]), F.lit(" "), milli(p["y"]))), ";")


