"""Map layers of assets: polygons, markers, heat points, and selections on them."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terratally import fixed_values as K
from terratally.functions import clean as C, geometry as G
from terratally.session import by_key


def category_dim_join(assets: DataFrame, dim: DataFrame) -> DataFrame:
    """Attach layer and colour from the dimension; unknown categories get the defaults. Spark picks the join by size."""
    d = dim.select("category", F.col("layer_id").alias("_l"), F.col("color").alias("_c"))
    return assets.join(d, "category", "left").withColumns({
        "layer_id": F.coalesce("_l", F.lit(K.UNKNOWN_LAYER)), "color": F.coalesce("_c", F.lit(K.UNKNOWN_COLOR)),
    }).drop("_l", "_c")


def placed(assets: DataFrame) -> DataFrame:
    """Assets with the id, layer and colour that map layers show."""
    fallback = F.concat(F.lit("asset_"), F.col("asset_idx").cast("string"))
    return assets.withColumns({
        "id": C.either_text(F.col("unique_id"), fallback),
        "layer_id": C.layer_of(F.col("category")), "color": C.color_of(F.col("category"))})


def polygon_columns(lat0=K.MAP_CENTER_LAT, lng0=K.MAP_CENTER_LNG, span=K.MAP_SPAN) -> list:
    place = lambda p: G.geo_project(p, lat0, lng0, span)
    return [*map(F.col, ("id", "layer_id", "category", "subcategory", "color", "confidence_percent")),
            F.transform("polygon_coordinates", place).alias("coordinates"),
            F.transform(G.ring_from_bbox(F.col("bounding_box")), place).alias("bbox_coordinates"),
            place(F.col("center_coordinates")).alias("center"), F.col("maintenance_priority"), F.col("condition_status")]


def marker_columns(lat0=K.MAP_CENTER_LAT, lng0=K.MAP_CENTER_LNG, span=K.MAP_SPAN) -> list:
    spot = G.geo_project(F.col("center_coordinates"), lat0, lng0, span)
    return [*map(F.col, ("id", "layer_id", "category")), F.col("subcategory").alias("label"), spot[0].alias("lat"), spot[1].alias("lng"),
            *map(F.col, ("color", "confidence_percent", "estimated_area_sq_m"))]


def heat_columns(lat0=K.MAP_CENTER_LAT, lng0=K.MAP_CENTER_LNG, span=K.MAP_SPAN) -> list:
    spot = G.geo_project(F.col("center_coordinates"), lat0, lng0, span)
    return [spot[0].alias("lat"), spot[1].alias("lng"), F.greatest(F.col("confidence_percent") / 100.0, F.lit(0.05)).alias("weight")]


def gis_polygons(assets: DataFrame, lat0=K.MAP_CENTER_LAT, lng0=K.MAP_CENTER_LNG, span=K.MAP_SPAN) -> DataFrame:
    return placed(assets).select("image_id", "asset_idx", *polygon_columns(lat0, lng0, span))


def gis_markers(assets: DataFrame, lat0=K.MAP_CENTER_LAT, lng0=K.MAP_CENTER_LNG, span=K.MAP_SPAN) -> DataFrame:
    return placed(assets).select("image_id", "asset_idx", *marker_columns(lat0, lng0, span))


def heat_points(assets: DataFrame, lat0=K.MAP_CENTER_LAT, lng0=K.MAP_CENTER_LNG, span=K.MAP_SPAN) -> DataFrame:
    return assets.select("image_id", "asset_idx", *heat_columns(lat0, lng0, span))


def renderable_layers(chart: DataFrame, assets: DataFrame) -> DataFrame:
    """Layers whose category occurs among the image's assets."""
    return chart.join(by_key(assets.select("image_id", "category").distinct()), ["image_id", "category"], "left_semi")


def asset_layer_join(assets: DataFrame, layers: DataFrame) -> DataFrame:
    """Assets with the layer of their category; assets without one drop out."""
    return assets.join(by_key(layers.select("image_id", "category", "layer_id", "color")), ["image_id", "category"])


def layer_toggle(df: DataFrame, layers: list[str]) -> DataFrame:
    return df.where(F.col("layer_id").isin(*layers)) if layers else df.where(F.lit(False))


def category_search(df: DataFrame, query: str) -> DataFrame:
    return df.where(F.contains(F.lower("category"), F.lower(F.trim(F.lit(query)))))
