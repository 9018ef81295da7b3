"""GeoJSON, CSV and JSON products."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terratally import fixed_values as K
from terratally.functions import clean as C
from terratally.session import settled


def js_number(c: Column) -> Column:
    """Number as a script engine prints it: no exponent from 1e-6 up to 1e21, whole values without a fraction."""
    size = F.abs(c)
    plain = (c == 0) | ((size >= 1e-6) & (size < 1e21))
    odd = F.isnan(c) | (size == float("inf"))
    return F.when(plain, C.plain_digits(c)).when(odd, c.cast("string")).otherwise(C.with_exponent(c))


def to_geojson(polygons: DataFrame) -> DataFrame:
    """One closed-ring feature per polygon with coordinates, lng before lat."""
    properties = ["id", "category", "subcategory", "confidence_percent", "maintenance_priority", "condition_status", "color", "layer_id"]
    polygons = settled(polygons.select("image_id", "asset_idx", "coordinates", *properties)).where(F.size("coordinates") > 0)
    closed = F.transform(F.concat("coordinates", F.slice("coordinates", 1, 1)), lambda p: F.array(p[1], p[0]))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"))
    return polygons.withColumn("ring", closed).select("image_id", "asset_idx", "ring", F.to_json(feature).alias("feature_json"))


def geojson_collections(features: DataFrame, part_size: int = 10_000) -> DataFrame:
    """FeatureCollection documents per image, in parts of ``part_size`` features by asset index.

    An image of any size becomes several bounded documents instead of one growing row.
    """
    part = F.floor((F.col("asset_idx") - 1) / part_size).cast("int")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("asset_idx", "feature_json"))), lambda f: f["feature_json"])
    return features.groupBy("image_id", part.alias("part")).agg(F.count(F.lit(1)).alias("features"), ordered.alias("_f")).select(
        "image_id", "part", "features",
        F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("_f", ","), F.lit("]}")).alias("geojson"))


def csv_header() -> str:
    return ",".join(K.CSV_COLUMNS)


def to_csv(rows: DataFrame) -> DataFrame:
    """Every value quoted, quotes doubled, missing heights 0; one line per asset row."""
    zero_default = {"shadow_length_pixels", "shadow_length_meters", "estimated_height_meters"}
    types = dict(rows.dtypes)

    def cell(name: str) -> Column:
        c = F.col(name)
        if name in zero_default:
            c = F.coalesce(c, F.lit(0.0))
        text = js_number(c) if types[name] == "double" else c.cast("string")
        return F.concat(F.lit('"'), F.replace(F.coalesce(text, F.lit("null")), F.lit('"'), F.lit('""')), F.lit('"'))

    return rows.select("image_id", "asset_idx", F.concat_ws(",", *[cell(c) for c in K.CSV_COLUMNS]).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with the image id in front of the export columns; file sizes follow the partitions, not the images."""
    rows.select("image_id", *K.CSV_COLUMNS).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def write_geojson(features: DataFrame, path: str) -> None:
    """One feature per line, partitioned over files by Spark."""
    features.select("feature_json").write.mode("overwrite").text(path)


def heights_export(heights: DataFrame) -> DataFrame:
    """Building height records as exported: five fields, box as a list."""
    rec = F.struct(
        F.lit("building").alias("class"), F.array("x1", "y1", "x2", "y2").alias("bbox"),
        "shadow_length_pixels", "shadow_length_meters", "estimated_height_meters")
    return heights.select("image_id", "asset_idx", F.to_json(rec).alias("record"))
