"""Shadow regions of an image, ready for matching with buildings."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terratally import fixed_values as K
from terratally.operators import raster as R, regions as Q
from terratally.operators.graylevel import local_mean_threshold
from terratally.session import cut_lineage


def shadow_pieces(px: DataFrame, min_area: float = K.SHADOW_MIN_AREA, block: int = K.SHADOW_BLOCK, c: int = K.SHADOW_C) -> tuple[DataFrame, DataFrame]:
    """Cleaned dark regions: their labelled pieces, and the regions of at least ``min_area``."""
    words = R.banded(local_mean_threshold(px, block, c), ["dark"], 8)
    words = R.core(R.clean(words, {"dark": 3}), ["dark"])
    lab = cut_lineage(Q.labelled_regions(R.long_masks(words, ["dark"])))
    return lab, Q.region_filter(Q.region_stats(lab), min_area=min_area)


def as_shadows(regions: DataFrame) -> DataFrame:
    """Regions in the shape the matching takes."""
    return regions.select(
        "image_id", F.col("comp_id").alias("shadow_id"), "cx", "cy", F.col("min_x").alias("sx0"), F.col("min_y").alias("sy0"),
        (F.col("max_x") + 1).alias("sx1"), (F.col("max_y") + 1).alias("sy1"))


def end_points(lab: DataFrame) -> DataFrame:
    """Row ends of the regions; the farthest point of a region is always one of them."""
    ends = lab.groupBy("image_id", F.col("lab").alias("shadow_id"), "y").agg(F.min("x0").alias("a"), F.max("x1").alias("b"))
    xs = F.array_distinct(F.array("a", "b"))
    pts = ends.select("image_id", "shadow_id", F.explode(xs).alias("px"), F.col("y").cast("double").alias("py"))
    return pts.withColumn("px", F.col("px").cast("double"))
