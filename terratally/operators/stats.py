"""Category, image and collection statistics of assets."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terratally import fixed_values as K
from terratally.functions import clean as C
from terratally.operators.assets import category_ord
from terratally.session import by_key

NAMES = [row[0] for row in K.CATEGORIES]


def _unpivot(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Wide ``<field>_<i>`` columns to one row per category, in category order."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(name).alias("category"), *[F.col(f"{f}_{i}").alias(f) for f in fields])
        for i, name in enumerate(NAMES, 1)])
    return df.select(*keys, F.inline(rows))


def category_stats(assets: DataFrame, incoming: DataFrame | None = None) -> DataFrame:
    """Count, area and coverage per image for all nine categories, zero where absent.

    One grouped pass gives all nine categories, so no image x category product is needed.
    ``incoming`` adds earlier statistics on top (the additive mode).
    """
    part = assets.select(
        "image_id", category_ord(F.col("category")).alias("ord"),
        F.greatest(F.col("estimated_count"), F.lit(0).cast("bigint")).alias("n"),
        F.greatest(F.col("estimated_area_sq_m"), F.lit(0.0)).alias("a"),
        C.clamp(F.col("estimated_coverage_percent")).alias("c"))
    if incoming is not None:
        part = part.unionByName(incoming.select(
            "image_id", "ord", F.col("count").alias("n"), F.col("total_area_sq_m").alias("a"),
            F.col("coverage_percent").alias("c")))
    aggs = []
    for i in range(1, len(NAMES) + 1):
        hit = F.col("ord") == i
        aggs += [F.coalesce(F.sum(F.when(hit, F.col(s))), F.lit(0)).cast(t).alias(f"{f}_{i}")
                 for s, f, t in (("n", "count", "bigint"), ("a", "total_area_sq_m", "double"), ("c", "coverage_percent", "double"))]
    out = _unpivot(part.groupBy("image_id").agg(*aggs), ["image_id"], ["count", "total_area_sq_m", "coverage_percent"])
    return out.withColumn("coverage_percent", F.least(F.col("coverage_percent"), F.lit(100.0)))


def category_stats_rounded(assets: DataFrame) -> DataFrame:
    """Box-detector variant: area to 2 and coverage to 4 decimals."""
    return category_stats(assets).withColumns({
        "total_area_sq_m": C.rounded(F.col("total_area_sq_m"), 2),
        "coverage_percent": C.rounded(F.col("coverage_percent"), 4)})


def _cov(*names: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("category").isin(*names), F.col("coverage_percent"))), F.lit(0.0))


def image_summary(stats: DataFrame, totals: DataFrame | None = None, built_includes_vehicles: bool = True) -> DataFrame:
    """Totals and land-cover percentages per image; ``totals`` (image_id, given) raises the count.

    Without ``totals`` the count is the sum of category counts.
    """
    built = ["Properties & Buildings"] + (["Vehicles & Parking"] if built_includes_vehicles else [])
    cap = lambda c: F.least(c, F.lit(100.0))
    out = stats.groupBy("image_id").agg(
        F.sum("count").alias("total_assets_detected"),
        cap(_cov("Trees & Green Cover", "Parks & Open Spaces")).alias("green_cover_percent"),
        cap(_cov(*built)).alias("built_up_percent"),
        cap(_cov("Roads & Footpaths")).alias("road_network_percent"),
        cap(_cov("Water Bodies")).alias("water_body_percent"),
        cap(_cov("Parks & Open Spaces")).alias("open_space_percent"))
    if totals is not None:
        out = out.join(by_key(totals), "image_id", "left").withColumn(
            "total_assets_detected", F.greatest("total_assets_detected", F.coalesce("given", F.lit(0)))).drop("given")
    return out


def category_totals(assets: DataFrame) -> DataFrame:
    """Count and area of the categories present."""
    return assets.groupBy("image_id", "category").agg(
        F.sum(F.coalesce("estimated_count", F.lit(1).cast("bigint"))).alias("count"),
        F.sum(F.coalesce("estimated_area_sq_m", F.lit(0.0))).alias("area_sq_m"))


def category_chart(assets: DataFrame, stats: DataFrame) -> DataFrame:
    """Count and area of the categories present, with coverage, colour and layer."""
    actual = category_totals(assets)
    cov = stats.select("image_id", "category", "coverage_percent")
    return actual.join(by_key(cov), ["image_id", "category"], "left").select(
        "image_id", "category", "count", "area_sq_m",
        F.coalesce("coverage_percent", F.lit(0.0)).alias("coverage_percent"),
        C.color_of(F.col("category")).alias("color"), C.layer_of(F.col("category")).alias("layer_id"))


def priority_histogram(assets: DataFrame) -> DataFrame:
    key = F.coalesce(F.nullif(F.col("maintenance_priority"), F.lit("")), F.lit("Unknown"))
    return assets.groupBy("image_id", key.alias("priority")).agg(F.count(F.lit(1)).alias("assets"))


def mean_confidence(images: DataFrame, assets: DataFrame) -> DataFrame:
    """Average confidence per image, 0 for images without assets."""
    avg = assets.groupBy("image_id").agg(F.avg("confidence_percent").alias("m"))
    return images.select("image_id").join(by_key(avg), "image_id", "left").select(
        "image_id", C.rounded(F.least(F.coalesce("m", F.lit(0.0)), F.lit(100.0)), 2).alias("mean_confidence"))


def layer_counts(polygons: DataFrame) -> DataFrame:
    return polygons.groupBy("image_id", "layer_id").agg(F.count(F.lit(1)).alias("polygons"))


def area_count_summary(chart: DataFrame) -> DataFrame:
    """Rows per category plus grand totals per image."""
    return chart.rollup("image_id", "category").agg(
        F.grouping_id().alias("level"), F.sum("count").alias("count"), F.sum("area_sq_m").alias("area_sq_m"),
    ).where("level < 3").select(
        "image_id", F.coalesce("category", F.lit("TOTAL")).alias("category"), "count", "area_sq_m")


def rank_categories(chart: DataFrame) -> DataFrame:
    """Categories by count, largest first; ties keep category order. At most ten rows per image."""
    w = Window.partitionBy("image_id").orderBy(F.desc("count"), category_ord(F.col("category")))
    return chart.withColumn("rank", F.row_number().over(w))


def height_summary(assets: DataFrame) -> DataFrame:
    """Over buildings with a height; images without one give no row."""
    h = F.col("estimated_height_meters")
    return assets.where(C.is_building(F.col("category")) & (h > 0) & C.finite(h).isNotNull()).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("buildings"), F.avg(h).alias("avg_height"),
        F.min(h).alias("min_height"), F.max(h).alias("max_height"))


def dominant_land_use(stats: DataFrame) -> DataFrame:
    """Category of largest positive coverage, first in category order on ties."""
    best = F.max_by("category", F.when(F.col("coverage_percent") > 0, F.struct(F.col("coverage_percent"), -F.col("ord"))))
    return stats.groupBy("image_id").agg(F.coalesce(best, F.lit("Unknown")).alias("dominant_land_use"))


def mode_rollup(assets: DataFrame) -> DataFrame:
    """Assets and area by mode, category and image with all subtotals."""
    return assets.rollup("mode", "category", "image_id").agg(
        F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("assets"),
        F.sum("estimated_area_sq_m").alias("area_sq_m"))


def risk_flags(df: DataFrame, mode: str) -> DataFrame:
    """Four indicators from ``built``, ``drains``, ``green`` and ``water`` columns."""
    built, green, water, inclusive = K.RISK_LIMITS[mode]
    flag = lambda cond: F.when(cond, "Moderate").otherwise("Low")
    wet = F.col("water") >= water if inclusive else F.col("water") > water
    return df.withColumns({
        "encroachment_risk": flag(F.col("built") > built), "drainage_risk": flag(F.col("drains") > 0),
        "environmental_risk": flag(F.col("green") < green), "flood_risk": flag(wet)})


def risk_inputs(stats: DataFrame, built_includes_vehicles: bool) -> DataFrame:
    """Unclamped sums the risk rules look at."""
    built = ["Properties & Buildings"] + (["Vehicles & Parking"] if built_includes_vehicles else [])
    return stats.groupBy("image_id").agg(
        _cov(*built).alias("built"),
        F.sum(F.when(F.col("category") == "Drains & Sewage", F.col("count")).otherwise(0)).alias("drains"),
        _cov("Trees & Green Cover", "Parks & Open Spaces").alias("green"),
        _cov("Water Bodies").alias("water"), _cov("Roads & Footpaths").alias("road"))


def density_label(c: Column, high: float, moderate: float) -> Column:
    return F.when(c >= high, "High").when(c >= moderate, "Moderate").otherwise("Low")


def density_labels(df: DataFrame) -> DataFrame:
    return df.withColumns({"green_density": density_label(F.col("green"), 60, 30),
                           "road_density": density_label(F.col("road"), 10, 4)})


def urban_density(summary: DataFrame) -> DataFrame:
    s = F.col("built_up_percent") + F.col("road_network_percent") + F.col("green_cover_percent")
    return summary.withColumn("urban_density_score", C.rounded(s / 3.0, 2))


def present_categories(assets: DataFrame) -> DataFrame:
    return assets.select("image_id", "category").distinct()


def distinct_layers(chart: DataFrame) -> DataFrame:
    return chart.select("image_id", "layer_id").distinct()


def pad_insights(texts: Column) -> Column:
    """Drop blanks, fill up to three, keep the first five."""
    kept = F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))
    kept = F.coalesce(kept, F.array().cast("array<string>"))
    fill = F.array_repeat(F.lit(K.TEXT_FILLER_INSIGHT), F.greatest(F.lit(3) - F.size(kept), F.lit(0)))
    return F.slice(F.concat(kept, fill), 1, 5)


def py_number(c: Column) -> Column:
    """Double as text with a point, and no exponent from 1e-4 up to 1e16, e.g. ``12.5`` and ``0.0``."""
    size = F.abs(c)
    plain = (c == 0) | ((size >= 1e-4) & (size < 1e16))
    odd = F.isnan(c) | (size == float("inf"))
    text = F.concat(C.plain_digits(c), F.when((size >= 1e15) | (c == F.floor(c)), ".0").otherwise(""))
    return F.when(plain, text).when(odd, F.lower(c.cast("string"))).otherwise(C.with_exponent(c, 2))


def governance_insights(df: DataFrame) -> DataFrame:
    """Three sentences from total, classes, green, built, flood and drainage columns."""
    return df.withColumn("governance_insights", F.array(
        F.format_string("Detected %d assets across %d classes.", F.col("total"), F.col("classes")),
        F.concat(F.lit("Green cover is "), py_number(F.col("green")), F.lit("% while built-up coverage is "),
                 py_number(F.col("built")), F.lit("%.")),
        F.concat(F.lit("Flood risk indicator: "), F.col("flood_risk"), F.lit("; drainage risk: "),
                 F.col("drainage_risk"), F.lit("."))))


def map_insights(df: DataFrame) -> Column:
    return F.array(
        F.format_string("Green density is %s (%.2f%%).", F.col("green_density"), F.col("green")),
        F.format_string("Road density is %s (%.2f%%).", F.col("road_density"), F.col("road")),
        F.format_string("Urban risk score inferred from CV masks is %s.", F.col("flood_risk")))


def naming_insights(model: str) -> Column:
    """Sentences from ``image_w``, ``image_h`` and the number of ``assets``."""
    first, second, third = K.NAMING_INSIGHTS
    return F.array(F.format_string(first, F.lit(model), "image_w", "image_h"), F.format_string(second, "assets"), F.lit(third))


def video_insights(width: int, height: int) -> Column:
    """Sentences from the columns of a video report."""
    first, second, third = K.VIDEO_INSIGHTS
    return F.array(
        F.format_string(first, "processed_frames", "fps", F.lit(width), F.lit(height), "detected_frames", "frame_stride"),
        F.lit(second), F.format_string(third, "dominant_land_use"))


def naming_warnings(mpp: float = 1.0) -> Column:
    """No-detection notice, if any, and the calibration used."""
    return F.array_compact(F.array(F.when(F.col("assets") == 0, K.WARN_NO_BOXES), F.lit(K.WARN_SCALE % float(mpp))))
