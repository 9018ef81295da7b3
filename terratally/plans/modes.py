"""The four analysis modes, end to end."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terratally import fixed_values as K
from terratally.functions import clean as C
from terratally.operators import assets as A, blocks, boxes as B, frames as V, heights as H, masks as M, raster as R, regions as Q, responses as P, shadows as W, stats as S
from terratally.operators.ranking import numbered
from terratally.plans import document
from terratally.session import by_key, cut_lineage


def report(images: DataFrame, assets: DataFrame, stats: DataFrame, risk: DataFrame | None) -> DataFrame:
    """One row per image, also those without assets: header figures, land cover, density, risk, heights."""
    agg = assets.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("assets"), F.countDistinct("category").alias("classes"), F.avg("confidence_percent").alias("_conf"),
        F.count_if(F.col("estimated_height_meters") > 0).alias("with_height"), F.max("estimated_height_meters").alias("max_height"))
    summary = S.urban_density(S.image_summary(stats))
    figures = [c for c in summary.columns + agg.columns if c != "image_id"]
    out = images.join(by_key(summary), "image_id", "left").join(by_key(agg), "image_id", "left").fillna(0, figures)
    out = out.withColumn("overall_detection_confidence_percent", C.rounded(F.col("_conf"), 2)).drop("_conf")
    if risk is not None:
        return out.join(by_key(risk), "image_id", "left")
    return out.withColumns({r: F.lit("Unknown") for r in ("encroachment_risk", "drainage_risk", "environmental_risk", "flood_risk")})


def naming_assets(boxes: DataFrame, mpp: float = 1.0) -> DataFrame:
    """Records of the kept boxes, numbered from 1, the most confident first."""
    kept = B.scan_boxes(B.box_nms(B.conf_filter(B.scan_boxes(boxes).drop("class_name"))))
    kept = numbered(kept, ["image_id"], F.floor((1.0 - F.col("conf")) * 64), [F.desc("conf"), "box_idx"], "_n")
    return B.boxes_to_assets(kept.withColumn("box_idx", F.col("_n")).drop("_n"), mpp)


#: What a report, and the heights it states, need of a record.
REPORTED = ["image_id", "asset_idx", "unique_id", "category", "confidence_percent", "estimated_count", "estimated_area_sq_m", "estimated_coverage_percent",
            "shadow_length_pixels", "shadow_length_meters", "estimated_height_meters"]


def analyze_naming(boxes: DataFrame, shadows: DataFrame | None = None, mpp: float = 1.0, additive: bool = False) -> DataFrame:
    """Boxes to a report row per image; box shadows give heights when present."""
    assets = cut_lineage(naming_assets(boxes, mpp).select(*REPORTED, "bounding_box"))
    sized = boxes.groupBy("image_id").agg(F.max("image_w").alias("image_w"), F.max("image_h").alias("image_h"))
    tall = assets
    if shadows is not None:
        sh = H.box_shadows(shadows)
        bld = H.buildings(assets.where(C.is_building(F.col("category"))).join(by_key(sized), "image_id"))
        tall = H.heights_to_assets(assets.drop("bounding_box"), H.building_heights(bld, sh))
    stats = S.category_stats(assets, S.category_stats_rounded(assets) if additive else None)
    area = C.rounded(C.to_area_m2((F.col("image_w").cast("double") * F.col("image_h")), mpp), 2)
    head = sized.select("image_id", F.lit("YOLO Spatial Asset Detection").alias("scene_type"), area.alias("estimated_total_area_sq_m"),
                        F.lit(K.DEFAULT_LAND_USE).alias("dominant_land_use"))
    return report(head, tall, stats, None)


def image_heights(px: DataFrame, assets: DataFrame, images: DataFrame, min_area: float, block: int) -> DataFrame:
    """Write shadow heights, found in the pixels, onto building assets."""
    lab, regions = W.shadow_pieces(px, min_area, block)
    bld = H.buildings(assets.join(images.select("image_id", F.col("w").alias("image_w"), F.col("h").alias("image_h")), "image_id"))
    return cut_lineage(H.heights_to_assets(assets, H.building_heights(bld, W.as_shadows(regions), W.end_points(lab))))


def analyze_map(px: DataFrame, images: DataFrame, scale: float = 1.0, mpp: float = 1.0, shadow_area: float = K.SHADOW_MIN_AREA,
                block: int = K.SHADOW_BLOCK, words: DataFrame | None = None) -> DataFrame:
    """Pixels to a report row per image: masks, regions, coverage, risk, heights."""
    if words is None:
        words = cut_lineage(M.map_masks(px, scale))
    assets = cut_lineage(M.map_assets(words, scale, mpp))
    assets = image_heights(px, assets, images, shadow_area, block)
    counts = assets.groupBy("image_id", "category").agg(F.count(F.lit(1)).alias("count"))
    cover = R.mask_coverage(words, list(M.MAP_MASKS), mpp).withColumn("category", M._named(F.col("mask"), M.MAP_MASKS))
    stats = cover.join(by_key(counts), ["image_id", "category"], "left").select(
        "image_id", A.category_ord(F.col("category")).alias("ord"), "category", F.coalesce("count", F.lit(0)).alias("count"),
        F.col("area_sq_m").alias("total_area_sq_m"), "coverage_percent")
    risk = S.density_labels(S.risk_flags(S.risk_inputs(stats, False), "map")).drop("built", "drains", "green", "water", "road")
    head = images.select("image_id", F.lit("CV Asset Map Analysis").alias("scene_type"),
                         C.rounded(C.to_area_m2((F.col("w").cast("double") * F.col("h")), mpp), 2).alias("estimated_total_area_sq_m"),
                         F.lit(K.DEFAULT_LAND_USE).alias("dominant_land_use"))
    return report(head, assets, stats, risk)


def analyze_block(px: DataFrame, images: DataFrame, responses: DataFrame, mpp: float = 1.0, shadow_area: float = K.SHADOW_MIN_AREA,
                  block: int = K.SHADOW_BLOCK) -> DataFrame:
    """Response header, risk and insights with the image's own blocks as assets."""
    parsed = cut_lineage(P.parse_response(responses))
    local = cut_lineage(blocks.block_assets(px, images, mpp=mpp))
    stated = A.fill_asset_defaults(P.entry_fields(P.explode_assets(parsed)))
    assets = local.unionByName(stated.join(by_key(local.select("image_id").distinct()), "image_id", "left_anti"))
    assets = A.fallback_asset(images, assets.join(images.select("image_id"), "image_id", "left_semi"))
    assets = image_heights(px, assets, images, shadow_area, block)
    stats = S.category_stats(assets, P.incoming_stats(parsed).join(images.select("image_id"), "image_id", "left_semi"))
    head = P.header_fields(parsed).drop("estimated_total_area_sq_m").withColumnRenamed("response_id", "image_id")
    area = C.rounded(C.to_area_m2((F.col("w").cast("double") * F.col("h")), mpp), 2)
    head = images.select("image_id", area.alias("estimated_total_area_sq_m")).join(by_key(head), "image_id", "left")
    texts = ["scene_type", "image_quality", "dominant_land_use", "encroachment_risk", "drainage_risk", "environmental_risk", "flood_risk"]
    head = head.fillna("Unknown", texts).withColumns({
        "ai_insights": F.coalesce("ai_insights", F.array(*[F.lit(t) for t in K.DEFAULT_INSIGHTS])),
        "_stated": F.coalesce("overall_detection_confidence_percent", F.lit(0.0)), "given": F.coalesce("given", F.lit(0).cast("bigint"))})
    counts = assets.groupBy("image_id").agg(F.sum("estimated_count").alias("_counted"))
    risk = head.select("image_id", *texts[3:])
    out = report(head.drop("overall_detection_confidence_percent", *texts[3:]), assets, stats, risk).join(by_key(counts), "image_id", "left")
    # confidence and insights stay those of the response; the total is at least the one it states
    return out.withColumns({
        "overall_detection_confidence_percent": F.col("_stated"),
        "total_assets_detected": F.greatest(F.coalesce("_counted", F.lit(0)), F.col("given"))}).drop("_stated", "_counted", "given")


def analyze_video(frames: DataFrame, frame_px: float, mpp: float = 1.0, fps: float = 0.0) -> DataFrame:
    """Frames to a report row per video: sampling, mean coverage, risk. No heights."""
    sampled = V.sample_frames(frames)
    stats = V.video_category_stats(sampled, frame_px, mpp)
    by = stats.select(F.col("video_id").alias("image_id"), "ord", "category", "count", "total_area_sq_m", "coverage_percent", "confidence_percent")
    risk = S.risk_flags(S.risk_inputs(by, True), "video").drop("built", "drains", "green", "water", "road")
    conf = by.groupBy("image_id").agg(C.rounded(F.avg("confidence_percent"), 2).alias("overall_detection_confidence_percent"))
    head = V.video_header(frames, sampled, fps).withColumnRenamed("video_id", "image_id")
    zero = {c: 0.0 for c in ("green_cover_percent", "built_up_percent", "road_network_percent", "water_body_percent", "open_space_percent", "overall_detection_confidence_percent")}
    out = (head.join(S.image_summary(by), "image_id", "left").join(S.dominant_land_use(by), "image_id", "left")
           .join(conf, "image_id", "left").join(risk, "image_id", "left"))
    out = out.fillna(zero).fillna({"total_assets_detected": 0, "dominant_land_use": "Unknown", "encroachment_risk": "Low",
                                   "drainage_risk": "Low", "environmental_risk": "Moderate", "flood_risk": "Low"})
    return out.withColumns({c: C.rounded(F.col(c), 2) for c in zero if c != "overall_detection_confidence_percent"}).withColumnRenamed("image_id", "video_id")


def nested_payload(assets: DataFrame, part_size: int = 10_000) -> DataFrame:
    """The whole result document per image of records alone, as JSON in bounded parts: cards, statistics, map layers, insights, charts and rows.

    What only a response or a picture could state (risks, total area, insights) stands as unknown.
    """
    stats = S.category_stats(assets)
    conf = assets.groupBy("image_id").agg(C.rounded(F.avg("confidence_percent"), 2).alias("overall_detection_confidence_percent"))
    head = S.urban_density(S.image_summary(stats)).join(by_key(conf), "image_id").withColumns({
        "estimated_total_area_sq_m": F.lit(0.0), **{r: F.lit("Unknown") for r in document.RISKS}, "ai_insights": S.pad_insights(F.array().cast("array<string>"))})
    return document.result_document(head, assets, stats, part_size=part_size)
