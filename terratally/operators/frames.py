"""Video frame observations: sampling, per-video statistics, carried counts."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from terratally import fixed_values as K
from terratally.functions import clean as C, geometry as G
from terratally.operators.ranking import carry_last
from terratally.operators.stats import NAMES, _unpivot
from terratally.session import by_key


def frame_stride(total, stride: int = K.VIDEO_STRIDE, target: int = K.VIDEO_TARGET_FRAMES):
    """Sampling step of a video with ``total`` source frames."""
    base = max(int(stride), 1)
    auto = F.greatest(F.lit(1), F.floor(total / float(target))).cast("int")
    return F.when(total > 0, F.greatest(F.lit(base), auto)).otherwise(F.lit(base))


def video_totals(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video_id").agg(F.max("frame_idx").alias("total_frames"))


def sample_frames(frames: DataFrame, stride: int = K.VIDEO_STRIDE, target: int = K.VIDEO_TARGET_FRAMES) -> DataFrame:
    """Frame 1 and every k-th after it, k from the video's length."""
    marked = frames.join(video_totals(frames), "video_id").withColumn(
        "stride", frame_stride(F.col("total_frames"), stride, target))
    return marked.where((F.col("frame_idx") - 1) % F.col("stride") == 0)


OBSERVATION = ["category", "cnt", "area_px"]


def with_empty(observations: DataFrame, frames: DataFrame) -> DataFrame:
    """One row per observation, and one for each frame of the frame table (video_id, frame_idx) without any.

    Such a row has no category, count 0 and area 0, so that the frame is sampled, counted in every divisor and clears
    carried counts.
    """
    keys = ["video_id", "frame_idx"]
    out = frames.select(*keys).distinct().join(by_key(observations), keys, "left")
    return out.withColumns({"cnt": F.coalesce("cnt", F.lit(0)), "area_px": F.coalesce("area_px", F.lit(0.0))}).select(
        *observations.columns)


def carry_sampled(frames: DataFrame, hit) -> DataFrame:
    """All frames; those where ``hit`` does not hold show the observations of the last frame where it does.

    The observations of a frame travel together, as an array that the nine categories bound.
    """
    seen = frames.groupBy("video_id", "frame_idx", hit.alias("sampled")).agg(
        F.collect_list(F.struct(*OBSERVATION)).alias("_all"))
    seen = seen.withColumn("_seen", F.when(F.col("sampled"), F.col("_all"))).drop("_all")
    out = carry_last(seen, ["video_id"], "frame_idx", ["_seen"])
    return out.select("video_id", "frame_idx", "sampled", F.explode_outer("_seen").alias("_o")).select(
        "video_id", "frame_idx", "sampled", *[F.col("_o")[c].alias(c) for c in OBSERVATION])


def carry_forward(frames: DataFrame, stride: int = K.VIDEO_STRIDE, target: int = K.VIDEO_TARGET_FRAMES) -> DataFrame:
    """All frames; those not sampled show the observations of the last sampled frame, also if it had none."""
    marked = frames.join(video_totals(frames), "video_id").withColumn(
        "stride", frame_stride(F.col("total_frames"), stride, target))
    return carry_sampled(marked, (F.col("frame_idx") - 1) % F.col("stride") == 0)


def per_frame(frames: DataFrame) -> DataFrame:
    """One row per frame with nine counts and areas, so each frame is counted once."""
    aggs = []
    for i, name in enumerate(NAMES, 1):
        hit = F.col("category") == name
        aggs += [F.coalesce(F.sum(F.when(hit, F.col("cnt"))), F.lit(0)).alias(f"c_{i}"),
                 F.coalesce(F.sum(F.when(hit, F.col("area_px"))), F.lit(0.0)).alias(f"a_{i}")]
    return frames.groupBy("video_id", "frame_idx").agg(*aggs)


def video_category_stats(frames: DataFrame, frame_px: float, mpp=1.0) -> DataFrame:
    """Per video and category: detection events, mean area, coverage, presence ratio.

    ``frames`` are the analysed frames. Categories never seen are left out.
    """
    out = video_totals_by_category(frames)
    mean_px = F.col("area_sum") / F.greatest(F.col("frames").cast("double"), F.lit(1.0))
    coverage = F.least(F.greatest(mean_px / max(float(frame_px), 1.0) * 100.0, F.lit(0.0)), F.lit(100.0))
    presence = F.col("presence") / F.greatest(F.col("frames").cast("double"), F.lit(1.0))
    return out.select(
        "video_id", "ord", "category", "frames", "count", mean_px.alias("mean_area_px"),
        C.to_area_m2(mean_px, mpp).alias("total_area_sq_m"), coverage.alias("coverage_percent"),
        presence.alias("presence_ratio"), C.rounded(C.video_confidence(presence), 2).alias("confidence_percent"),
    ).where((F.col("count") > 0) | (F.col("mean_area_px") > 0))


def video_totals_by_category(frames: DataFrame) -> DataFrame:
    """Summed counts, areas and presence for all nine categories, zero where absent."""
    return totals_of_frames(per_frame(frames))


def totals_of_frames(wide: DataFrame) -> DataFrame:
    """The same from one row per frame."""
    aggs = [F.count(F.lit(1)).alias("frames")]
    for i in range(1, len(NAMES) + 1):
        aggs += [F.sum(f"c_{i}").cast("bigint").alias(f"count_{i}"), F.sum(f"a_{i}").alias(f"area_sum_{i}"),
                 F.count_if((F.col(f"c_{i}") > 0) | (F.col(f"a_{i}") > 0)).alias(f"presence_{i}")]
    return _unpivot(wide.groupBy("video_id").agg(*aggs), ["video_id", "frames"], ["count", "area_sum", "presence"])


def video_header(frames: DataFrame, sampled: DataFrame, fps: float = 0.0) -> DataFrame:
    """Source and analysed frame counts, stride and frame rate per video."""
    rate = float(fps) if fps > 0 else K.VIDEO_DEFAULT_FPS
    src = frames.groupBy("video_id").agg(
        F.max("frame_idx").cast("bigint").alias("source_total_frames"), F.max("frame_idx").cast("bigint").alias("processed_frames"))
    seen = sampled.groupBy("video_id", "frame_idx").agg(F.max("stride").alias("stride")).groupBy("video_id").agg(
        F.count(F.lit(1)).alias("detected_frames"), F.max("stride").alias("frame_stride"))
    return src.join(by_key(seen), "video_id", "left").select(
        "video_id", "source_total_frames", "processed_frames", F.coalesce("detected_frames", F.lit(0)).alias("detected_frames"),
        "frame_stride", F.lit(rate).alias("fps"))


def video_assets(stats: DataFrame) -> DataFrame:
    """Per-category records of a video (fixed centre and box)."""
    key = F.replace(F.replace(F.lower("category"), F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and"))
    box = F.struct(F.lit(5.0).alias("x_min"), F.lit(5.0).alias("y_min"), F.lit(95.0).alias("x_max"), F.lit(95.0).alias("y_max"))
    return stats.select(
        F.col("video_id").alias("image_id"), F.col("ord").alias("asset_idx"),
        F.concat(F.lit("video_"), key).alias("unique_id"), "category",
        F.lit("frame_level_detection").alias("subcategory"), "confidence_percent",
        F.col("count").alias("estimated_count"), C.rounded(F.col("total_area_sq_m"), 2).alias("estimated_area_sq_m"),
        F.struct(F.lit(0.0).alias("length"), F.lit(0.0).alias("width")).alias("estimated_dimensions_m"),
        C.rounded(F.col("coverage_percent"), 4).alias("estimated_coverage_percent"),
        F.lit("Monitored").alias("condition_status"), F.lit("Medium").alias("maintenance_priority"),
        G.point(F.lit(50.0), F.lit(50.0)).alias("center_coordinates"), box.alias("bounding_box"),
        G.ring_from_bbox(box).alias("polygon_coordinates"),
        F.format_string(K.TEXT_FRAME_DESCRIPTION, "category", "frames").alias("visual_description"),
        F.lit(K.TEXT_FRAME_BASIS).alias("estimation_basis"),
        F.lit(0.0).alias("shadow_length_pixels"), F.lit(0.0).alias("shadow_length_meters"), F.lit(0.0).alias("estimated_height_meters"))


def downscale(images: DataFrame, max_dim: int = K.VIDEO_MAX_DIM) -> DataFrame:
    """Working size of frames whose longer side exceeds ``max_dim``, and the area correction."""
    longest = F.greatest("w", "h")
    scale = F.when((F.lit(max_dim) <= 0) | (longest <= max_dim), F.lit(1.0)).otherwise(F.lit(float(max_dim)) / longest)
    return images.withColumn("scale", scale).withColumns({
        "new_w": F.greatest(F.lit(1), F.rint(F.col("w") * F.col("scale")).cast("int")),
        "new_h": F.greatest(F.lit(1), F.rint(F.col("h") * F.col("scale")).cast("int")),
        "area_factor": 1.0 / (F.col("scale") * F.col("scale"))})
