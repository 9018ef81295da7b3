"""Registered queries on pixel tables. Area limits are scaled to the small scenes."""
from __future__ import annotations

from pyspark.sql import functions as F

from terratally import fixed_values as K
from terratally.functions.color import classify_rgb, in_band, with_hsv
from terratally.operators import assets as A, blocks, frames as V, graylevel as GL, masks as M, outline as O, raster as R, regions as Q, shadows as W
from terratally.plans import asset_queries as T
from terratally.session import cut_lineage
from terratally.sources import fixtures as X

MAP_SCALE, VIDEO_SCALE, SHADOW_AREA, SHADOW_BLOCK = 1 / 16, 1 / 40, 12.0, 31
BANDS = ["green", "water", "road", "bright", "dark", "waste", "solar"]


def map_words(spark, sf):
    return cut_lineage(M.map_masks(X.pixels(spark, sf), MAP_SCALE))


def video_words(spark, sf):
    return M.video_masks(X.pixels(spark, sf), VIDEO_SCALE)


def bands(spark, sf):
    return R.band_words(X.pixels(spark, sf), "map")


def out(words, *masks):
    return words.select("image_id", "y", "xb", *masks)


def q_rgb_to_hsv(spark, sf):
    return with_hsv(X.pixels(spark, sf)).groupBy("image_id", "y").agg(
        *[F.sum(c).alias("sum_" + c) for c in ("hue", "sat", "val", "gray")],
        *[F.sum(F.col(c) * F.col("x")).alias("moment_" + c) for c in ("hue", "sat", "val", "gray")])


def q_classify_rgb(spark, sf):
    px = X.pixels(spark, sf).withColumn("category", classify_rgb(F.col("r"), F.col("g"), F.col("b")))
    return px.groupBy("image_id", "y", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum_x"))


def q_band_mask(spark, sf):
    return out(bands(spark, sf), *BANDS)


def q_mask_algebra(spark, sf):
    w = bands(spark, sf)
    return w.selectExpr("image_id", "y", "xb", "green | water AS either", "bright & ~green AS only_bright", "road & bright & ~dark AS inner")


def q_mask_coverage(spark, sf):
    return R.mask_coverage(bands(spark, sf), BANDS)


def _filtered(spark, sf, ops, masks):
    w = bands(spark, sf)
    return out(R.core(R.morph(R.banded(w, ["green", "bright"], 16), ops), masks), *masks)


def q_erode(spark, sf):
    return _filtered(spark, sf, [R.erode("green", 5, "odd"), R.erode("bright", 2, "even")], ["odd", "even"])


def q_dilate(spark, sf):
    return _filtered(spark, sf, [R.dilate("green", 9, "odd"), R.dilate("bright", 2, "even")], ["odd", "even"])


def q_open_close(spark, sf):
    w = R.banded(bands(spark, sf), ["green", "bright"], 16)
    return out(R.core(R.clean(w, {"green": 5, "bright": 3}), ["green", "bright"]), "green", "bright")


def q_local_mean_threshold(spark, sf):
    return out(GL.local_mean_threshold(X.pixels(spark, sf), SHADOW_BLOCK), "dark")


def q_edge_map(spark, sf):
    return out(GL.edge_map(X.pixels(spark, sf)), "bits")


def q_components(spark, sf):
    lab = Q.components(bands(spark, sf), ["green", "bright"], 8)
    return lab.groupBy("image_id", "mask", "lab").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))


def q_fill_holes(spark, sf):
    return Q.fill_holes(R.long_masks(bands(spark, sf), ["bright", "road"])).select("image_id", "mask", "y", "xb", "bits")


def _regions(spark, sf):
    return cut_lineage(Q.labelled_regions(R.long_masks(bands(spark, sf), ["bright", "road"])))


def q_region_stats(spark, sf):
    return Q.region_stats(_regions(spark, sf)).drop("w", "h")


def q_region_area(spark, sf):
    return Q.region_stats(_regions(spark, sf)).select("image_id", "mask", "comp_id", F.col("n").alias("pixels"), F.col("area").alias("outline_area"))


def q_region_outline(spark, sf):
    return O.region_outline(_regions(spark, sf)).select("image_id", "mask", "comp_id", A.points_text(F.col("outline")).alias("outline"))


def box_regions(spark, sf):
    """Detector boxes as regions, for the filters."""
    b = X.boxes(spark, sf)
    names = F.element_at(F.array(*[F.lit(m) for m in M.MAP_MASKS]), F.col("cls_id") + 1)
    bw, bh = (F.col("x2") - F.col("x1")).cast("int"), (F.col("y2") - F.col("y1")).cast("int")
    return b.select("image_id", F.col("box_idx").alias("comp_id"), names.alias("mask"), bw.alias("bw"), bh.alias("bh"),
                    (F.floor(bw * F.col("conf")) * bh / 2.0).alias("area"), (bw * bh).alias("n"), F.lit(512).alias("w"), F.lit(384).alias("h"))


def q_region_filter(spark, sf):
    return Q.region_filter(box_regions(spark, sf), 2000, 9000, 1.1, 1.8, 0.2).select("image_id", "comp_id", "mask", "area")


def q_region_filter_map(spark, sf):
    r = box_regions(spark, sf)
    v = r.withColumns({"mask": F.lit("vehicle"), "area": F.col("area") / 100})
    parts = M.region_filter_map(r, "building").unionByName(M.region_filter_map(r, "parks")).unionByName(M.region_filter_map(v, "vehicle"))
    return parts.select("image_id", "comp_id", "mask", "area")


def q_min_area_by_class(spark, sf):
    r = box_regions(spark, sf).withColumns({"mask_key": F.when(F.col("mask") == "road", "other").otherwise(M.mask_keys(F.col("mask"))), "area": F.col("area") / 20})
    return M.min_area_by_class(r).select("image_id", "comp_id", "mask_key")


def q_stage_gates(spark, sf):
    r = box_regions(spark, sf)
    parts = M.stage_gates(r, "building", 2, 4.0).unionByName(M.stage_gates(r, "parks", 2)).unionByName(M.stage_gates(r, "green"))
    return parts.select("image_id", "comp_id", "mask")


def q_union_masks(spark, sf):
    return R.long_masks(bands(spark, sf), BANDS).where("bits <> 0").select("image_id", "mask", "y", "xb", "bits")


def q_grid_downsample(spark, sf):
    return blocks.grid_downsample(X.pixels(spark, sf), images=X.images(spark, sf)).select("image_id", "y", "x", "r", "g", "b")


def q_block_assets(spark, sf):
    return A.flatten_assets(blocks.block_assets(X.pixels(spark, sf), X.images(spark, sf)))


def q_map_assets(spark, sf):
    return A.flatten_assets(M.map_assets(map_words(spark, sf), MAP_SCALE))


def q_frame_observations(spark, sf):
    return M.frame_observations_of(*video_words(spark, sf))


def q_class_map_blend(spark, sf):
    return M.class_map_blend(X.pixels(spark, sf), map_words(spark, sf)).groupBy("image_id", "y").agg(
        *[F.sum(c).alias("sum_" + c) for c in "rgb"], *[F.sum(F.col(c) * F.col("x")).alias("moment_" + c) for c in "rgb"])


def q_downscale_correction(spark, sf):
    b = X.boxes(spark, sf).select("image_id", "box_idx", (F.col("x2") * 4).cast("int").alias("w"), (F.col("y2") * 4).cast("int").alias("h"))
    return V.downscale(b).withColumn("area_factor", F.round("area_factor", 9)).withColumn("scale", F.round("scale", 9))


def q_shadow_regions(spark, sf):
    _, regions = W.shadow_pieces(X.pixels(spark, sf), SHADOW_AREA, SHADOW_BLOCK)
    return regions.drop("w", "h", "mask")


def _mask_query(mode, mask):
    def run(spark, sf):
        px = X.pixels(spark, sf)
        words = M.map_masks(px, MAP_SCALE, [mask]) if mode == "map" else M.video_mask(px, mask, VIDEO_SCALE)
        return words.select("image_id", "y", "xb", F.col(mask).alias("bits"))
    return run


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}
QUERIES |= {f"mask_{mode}_{m}": _mask_query(mode, m) for mode in ("map", "video") for m in M.MAP_MASKS}
