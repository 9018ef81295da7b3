"""Detector boxes: class names, confidence, overlap suppression, asset records."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terratally import fixed_values as K
from terratally.functions import clean as C, geometry as G
from terratally.operators.spatial import rect_join
from terratally.operators.suppress import suppress
from terratally.session import cut_lineage


def class_names(spark, names: dict[int, str] = K.DETECTOR_CLASSES) -> DataFrame:
    return spark.createDataFrame(list(names.items()), "cls_id int, name string")


def scan_boxes(boxes: DataFrame, names: dict[int, str] = K.DETECTOR_CLASSES) -> DataFrame:
    """Resolve class ids to names; unnamed classes become ``class_<id>``, incomplete boxes are dropped."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    name = F.coalesce(F.create_map(*pairs)[F.col("cls_id")], F.concat(F.lit("class_"), F.col("cls_id").cast("string")))
    return boxes.dropna(subset=["cls_id", "conf", "x1", "y1", "x2", "y2"]).withColumn("class_name", name)


def conf_filter(boxes: DataFrame, threshold: float = K.CONF_THRESHOLD) -> DataFrame:
    return boxes.where(F.col("conf") >= threshold)


GEO = ["image_id", "cls_id", "x1", "y1", "x2", "y2"]


def _shapes(boxes: DataFrame, carry: list[str] = (), *apart: Column) -> DataFrame:
    """Distinct boxes with their best member (confidence, then lowest index), its columns ``carry``, and number of copies.

    Boxes that differ in ``apart`` are no copies."""
    best = F.max(F.struct(F.col("conf"), (-F.col("box_idx")).alias("neg"), *carry))
    df = boxes.groupBy(*GEO, *apart).agg(best.alias("b"), F.count(F.lit(1)).alias("copies"))
    return df.select(
        *[c for c in df.columns if c != "b"], F.col("b.conf").alias("conf"), (-F.col("b.neg")).alias("box_idx"), *[F.col(f"b.{c}") for c in carry])


def _overlapping_shapes(shapes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of distinct boxes of one image and class with IoU over the threshold, better box first.

    IoU over ``t`` bounds the ratio of the widths and of the heights by ``1/t``, so the
    partner's own grid is at most ``log4(1/t)`` (rounded up) levels away.
    """
    up, ratio = 0, 1.0
    while ratio < 1.0 / threshold:
        up, ratio = up + 1, ratio * 4.0

    def side(p: str) -> DataFrame:
        return shapes.select(
            "image_id", "cls_id", F.col("conf").alias(f"conf_{p}"), F.col("box_idx").alias(f"idx_{p}"),
            F.col("copies").alias(f"copies_{p}"),
            F.col("x1").alias(f"{p}_x0"), F.col("y1").alias(f"{p}_y0"),
            F.col("x2").alias(f"{p}_x1"), F.col("y2").alias(f"{p}_y1"))

    pairs = rect_join(side("l"), side("r"), ["image_id", "cls_id"], up)
    before = (F.col("conf_l") > F.col("conf_r")) | (
        (F.col("conf_l") == F.col("conf_r")) & (F.col("idx_l") < F.col("idx_r")))
    iw = F.least("l_x1", "r_x1") - F.greatest("l_x0", "r_x0")
    ih = F.least("l_y1", "r_y1") - F.greatest("l_y0", "r_y0")
    inter = F.greatest(iw, F.lit(0.0)) * F.greatest(ih, F.lit(0.0))
    union = ((F.col("l_x1") - F.col("l_x0")) * (F.col("l_y1") - F.col("l_y0"))
             + (F.col("r_x1") - F.col("r_x0")) * (F.col("r_y1") - F.col("r_y0")) - inter)
    iou = F.when(union > 0, inter / union)
    return pairs.where(before).withColumn("iou", iou).where(F.col("iou") > threshold)


def iou_pairs(boxes: DataFrame, threshold: float = K.IOU_THRESHOLD) -> DataFrame:
    """Overlapping box pairs. Exact copies stand as one box with a count; a box that has copies
    also appears paired with itself."""
    shapes = _shapes(boxes)
    pairs = _overlapping_shapes(shapes, threshold).select(
        "image_id", "cls_id", F.col("idx_l").alias("idx_a"), F.col("idx_r").alias("idx_b"),
        F.col("copies_l").alias("copies_a"), F.col("copies_r").alias("copies_b"), "iou")
    selfs = shapes.where("copies > 1 AND x2 > x1 AND y2 > y1").select(
        "image_id", "cls_id", F.col("box_idx").alias("idx_a"), F.col("box_idx").alias("idx_b"),
        F.col("copies").alias("copies_a"), F.col("copies").alias("copies_b"), F.lit(1.0).alias("iou"))
    return pairs.unionByName(selfs)


def box_nms(boxes: DataFrame, threshold: float = K.IOU_THRESHOLD) -> DataFrame:
    """Greedy suppression: a box goes when a better kept box of its class overlaps it.

    Exact copies stand as one box. Boxes without area and boxes with a side that is no finite number overlap nothing and
    all stay. The other columns go along, so that kept boxes are not looked up again.
    """
    flat = ~((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & (F.abs(F.col("x1")) + F.abs(F.col("y1")) + F.abs(F.col("x2")) + F.abs(F.col("y2")) < float("inf")))
    others = [c for c in boxes.columns if c not in (*GEO, "box_idx", "conf")]
    alone = F.when(flat, F.col("box_idx")).alias("_alone")
    shapes = cut_lineage(_shapes(boxes.where(flat.isNotNull()), others, alone).drop("copies"))
    keep = suppress(shapes.where(F.col("_alone").isNull()), threshold, carry=others, written=True)
    return keep.select(boxes.columns).unionByName(shapes.where(F.col("_alone").isNotNull()).select(boxes.columns))


def boxes_to_assets(boxes: DataFrame, mpp=1.0) -> DataFrame:
    """Pixel boxes to asset records in 0..100 coordinates (one asset per box)."""
    edges = (("_x0", "x1", "image_w"), ("_y0", "y1", "image_h"), ("_x9", "x2", "image_w"), ("_y9", "y2", "image_h"))
    df = boxes.withColumns({n: C.clamp(F.col(c) / F.col(s) * 100.0) for n, c, s in edges} | {
        "_bw": F.greatest(F.col("x2") - F.col("x1"), F.lit(0.0)), "_bh": F.greatest(F.col("y2") - F.col("y1"), F.lit(0.0)),
        "_img": F.greatest((F.col("image_w").cast("double") * F.col("image_h")), F.lit(1.0)),
        "category": C.class_to_category(F.col("class_name")), "subcategory": C.safe_text(F.col("class_name"), "unknown")})
    low = {n: F.least(a, b) for n, a, b in (("_x0", "_x0", "_x9"), ("_y0", "_y0", "_y9"))}
    high = {n: F.greatest(a, b) for n, a, b in (("_x9", "_x0", "_x9"), ("_y9", "_y0", "_y9"))}
    df = df.withColumns(low | high).withColumn("_px", F.col("_bw") * F.col("_bh"))
    df = df.withColumns({
        "_cx": C.rounded((F.col("_x0") + F.col("_x9")) / 2.0, 4), "_cy": C.rounded((F.col("_y0") + F.col("_y9")) / 2.0, 4),
        "x_min": C.rounded(F.col("_x0"), 4), "y_min": C.rounded(F.col("_y0"), 4),
        "x_max": C.rounded(F.col("_x9"), 4), "y_max": C.rounded(F.col("_y9"), 4)})
    corners = {n: F.col(n) for n in ("x_min", "y_min", "x_max", "y_max")}
    return df.select(
        "image_id", F.col("box_idx").alias("asset_idx"),
        F.concat(F.lit("naming_asset_"), F.col("box_idx").cast("string")).alias("unique_id"),
        "category", "subcategory",
        C.rounded(C.clamp(F.col("conf") * 100.0), 2).alias("confidence_percent"),
        F.lit(1).cast("bigint").alias("estimated_count"),
        C.rounded(C.to_area_m2(F.col("_px"), mpp), 2).alias("estimated_area_sq_m"),
        F.struct(C.rounded(C.to_length_m(F.col("_bw"), mpp), 2).alias("length"),
                 C.rounded(C.to_length_m(F.col("_bh"), mpp), 2).alias("width")).alias("estimated_dimensions_m"),
        C.rounded(F.col("_px") / F.col("_img") * 100.0, 4).alias("estimated_coverage_percent"),
        F.lit("Monitored").alias("condition_status"), F.lit("Medium").alias("maintenance_priority"),
        G.point(F.col("_cx"), F.col("_cy")).alias("center_coordinates"),
        F.struct(*corners).alias("bounding_box"), G.ring_from_bbox(corners).alias("polygon_coordinates"),
        F.concat("subcategory", F.lit(" detected by YOLO naming model.")).alias("visual_description"),
        F.lit(K.TEXT_BOX_BASIS).alias("estimation_basis"),
        F.lit(0.0).alias("shadow_length_pixels"), F.lit(0.0).alias("shadow_length_meters"),
        F.lit(0.0).alias("estimated_height_meters"),
    )
