"""Cases at the edges: tall images, frames without detections, several stream batches, number texts, large sizes."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from terratally.operators import blocks, boxes as B, frames as V, masks as M, regions as Q, responses as P, stats as S
from terratally.plans import modes
from terratally.sources import exports, fixtures as X, ingest


def test_tall_image_is_one_block(spark):
    px = spark.range(35 * 1100).select(
        F.lit(1).cast("bigint").alias("image_id"), F.lit(35).alias("w"), F.lit(1100).alias("h"), (F.col("id") / 35).cast("int").alias("y"), (F.col("id") % 35).cast("int").alias("x"),
        F.lit(60).alias("r"), F.lit(140).alias("g"), F.lit(50).alias("b"))
    images = spark.createDataFrame([(1, 35, 1100)], "image_id bigint, w int, h int")
    assert [(r.estimated_count, r.asset_idx) for r in blocks.block_assets(px, images).collect()] == [(35 * 1100, 1)]


def test_regions_over_tiles_equal_those_of_one_tile(spark):
    rng = np.random.default_rng(5)
    on = rng.random((40, 200)) < 0.55
    rows = [(1, 200, 40, "m", y, xb, int(np.packbits(np.pad(on[y], (0, 56))[xb * 64:xb * 64 + 64], bitorder="little").view(np.int64)[0])) for y in range(40) for xb in range(4)]
    long = spark.createDataFrame(rows, "image_id bigint, w int, h int, mask string, y int, xb int, bits bigint")
    one, many = ({(r.y, r.x0): r.lab for r in Q.label(Q.pieces(long), 8, *t).collect()} for t in ((1024, 16), (8, 1)))
    assert one == many


FRAMES = "video_id bigint, frame_idx int, category string, cnt int, area_px double"


def test_frames_without_detections(spark):
    seen = spark.createDataFrame([(1, 1, "Water Bodies", 2, 10.0), (1, 1, "Solar Panels", 1, 4.0), (1, 5, "Water Bodies", 1, 20.0), (1, 6, "Water Bodies", 9, 9.0)], FRAMES)
    every = spark.range(1, 8).selectExpr("1L AS video_id", "CAST(id AS INT) AS frame_idx")
    full = V.with_empty(seen, every)
    sampled = V.sample_frames(full)  # frames 1, 3, 5, 7
    got = {r.category: (r.frames, r["count"], r.mean_area_px, r.presence_ratio) for r in V.video_category_stats(sampled, 100.0).collect()}
    assert got == {"Water Bodies": (4, 3, 7.5, 0.5), "Solar Panels": (4, 1, 1.0, 0.25)}
    head = V.video_header(full, sampled).first()
    assert (head.source_total_frames, head.detected_frames) == (7, 4)
    carried = {}
    for r in V.carry_forward(full).collect():
        carried.setdefault(r.frame_idx, set()).add((r.category, r.cnt))
    assert carried[1] == carried[2] == {("Water Bodies", 2), ("Solar Panels", 1)}
    assert carried[3] == carried[4] == carried[7] == {(None, 0)} and carried[6] == {("Water Bodies", 1)}


def test_number_texts(spark):
    values = [0.0004, 12345678.5, 0.00001, 1e-7, 2.5e-7, 1e21, 1.5e22, 123456789012345680000.0, 5.0, -0.25, 0.0, 100.0, 1e16, 0.0001, 1234.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    script = ["0.0004", "12345678.5", "0.00001", "1e-7", "2.5e-7", "1e+21", "1.5e+22", "123456789012345680000", "5", "-0.25", "0", "100", "10000000000000000", "0.0001", "1234.5"]
    assert [r[0] for r in df.select(exports.js_number(F.col("v"))).collect()] == script
    assert [r[0] for r in df.select(S.py_number(F.col("v"))).collect()] == [repr(v) for v in values]


def test_large_images_do_not_overflow(spark):
    box = spark.createDataFrame([(1, 1, 0, 0.9, 0.0, 0.0, 10.0, 10.0, 50000, 50000)], "image_id bigint, box_idx int, cls_id int, conf double, x1 double, y1 double, x2 double, y2 double, image_w int, image_h int")
    assert B.boxes_to_assets(B.scan_boxes(box)).first().estimated_area_sq_m == 100.0
    region = spark.createDataFrame([(1, "m", 1, 50000, 50000, 100)], "image_id bigint, mask string, comp_id int, w int, h int, n int")
    assert M.stage_gates(region, "m", 1, 0.0).count() == 1


def test_naming_ids_run_from_one(spark):
    got = {}
    for r in modes.naming_assets(X.boxes(spark, "/root/testdata/sf0.001").where("image_id < 40")).collect():
        got.setdefault(r.image_id, []).append((r.asset_idx, r.confidence_percent, r.unique_id))
    for rows in got.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and all(r[2] == f"naming_asset_{r[0]}" for r in rows)
        assert [r[1] for r in rows] == sorted((r[1] for r in rows), reverse=True)


@pytest.mark.parametrize("name,status", [("a.jpg", "accepted"), ("b.MP4", "accepted"), ("c.txt", "invalid_image_type")])
def test_manifest_feeds_the_gate(spark, tmp_path, name, status):
    (tmp_path / name).write_bytes(b"x")
    assert ingest.ingest_gate(ingest.file_manifest(spark, str(tmp_path))).first().status == status


def test_stated_null_side_is_zero(spark):
    text = '{"detected_assets":[{"category":"Water Bodies","bounding_box":{"x_min":10,"y_min":20,"x_max":null}}]}'
    raw = spark.createDataFrame([(1, text)], "response_id bigint, raw_text string")
    box = P.response_assets(P.parse_response(raw)).first().bounding_box
    assert (box.x_min, box.x_max, box.y_min, box.y_max) == (0.0, 10.0, 20.0, 20.0)


def test_block_mode_keeps_the_stated_figures(spark):
    text = '{"image_analysis":{"overall_detection_confidence_percent":42},"summary_statistics":{"total_assets_detected":5000},"ai_insights":["x","y","z"]}'
    images = X.images(spark, "/root/testdata/sf0.001").where("image_id = 1")
    px = X.pixels(spark, "/root/testdata/sf0.001").where("image_id = 1")
    r = modes.analyze_block(px, images, spark.createDataFrame([(1, text)], "response_id bigint, raw_text string"), shadow_area=12.0, block=31).first()
    assert (r.overall_detection_confidence_percent, r.total_assets_detected, r.ai_insights) == (42.0, 5000, ["x", "y", "z"])


