"""Hand-written cases."""
import json
import math

import pytest
from pyspark.sql import functions as F

from terratally.functions import clean as C, geometry as G
from terratally.operators import assets as A, boxes as B, frames as V, responses as P, stats as S
from terratally.operators.ranking import carry_last, numbered
from terratally.sources import exports, ingest


def one(spark, value, fn, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize("text,want", [
    ("parking lot", "Parks & Open Spaces"), ("street", "Trees & Green Cover"), ("storm water drain", "Water Bodies"),
    ("underground drain", "Parks & Open Spaces"), ("greenhouse", "Trees & Green Cover"), ("solar panel", "Solar Panels"),
    ("", "Properties & Buildings"), (None, "Properties & Buildings"), ("xyz", "Properties & Buildings"),
    ("WATER BODIES", "Water Bodies"), ("waste water", "Water Bodies"), ("footpath", "Roads & Footpaths")])
def test_category(spark, text, want):
    assert one(spark, text, C.normalize_category) == want


@pytest.mark.parametrize("text,want", [
    ("Water-Bodies", "Water Bodies"), ("open spaces", "Parks & Open Spaces"), ("class_5", "Properties & Buildings"),
    ("vehicles_parking", "Parks & Open Spaces"), (" Trees ", "Trees & Green Cover")])
def test_class_alias(spark, text, want):
    assert one(spark, text, C.class_to_category) == want


@pytest.mark.parametrize("text,number,whole,bounded", [
    ("5", 5.0, 5, 5.0), (" 5 ", 5.0, 5, 5.0), ("1e3", 1000.0, 1000, 100.0), ("abc", 7.0, 3, 0.0), (None, 7.0, 3, 0.0),
    ("NaN", 7.0, 3, 0.0), ("Infinity", math.inf, 3, 100.0), ("-3", -3.0, -3, 0.0), ("250", 250.0, 250, 100.0), ("2.9", 2.9, 2, 2.9)])
def test_numbers(spark, text, number, whole, bounded):
    assert one(spark, text, lambda c: C.safe_float(c, 7.0)) == number
    assert one(spark, text, lambda c: C.safe_int(c, 3)) == whole
    assert one(spark, text, C.clamp) == bounded


FENCE = "```"


@pytest.mark.parametrize("raw,usable,warning", [
    (FENCE + 'json\n{"a":1}\n' + FENCE, True, None), ('note {"a":1} end', True, None), ('{"a":[1,2,],}', True, None),
    ('{"a":\n1}', True, None), ("[1,2]", False, P.K.WARN_NOT_OBJECT), ("", False, P.K.WARN_EMPTY), (None, False, P.K.WARN_EMPTY),
    ("words", False, P.K.WARN_PARSE)])
def test_responses(spark, raw, usable, warning):
    df = spark.createDataFrame([(1, raw)], "response_id bigint, raw_text string")
    r = P.parse_response(df).select(F.col("doc").isNotNull(), "parse_warning").first()
    assert (r[0], r[1]) == (usable, warning)


def test_response_assets(spark):
    doc = {"detected_assets": [5, {"category": "pond", "bounding_box": {"x_min": 90, "x_max": 10, "y_min": 5}, "estimated_count": "2",
                                   "polygon_coordinates": [{"x": 1, "y": 2}, 7, {"x": 3, "y": 400}, {"x": -5}]}]}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, '{"detected_assets": "x"}')], "response_id bigint, raw_text string")
    parsed = P.parse_response(df)
    rows = {r.image_id: r for r in P.response_assets(parsed).collect()}
    a = rows[1]
    assert (a.asset_idx, a.category, a.unique_id, a.estimated_count) == (2, "Water Bodies", "asset_2", 2)
    assert tuple(a.bounding_box) == (10.0, 5.0, 90.0, 5.0)
    assert [tuple(p) for p in a.polygon_coordinates] == [(1.0, 2.0), (3.0, 100.0), (0.0, 0.0)]
    assert rows[2].visual_description == P.K.TEXT_FALLBACK_DESCRIPTION
    warn = {r.response_id: r.warnings for r in P.collect_warnings(parsed).collect()}
    assert warn[1] == ["Asset entry #1 is invalid and was skipped."]
    assert warn[2] == [P.K.WARN_NO_LIST, P.K.WARN_NO_ASSETS]


@pytest.mark.parametrize("total,want", [(0, 2), (299, 2), (300, 2), (899, 2), (900, 3), (3000, 10)])
def test_stride(spark, total, want):
    assert one(spark, total, V.frame_stride, "int") == want


@pytest.mark.parametrize("box,want", [
    ((10.0, 10.0, 50.0, 50.0), (10, 10, 50, 50)), ((-5.0, 0.0, 100.0, 100.0), (0, 0, 99, 99)), ((0.0, 0.0, 101.0, 50.0), (0, 0, 99, 50)),
    ((50.0, 50.0, 10.0, 10.0), (10, 10, 50, 50)), ((10.0, 10.0, 10.0, 50.0), None), ((0.5, 0.0, 2.5, 3.5), (0, 0, 2, 4))])
def test_pixel_box(spark, box, want):
    df = spark.createDataFrame([(box,)], "b struct<x_min:double,y_min:double,x_max:double,y_max:double>")
    r = G.with_pixel_box(df, F.col("b"), F.lit(100), F.lit(100)).first()
    assert (None if r.x1 is None else (r.x1, r.y1, r.x2, r.y2)) == want


@pytest.mark.parametrize("angle,want", [(0.0, 10 * math.tan(math.radians(0.001))), (45.0, 10.0), (90.0, 10 * math.tan(math.radians(89.9)))])
def test_height(spark, angle, want):
    assert one(spark, angle, lambda c: G.height_from_shadow(F.lit(10.0), c), "double") == pytest.approx(want)


def test_ray_from_center(spark):
    df = spark.createDataFrame([((0, 0, 10, 10),)], "b struct<x1:int,y1:int,x2:int,y2:int>")
    at = lambda x, y: tuple(df.select(G.ray_exit(F.col("b"), F.lit(x), F.lit(y))).first()[0])
    assert at(5.0, 5.0) == (5.0, 5.0)
    assert at(25.0, 5.0) == (10.0, 5.0)
    assert at(5.0, -8.0) == (5.0, 0.0)


def test_exports(spark):
    polys = spark.createDataFrame([(1, 1, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]), (1, 2, [])], "image_id int, asset_idx int, coordinates array<array<double>>")
    for c in ("id", "category", "subcategory", "maintenance_priority", "condition_status", "color", "layer_id"):
        polys = polys.withColumn(c, F.lit('a "b"'))
    rows = exports.to_geojson(polys.withColumn("confidence_percent", F.lit(5.0))).collect()
    assert len(rows) == 1
    feature = json.loads(rows[0].feature_json)
    assert feature["geometry"]["coordinates"] == [[[2.0, 1.0], [4.0, 3.0], [6.0, 5.0], [2.0, 1.0]]]
    assert len(feature["properties"]) == 8
    flat = A.asset_rows(A.default_assets(spark.range(1).select(F.col("id").alias("image_id")))).withColumn("subcategory", F.lit('x "y", z'))
    flat = flat.withColumns({"area_sq_m": F.lit(1.0), "coverage_percent": F.lit(2.5)}).withColumn("estimated_height_meters", F.lit(None).cast("double"))
    line = exports.to_csv(flat).first().line
    assert line == '"asset_1","Properties & Buildings","x ""y"", z","0","1","2.5","0","Medium","Unknown","0","0","0","0","0"'


def test_gate_and_kind(spark):
    rows = [("image", "nope", "image/png", "a.png", 5), ("image", "block_analysis", "text/plain", "a.png", 5), ("video", None, "x/y", "a.TXT", 5),
            ("video", None, "x/y", "a.MKV", 0), ("image", "block_analysis", "image/png", "a.png", 50 * 1024 * 1024 + 1), ("video", None, None, "noext", 9)]
    df = spark.createDataFrame(rows, "kind string, mode string, content_type string, filename string, size_bytes bigint")
    got = [(r.status, r.http_code) for r in ingest.ingest_gate(df).collect()]
    assert got == [("invalid_analysis_mode", 400), ("invalid_image_type", 400), ("invalid_video_type", 400), ("empty_file", 400),
                   ("file_too_large", 413), ("accepted", 200)]
    assert [r.media_kind for r in ingest.media_kind(df).collect()] == ["image", "image", None, "video", "image", None]


def test_numbering_and_carry_split(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("int").alias("t"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    for r in numbered(df, ["g"], F.floor(F.col("t") / 50), ["t"], "n").collect():
        assert r.n == r.t // 3 + 1
    known = {}
    got = {(r.g, r.t): r.v for r in carry_last(df, ["g"], "t", ["v"], block=16).collect()}
    for t in range(1000):
        if t % 7 == 0:
            known[t % 3] = t
        assert got[(t % 3, t)] == known.get(t % 3)


def test_pad_insights(spark):
    df = spark.createDataFrame([([" a ", "", None],), (None,), (list("abcdef"),)], "t array<string>")
    got = [r[0] for r in df.select(S.pad_insights(F.col("t"))).collect()]
    filler = S.K.TEXT_FILLER_INSIGHT
    assert got == [["a", filler, filler], [filler] * 3, list("abcde")]


def test_nms_chain_and_copies(spark):
    """a suppresses b, so c, which only b overlaps, stays; copies of a box leave one."""
    rows = [(1, 1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0, 0.8, 3.0, 0.0, 13.0, 10.0), (1, 3, 0, 0.7, 6.0, 0.0, 16.0, 10.0),
            (1, 4, 1, 0.6, 0.0, 0.0, 10.0, 10.0), (1, 5, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 6, 0, 0.5, 4.0, 4.0, 4.0, 9.0)]
    df = spark.createDataFrame(rows, "image_id bigint, box_idx int, cls_id int, conf double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.box_idx for r in B.box_nms(df).collect()) == [1, 3, 4, 6]
    pairs = {(r.idx_a, r.idx_b): (r.copies_a, r.copies_b) for r in B.iou_pairs(df).collect()}
    assert pairs == {(1, 2): (2, 1), (2, 3): (1, 1), (1, 1): (2, 2)}


def test_additive_doubles(spark):
    df = spark.createDataFrame([(1, "Trees & Green Cover", 3, 5.0, 60.0)], "image_id int, category string, estimated_count bigint, estimated_area_sq_m double, estimated_coverage_percent double")
    base = S.category_stats(df)
    twice = {r.category: r for r in S.category_stats(df, base).collect()}["Trees & Green Cover"]
    assert (twice["count"], twice.total_area_sq_m, twice.coverage_percent) == (6, 10.0, 100.0)
    assert base.count() == 9
