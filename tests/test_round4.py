"""Numbers of line rows, whole documents from records alone, and features whose columns are made once."""
import json

import numpy as np
from pyspark.sql import functions as F

from terratally.operators import assets as A, boxes as B, gis, heights as H, ranking, regions as Q, stats as S, suppress
from terratally.plans import document as D, modes
from terratally.sources import exports, fixtures as X

SF = "/root/testdata/sf0.001"


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_line_rows_move_as_the_table_has_them(spark):
    """Rows were widened to texts before they were dealt out, and met the sizes of their buckets in a join."""
    for df in (X.raw_assets(spark, SF), X.boxes(spark, SF)):
        lines = plan(df)
        assert len([x for x in lines if "Exchange" in x]) == 1 and any("Exchange hashpartitioning(l_orderkey" in x for x in lines)
        assert not any("Join" in x for x in lines)


def test_crowded_images_are_numbered_by_buckets(spark, monkeypatch):
    whole = X.raw_assets(spark, SF)
    want = sorted(map(str, whole.collect()))
    monkeypatch.setattr(X, "crowded", lambda df, keys, rows: ranking.crowded(df, keys, rows, limit=8))
    split = X.raw_assets(spark, SF)
    assert any("Join" in x for x in plan(split)) and sorted(map(str, split.collect())) == want


def test_crowded_finds_every_large_group(spark):
    df = spark.range(20000).select(F.when(F.col("id") < 9000, 7).when(F.col("id") < 9100, None).otherwise(F.col("id")).alias("k"))
    hit = ranking.crowded(df, ["k"], 20000, limit=8000)
    groups = {r.k: r.n for r in df.where(hit).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert groups[7] == 9000 and sum(groups.values()) < 9500 and df.where(~hit).where("k IS NULL").count() == 100
    assert ranking.crowded(df, ["k"], 20000, limit=20000) is None and ranking.crowded(df.where("k > 9100"), ["k"], 10899, limit=8000) is None


def test_polygons_are_not_made_again_for_a_filter(spark):
    polygons = gis.gis_polygons(A.fill_asset_defaults(X.raw_assets(spark, SF)))
    assert not any("Filter" in x and "transform(" in x for x in plan(exports.to_geojson(polygons)))


def test_documents_are_gathered_where_the_image_lies(spark):
    """Lists of an image's parts, its chart and its priorities were dealt out anew, each by its own key."""
    assets = A.fill_asset_defaults(X.raw_assets(spark, SF))
    stats = S.category_stats(assets)
    report = S.urban_density(S.image_summary(stats)).withColumns({
        **{c: F.lit(1.0) for c in ("overall_detection_confidence_percent", "estimated_total_area_sq_m")}, **{r: F.lit("Low") for r in D.RISKS}, "ai_insights": F.lit(None).cast("array<string>")})
    moves = [x for x in plan(D.result_document(report, assets, stats)) if "Exchange" in x and "ReusedExchange" not in x]
    assert moves and all("hashpartitioning(l_orderkey" in x for x in moves)


def test_payload_of_records_is_the_whole_document(spark):
    assets = A.fill_asset_defaults(X.raw_assets(spark, SF).where("image_id < 40"))
    docs = {r.image_id: json.loads(r.payload) for r in modes.nested_payload(assets).collect()}
    want = {r.image_id: r for r in assets.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence_percent").alias("conf"), F.array_sort(F.collect_list(F.struct("asset_idx", "unique_id"))).alias("ids")).collect()}
    assert set(docs) == set(want)
    for i, doc in docs.items():
        assert set(doc) == {"analytics_cards", "asset_statistics", "gis_mapping", "dashboard_insights", "chart_data", "asset_table_rows"}
        assert set(doc["analytics_cards"]) == set(D.CARDS) and set(doc["asset_statistics"]["risk_indicators"].values()) == {"Unknown"}
        ids = [r.unique_id for r in want[i].ids]
        assert [m["id"] for m in doc["gis_mapping"]["leaflet_markers"]] == [p["id"] for p in doc["gis_mapping"]["leaflet_polygons"]] == [r["id"] for r in doc["asset_table_rows"]] == ids
        assert len(doc["gis_mapping"]["heatmap_points"]) == sum(doc["asset_statistics"]["maintenance_priorities"].values()) == want[i].n
        assert abs(doc["analytics_cards"]["overall_detection_confidence_percent"] - want[i].conf) < 0.00501
        assert len(doc["dashboard_insights"]["ai_insights_cards"]) == 3 and len(doc["dashboard_insights"]["governance_insights"]) == 3
    parts = modes.nested_payload(assets, part_size=2).groupBy("image_id").agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("parts"))
    assert all(r.n == want[r.image_id].n and r.parts == -(-r.n // 2) for r in parts.collect())


def written_columns(spark, monkeypatch, module) -> list[list[str]]:
    """Columns of the tables that a module writes out between steps."""
    seen, write = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: seen.append(df.columns) or write(df))
    return seen


def test_naming_report_writes_what_it_reads(spark, monkeypatch):
    """Whole records were written twice, and the corners of all shadows met the matched ones by image and shadow."""
    seen = written_columns(spark, monkeypatch, modes)
    report = modes.analyze_naming(X.boxes(spark, SF), X.shadows(spark, SF))
    assert len(seen) == 1 and not {"polygon_coordinates", "visual_description", "center_coordinates"} & set(seen[0])
    assert not any("Generate" in x and "struct(px," in x for x in plan(report))


def test_corners_of_matched_shadows(spark):
    sh = H.box_shadows(X.shadows(spark, SF))
    rect = F.array(*[F.struct(F.lit(a).alias("x1"), F.lit(b).alias("y1"), F.lit(c).alias("x2"), F.lit(d).alias("y2")) for a, b, c, d in ((10, 20, 50, 90), (0, 0, 1, 1), (200, 100, 300, 220))])
    matched = sh.select("*", F.inline(rect))
    key = ["image_id", "shadow_id", "x1", "y1", "x2", "y2", "far_x", "far_y"]
    want = H.farthest_point(matched.drop("cx", "cy", "sx0", "sy0", "sx1", "sy1"), H.box_shadow_points(sh)).select(key)
    got = H.farthest_corner(matched).select(key)
    assert got.count() == 3 * sh.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_kept_boxes_bring_their_columns(spark, monkeypatch):
    rows = [(1, 0, 1, 0.9, 0.0, 0.0, 10.0, 10.0, "a"), (1, 0, 2, 0.8, 1.0, 0.0, 11.0, 10.0, "b"), (1, 0, 3, 0.9, 0.0, 0.0, 10.0, 10.0, "c"), (1, 0, 4, 0.3, 5.0, 5.0, 5.0, 9.0, "d"),
            (1, 0, 5, 0.3, 5.0, 5.0, 5.0, 9.0, "e"), (1, 1, 6, 0.8, 1.0, 0.0, 11.0, 10.0, "f"), (2, 0, 1, 0.5, float("nan"), 0.0, 1.0, 1.0, "g"), (2, 0, 2, 0.5, None, 0.0, 1.0, 1.0, "h")]
    boxes = spark.createDataFrame(rows, "image_id bigint, cls_id int, box_idx int, conf double, x1 double, y1 double, x2 double, y2 double, note string")
    kept = B.box_nms(boxes)
    assert kept.columns == boxes.columns and sorted((r.image_id, r.box_idx, r.note) for r in kept.collect()) == [(1, 1, "a"), (1, 4, "d"), (1, 5, "e"), (1, 6, "f"), (2, 1, "g")]
    seen = []
    monkeypatch.setattr(B, "suppress", lambda df, t, **k: seen.append(df) or suppress.suppress(df, t, **k))
    assert not any("Join" in x for x in plan(B.box_nms(X.boxes(spark, SF)))) and len(seen) == 1


def test_corners_are_counted_where_the_tile_is(spark):
    """Words went to six neighbours each, were joined with their pieces again, and pieces with the links that tiles did not have."""
    long = X.pixels(spark, SF).where("x < 64").groupBy("image_id", "w", "h", F.lit("m").alias("mask"), "y").agg(F.bit_or(F.expr("shiftleft(1L, x)")).alias("bits")).withColumn("xb", F.lit(0))
    for filled in (True, False):
        lines = plan(Q.labelled_regions(long, filled))
        assert not any("Join" in x or "Aggregate" in x for x in lines) and len([x for x in lines if "Exchange" in x]) == 1


def test_corners_across_tiles(spark):
    """Areas do not depend on where tiles end, images one pixel wide or high and full words included."""
    rng = np.random.default_rng(7)
    rows = []
    for i, (h, w) in enumerate([(9, 200), (40, 130), (1, 70), (70, 1), (5, 64)]):
        m = rng.random((h, w)) < (0.8 if i else 1.1)
        bits = np.zeros((h, -(-w // 64) * 64), bool)
        bits[:, :w] = m
        packed = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
        rows += [(i, w, h, "m", y, xb, int(packed[y, xb])) for y in range(h) for xb in range(packed.shape[1])]
    long = spark.createDataFrame(rows, "image_id bigint, w int, h int, mask string, y int, xb int, bits bigint")
    read = lambda *tiles: sorted((r.image_id, r.comp_id, r.n, r.area) for r in Q.region_stats(Q.labelled_regions(long, False, *tiles)).collect())
    whole = read(1024, 16)
    assert whole[0] == (0, 0, 1800, 8 * 199.0) and read(4, 1) == read(1, 1) == read(7, 2) == whole
