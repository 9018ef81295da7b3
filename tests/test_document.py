"""The full document of an image: parts, an image without assets, and frames without any mask."""
import json

from pyspark.sql import functions as F

from terratally.operators import assets as A, masks as M, stats as S
from terratally.plans import document as D
from terratally.plans.registry import QUERIES
from terratally.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def test_document_parts(spark):
    assets = A.fill_asset_defaults(X.raw_assets(spark, SF).where("image_id < 60"))
    stats = S.category_stats(assets)
    images = assets.select("image_id").distinct().unionByName(spark.createDataFrame([(-5,)], "image_id bigint"))
    report = images.join(S.urban_density(S.image_summary(stats)), "image_id", "left").withColumns({
        **{c: F.lit(1.0) for c in ("overall_detection_confidence_percent", "estimated_total_area_sq_m")}, **{r: F.lit("Low") for r in D.RISKS}, "ai_insights": F.lit(None).cast("array<string>")})
    report = report.fillna(0)
    whole = {r.image_id: json.loads(r.payload) for r in D.result_document(report, assets, stats).collect()}
    pieces = {}
    for r in D.result_document(report, assets, stats, part_size=2).collect():
        pieces.setdefault(r.image_id, {})[r.part] = json.loads(r.payload)
    rows = {}
    for r in A.asset_rows(assets).collect():
        rows.setdefault(r.image_id, []).append((r.asset_idx, r.id, r.category, r["count"]))
    assert set(whole) == set(pieces) == {*rows, -5}
    for i, doc in whole.items():
        want = [list(r[1:]) for r in sorted(rows.get(i, []))]
        assert [[r["id"], r["category"], r["count"]] for r in doc["asset_table_rows"] or []] == want
        joined = [r for p in sorted(pieces[i]) for r in pieces[i][p]["asset_table_rows"] or []]
        assert joined == (doc["asset_table_rows"] or []) and all(p["chart_data"] == doc["chart_data"] for p in pieces[i].values())
        counts = {}
        for _, category, n in want:
            counts[category] = counts.get(category, 0) + n
        assert (doc["asset_statistics"]["category_counts"] or {}) == counts
        assert {p["name"]: p["value"] for p in doc["chart_data"]["pie_chart_data"] or []} == counts
        assert sum((doc["asset_statistics"]["maintenance_priorities"] or {}).values()) == len(want)
        gis = doc["gis_mapping"]
        assert [m["id"] for m in gis["leaflet_markers"] or []] == [r[0] for r in want] and len(gis["heatmap_points"] or []) == len(gis["leaflet_polygons"] or []) == len(want)
        assert set(doc) == {"analytics_cards", "asset_statistics", "gis_mapping", "dashboard_insights", "chart_data", "asset_table_rows"} and set(doc["analytics_cards"]) == set(D.CARDS)
        assert doc["dashboard_insights"]["governance_insights"][0] == f"Detected {doc['analytics_cards']['total_assets_detected']} assets across {len(counts)} classes."


def test_frames_without_a_mask_are_kept(spark):
    cols = ", ".join(f"{m} bigint" for m in M.MAP_MASKS)
    none = [0] * len(M.MAP_MASKS)
    words = spark.createDataFrame([(1, 8, 1, 0, 0, *none), (2, 8, 1, 0, 0, 3, *none[1:])], "image_id bigint, w int, h int, y int, xb int, " + cols)
    kept = spark.createDataFrame([(2, "building")], "image_id bigint, mask string")
    got = sorted(tuple(r) for r in M.frame_observations_of(words, kept).collect())
    assert got == [(1, None, 0, 0.0), (2, "Properties & Buildings", 1, 2.0)]


def test_layers_are_gathered_in_one_exchange(spark):
    """Lists of the four layers come from one aggregation; they were four, joined afterwards and dealt out once more."""
    docs = QUERIES["result_document"](spark, SF)
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Aggregate [image_id" in line and "collect_list(" in line and "part" in line and "collect_set" not in line]) == 1
    assert docs.groupBy("image_id", "part").count().where("count > 1").isEmpty()
    assert docs.agg({"rows": "sum"}).first()[0] == spark.read.parquet(SF + "/lineitem.parquet").count()
