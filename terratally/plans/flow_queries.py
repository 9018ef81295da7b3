"""Registered queries on responses, frames, streams and the full modes."""
from __future__ import annotations

from pyspark.sql import functions as F

from terratally.operators import assets as A, frames as V, responses as P, stats as S
from terratally.plans import asset_queries as T, document, modes, raster_queries as RQ
from terratally.session import new_dir
from terratally.sources import fixtures as X, ingest
from terratally.streaming import video as ST

FRAME_PX = 1000.0 * 100.0


def parsed(spark, sf):
    return P.parse_response(X.responses(spark, sf))


def q_scan_responses(spark, sf):
    path = new_dir(spark, "responses")
    X.responses(spark, sf).select("response_id", "raw_text").write.json(path)
    return ingest.scan_responses(spark, path, lines=True).select("response_id", F.length("raw_text").alias("chars"), "raw_text")


def q_extract_json(spark, sf):
    return X.responses(spark, sf).select("response_id", P.extract_json(F.col("raw_text")).alias("json_text"))


def q_repair_json(spark, sf):
    return X.responses(spark, sf).select("response_id", P.repair_json(P.extract_json(F.col("raw_text"))).alias("json_text"))


def q_parse_response(spark, sf):
    return parsed(spark, sf).select("response_id", F.col("doc").isNotNull().alias("usable"), "parse_warning",
                                    F.try_variant_get("doc", "$.risk_analysis.flood_risk", "string").alias("flood"))


def q_explode_assets(spark, sf):
    return P.explode_assets(parsed(spark, sf)).select(
        "response_id", "asset_idx", "valid", F.try_variant_get("entry", "$.category", "string").alias("category"))


def q_reject_bad_assets(spark, sf):
    return P.reject_bad_assets(P.explode_assets(parsed(spark, sf)))


def q_response_assets(spark, sf):
    return A.flatten_assets(P.response_assets(parsed(spark, sf))).select(
        "image_id", "asset_idx", "unique_id", "category", "subcategory", "confidence_percent", "estimated_count", "estimated_area_sq_m",
        "estimated_coverage_percent", "x_min", "y_min", "x_max", "y_max")


def q_collect_warnings(spark, sf):
    return P.collect_warnings(parsed(spark, sf)).select("response_id", F.array_join("warnings", "|").alias("warnings"))


def q_validate_response(spark, sf):
    return P.validate_response(parsed(spark, sf)).withColumn("ai_insights", F.array_join("ai_insights", "|"))


def read_back(docs, figures: str):
    """Documents with the given figures of their JSON, parsed once, as ``v``."""
    return docs.select("image_id", "part", "rows", F.from_json("payload", figures).alias("v"))


def q_nested_payload(spark, sf):
    n = read_back(modes.nested_payload(T.fixed_assets(spark, sf)), """analytics_cards struct<total_assets_detected: bigint>, asset_table_rows array<struct<id: string>>,
        asset_statistics struct<category_counts: map<string, bigint>, maintenance_priorities: map<string, bigint>>, chart_data struct<area_distribution_data: array<struct<area_sq_m: double>>>,
        gis_mapping struct<leaflet_polygons: array<struct<id: string>>, leaflet_markers: array<struct<id: string>>, heatmap_points: array<struct<weight: double>>>,
        dashboard_insights struct<governance_insights: array<string>>""")
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return n.select("image_id", "part", "rows", F.size("v.asset_table_rows").alias("in_document"), F.col("v.asset_table_rows")[0]["id"].alias("first_id"),
                    F.col("v.analytics_cards.total_assets_detected").alias("total"),
                    F.size("v.gis_mapping.leaflet_polygons").alias("polygons"), F.size("v.gis_mapping.leaflet_markers").alias("markers"),
                    F.size("v.gis_mapping.heatmap_points").alias("points"), F.col("v.gis_mapping.leaflet_markers")[0]["id"].alias("first_marker"),
                    total("v.asset_statistics.maintenance_priorities").alias("prioritised"), total("v.asset_statistics.category_counts").alias("counted"),
                    F.round(F.aggregate("v.chart_data.area_distribution_data", F.lit(0.0), lambda s, p: s + p["area_sq_m"]), 4).alias("area"),
                    F.col("v.dashboard_insights.governance_insights")[0].alias("governance"))


def q_result_document(spark, sf):
    """Documents of the cleaned records, with map risks; figures are read back from the JSON."""
    assets = T.fixed_assets(spark, sf)
    stats = S.category_stats(assets)
    risk = S.risk_flags(S.risk_inputs(stats, False), "map").drop("built", "drains", "green", "water", "road")
    report = S.urban_density(S.image_summary(stats)).join(risk, "image_id").withColumns({
        "overall_detection_confidence_percent": F.lit(50.0), "estimated_total_area_sq_m": F.lit(100.0), "ai_insights": F.array(F.lit("one"), F.lit("two"))})
    n = read_back(document.result_document(report, assets, stats), """analytics_cards struct<total_assets_detected: bigint, green_cover_percent: double>,
        asset_statistics struct<maintenance_priorities: map<string, bigint>, risk_indicators: struct<flood_risk: string>>,
        chart_data struct<pie_chart_data: array<struct<name: string, value: bigint, color: string>>, area_distribution_data: array<struct<area_sq_m: double>>>,
        gis_mapping struct<map_center: struct<lat: double>, leaflet_polygons: array<struct<id: string>>, leaflet_markers: array<struct<id: string>>, heatmap_points: array<struct<weight: double>>>,
        asset_table_rows array<struct<id: string>>, dashboard_insights struct<governance_insights: array<string>, environmental_risks: array<string>>""")
    pie = F.transform("v.chart_data.pie_chart_data", lambda p: F.concat(p["name"], F.lit(":"), p["value"].cast("string"), p["color"]))
    return n.select(
        "image_id", "part", "rows", F.col("v.analytics_cards.total_assets_detected").alias("total"), F.round("v.analytics_cards.green_cover_percent", 6).alias("green"),
        F.array_join(pie, "|").alias("pie"), F.round(F.aggregate("v.chart_data.area_distribution_data", F.lit(0.0), lambda s, p: s + p["area_sq_m"]), 4).alias("area"),
        F.aggregate(F.map_values("v.asset_statistics.maintenance_priorities"), F.lit(0).cast("bigint"), lambda s, v: s + v).alias("prioritised"),
        F.col("v.asset_statistics.risk_indicators.flood_risk").alias("flood_risk"), F.size("v.gis_mapping.leaflet_polygons").alias("polygons"),
        F.size("v.gis_mapping.leaflet_markers").alias("markers"), F.size("v.gis_mapping.heatmap_points").alias("points"), F.round("v.gis_mapping.map_center.lat", 4).alias("lat"),
        F.col("v.gis_mapping.leaflet_markers")[0]["id"].alias("first_marker"), F.col("v.asset_table_rows")[0]["id"].alias("first_row"),
        F.col("v.dashboard_insights.governance_insights")[0].alias("governance"), F.col("v.dashboard_insights.environmental_risks")[1].alias("flood_again"))


# ---- frames

def q_read_frames(spark, sf):
    path = new_dir(spark, "frames")
    X.frames(spark, sf).select(*[c.split()[0] for c in ingest.FRAME_SCHEMA.split(", ")]).write.parquet(path)
    return ingest.read_frames(spark, path).select("video_id", "frame_idx", "ts", "category", "cnt", F.round("area_px", 6).alias("area_px"))


def q_sample_frames(spark, sf):
    return V.sample_frames(X.frames(spark, sf), 2, 20).select("video_id", "frame_idx", "stride", "category", "cnt")


def q_carry_forward(spark, sf):
    return V.carry_forward(X.frames(spark, sf), 3, 20).select("video_id", "frame_idx", "sampled", "category", "cnt", F.round("area_px", 6).alias("area_px"))


def q_video_category_stats(spark, sf):
    out = V.video_category_stats(V.sample_frames(X.frames(spark, sf)), FRAME_PX)
    return out.select("video_id", "ord", "category", "count", F.round("mean_area_px", 6).alias("mean_area_px"),
                      F.round("coverage_percent", 8).alias("coverage_percent"), F.round("presence_ratio", 9).alias("presence_ratio"), "confidence_percent")


def observed(spark, sf):
    """Frames of which a quarter show nothing: their observations are left out and come back from the frame table."""
    f = X.frames(spark, sf)
    return V.with_empty(f.where("cnt > 0"), f)


def q_video_stats_with_empty(spark, sf):
    out = V.video_category_stats(V.sample_frames(observed(spark, sf)), FRAME_PX)
    return out.select("video_id", "ord", "category", "count", F.round("mean_area_px", 6).alias("mean_area_px"), F.round("presence_ratio", 9).alias("presence_ratio"))


def q_carry_with_empty(spark, sf):
    return V.carry_forward(observed(spark, sf), 3, 20).select("video_id", "frame_idx", "category", "cnt")


def q_video_header(spark, sf):
    f = X.frames(spark, sf)
    return V.video_header(f, V.sample_frames(f, 2, 20))


def q_video_assets(spark, sf):
    return A.flatten_assets(V.video_assets(V.video_category_stats(V.sample_frames(X.frames(spark, sf)), FRAME_PX))).select(
        "image_id", "unique_id", "category", "estimated_count", "visual_description", "polygon")


# ---- streams

def event_stream(spark, sf):
    ev = ST.table_stream(spark, sf, "events.parquet")
    f = X.relation(spark, sf, X.FRAMES, {"events": ev})
    return f.withColumn("frame_idx", (F.col("event_id") + 1).cast("int")).drop("event_id")


def q_stream_video_stats(spark, sf):
    return ST.stream_video_stats(event_stream(spark, sf)).withColumn("area_sum", F.round("area_sum", 4))


def q_stream_window_stats(spark, sf):
    return ST.stream_window_stats(event_stream(spark, sf)).withColumn("area_sum", F.round("area_sum", 4))


def q_stream_sample(spark, sf):
    return ST.stream_sample(event_stream(spark, sf), 3).select("video_id", "frame_idx", "category", "cnt")


def q_stream_carry_forward(spark, sf):
    return ST.stream_carry_forward(event_stream(spark, sf), 3).select("video_id", "frame_idx", "sampled", "category", "cnt")


def q_stream_ingest(spark, sf):
    """Orders as uploads: some have a wrong mode or type, no content, or too much of it."""
    orders = ST.table_stream(spark, sf, "orders.parquet")
    resp = X.relation(spark, sf, X.RESPONSES.replace("SELECT o_orderkey AS response_id", "SELECT o_orderdate, o_orderkey AS response_id")
                      .replace("FROM (SELECT o_orderkey,", "FROM (SELECT o_orderdate, o_custkey, o_orderkey,"), {"orders": orders})
    key = F.col("response_id")
    arrivals = resp.select(
        "response_id", "raw_text", F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("image").alias("kind"), F.concat(F.lit("shot_"), key.cast("string")).alias("filename"),
        F.when(key % 11 == 0, "heat_analysis").otherwise("block_analysis").alias("mode"), F.when(key % 7 == 0, "image/gif").otherwise("image/jpeg").alias("content_type"),
        (F.length("raw_text") * F.when(key % 5 == 0, 1000000).otherwise(1)).cast("bigint").alias("size_bytes"))
    out = ST.stream_ingest(arrivals)
    return out.select("response_id", "status", "http_code", "parse_warning", F.get_json_object("document", "$.image_analysis.scene_type").alias("scene_type"))


# ---- modes

def q_analyze_naming(spark, sf):
    third = (F.col("built_up_percent") + F.col("road_network_percent") + F.col("green_cover_percent")) / 3.0
    out = modes.analyze_naming(X.boxes(spark, sf), X.shadows(spark, sf)).withColumn("urban_density_score", third)
    covers = ["urban_density_score", "built_up_percent", "green_cover_percent", "open_space_percent", "water_body_percent"]
    return out.withColumns({c: F.round(c, 6) for c in covers})


def q_naming_assets(spark, sf):
    return A.flatten_assets(modes.naming_assets(X.boxes(spark, sf))).select(
        "image_id", "asset_idx", "unique_id", "category", "confidence_percent", "x_min", "y_min", "x_max", "y_max", "estimated_area_sq_m")


def q_naming_insights(spark, sf):
    b = X.boxes(spark, sf)
    kept = modes.naming_assets(b).groupBy("image_id").agg(F.count(F.lit(1)).alias("assets"))
    per = b.groupBy("image_id").agg(F.max("image_w").alias("image_w"), F.max("image_h").alias("image_h"))
    per = per.join(kept, "image_id", "left").withColumn("assets", F.coalesce("assets", F.lit(0)))
    text = S.naming_insights("detector.pt")
    return per.select("image_id", *[text[i].alias(f"insight_{i + 1}") for i in range(3)], F.array_join(S.naming_warnings(), "|").alias("warnings"))


def q_video_insights(spark, sf):
    rep = modes.analyze_video(X.frames(spark, sf), FRAME_PX)
    text = S.video_insights(1000, 100)
    return rep.select("video_id", *[text[i].alias(f"insight_{i + 1}") for i in range(3)])


def q_analyze_video(spark, sf):
    return modes.analyze_video(X.frames(spark, sf), FRAME_PX)


def q_analyze_map(spark, sf):
    return modes.analyze_map(X.pixels(spark, sf), X.images(spark, sf), RQ.MAP_SCALE, shadow_area=RQ.SHADOW_AREA,
                             block=RQ.SHADOW_BLOCK, words=RQ.map_words(spark, sf))


def q_analyze_block(spark, sf):
    resp = X.responses(spark, sf)
    out = modes.analyze_block(X.pixels(spark, sf), X.images(spark, sf), resp, shadow_area=RQ.SHADOW_AREA, block=RQ.SHADOW_BLOCK)
    return out.withColumn("ai_insights", F.array_join("ai_insights", "|"))


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}
