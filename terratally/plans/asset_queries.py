"""Registered queries on asset, box and file tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from terratally import fixed_values as K
from terratally.functions import clean as C, geometry as G
from terratally.operators import assets as A, boxes as B, gis, heights as H, stats as S
from terratally.operators.ranking import numbered
from terratally.session import cut_lineage
from terratally.sources import exports, fixtures as X, ingest


def fixed_assets(spark, sf):
    return A.fill_asset_defaults(X.raw_assets(spark, sf))


def detector_assets(spark, sf):
    return B.boxes_to_assets(B.conf_filter(B.scan_boxes(X.boxes(spark, sf))))


def stats_of(spark, sf):
    return S.category_stats(fixed_assets(spark, sf))


def chart_of(spark, sf):
    a = fixed_assets(spark, sf)
    return S.category_chart(a, S.category_stats(a))


def r6(name):
    return F.round(name, 6).alias(name)


def pt_text(c):
    """[a, b] pairs as whole millionths."""
    m = lambda v: F.rint(v * 1000000).cast("bigint").cast("string")
    return F.array_join(F.transform(c, lambda p: F.concat(m(p[0]), F.lit(" "), m(p[1]))), ";")


# ---- scans, sources, sinks

def q_ingest_gate(spark, sf):
    return ingest.ingest_gate(X.files(spark, sf)).select("file_id", "status", "http_code")


def q_media_kind(spark, sf):
    return ingest.media_kind(X.files(spark, sf)).select("file_id", "media_kind")


def q_explode_tiles(spark, sf):
    emb = X.table(spark, sf, "embeddings")
    return ingest.explode_tiles(emb, "embedding", 8, ["vec_id"]).select("vec_id", "y", "x", (F.col("v") > 0).alias("bright"))


def q_scan_boxes(spark, sf):
    return B.scan_boxes(X.boxes(spark, sf)).select("image_id", "box_idx", "cls_id", "class_name", "x1", "y1", "x2", "y2")


PROPERTIES = ("id", "category", "subcategory", "maintenance_priority", "condition_status", "color", "layer_id")
FEATURE = ("type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, "
           f"properties struct<{', '.join(p + ': string' for p in PROPERTIES)}, confidence_percent: double>")


def q_to_geojson(spark, sf):
    """Features, read back from their text in one pass."""
    g = exports.to_geojson(gis.gis_polygons(fixed_assets(spark, sf)))
    f = g.select("image_id", "asset_idx", F.from_json("feature_json", FEATURE).alias("f"))
    return f.select("image_id", "asset_idx", "f.type", F.col("f.geometry.type").alias("geometry"), pt_text(F.col("f.geometry.coordinates")[0]).alias("ring"),
                    *[f"f.properties.{p}" for p in (*PROPERTIES, "confidence_percent")])


def q_geojson_collections(spark, sf):
    g = exports.geojson_collections(exports.to_geojson(gis.gis_polygons(fixed_assets(spark, sf))))
    doc = F.parse_json("geojson")
    return g.select("image_id", "part", "features", F.variant_get(doc, "$.type", "string").alias("type"),
                    F.size(F.variant_get(doc, "$.features", "array<variant>")).alias("in_document"))


def q_to_csv(spark, sf):
    return exports.to_csv(A.asset_rows(fixed_assets(spark, sf)))


def q_latest_result(spark, sf):
    ev = X.table(spark, sf, "events")
    res = ev.select(
        F.col("user_id"), F.col("event_id").alias("result_id"), "ts", (F.col("event_type") != "error").alias("success"),
        (F.col("value") > 2).alias("has_data"), (F.col("event_id") % 5 != 0).alias("has_transformed"))
    return ingest.latest_result(res, "user_id").select("user_id", "result_id")


# ---- cleaning

def q_safe_num(spark, sf):
    raw = X.raw_assets(spark, sf)
    return raw.select("image_id", "asset_idx", C.safe_float(F.col("confidence_percent"), 7.0).alias("as_float"),
                      C.safe_int(F.col("confidence_percent"), 3).alias("as_int"),
                      F.greatest(C.safe_int(F.col("estimated_count"), 1), F.lit(0)).alias("as_count"))


def q_safe_text(spark, sf):
    return X.raw_assets(spark, sf).select(
        "image_id", "asset_idx", C.safe_text(F.col("unique_id"), "none").alias("id_text"),
        C.safe_text(C.either_text(F.col("subcategory"), F.col("subtype")), "General").alias("sub_text"))


def q_clamp(spark, sf):
    return X.raw_assets(spark, sf).select(
        "image_id", "asset_idx", C.clamp(F.col("confidence_percent")).alias("bounded"),
        C.clamp_display(F.col("confidence_percent")).alias("shown"))


def q_normalize_category(spark, sf):
    return X.raw_assets(spark, sf).select("image_id", "asset_idx", C.normalize_category(F.col("category")).alias("category"))


def q_class_to_category(spark, sf):
    return B.scan_boxes(X.boxes(spark, sf)).select(
        "image_id", "box_idx", C.class_to_category(F.col("class_name")).alias("category"),
        C.class_to_category(F.initcap(F.translate("class_name", "_", "-"))).alias("from_dashed"))


def q_repair_point(spark, sf):
    return X.raw_assets(spark, sf).select("image_id", "asset_idx", G.repair_point(F.col("center_coordinates")).alias("p")).select(
        "image_id", "asset_idx", "p.x", "p.y")


def q_repair_bbox(spark, sf):
    return X.raw_assets(spark, sf).select("image_id", "asset_idx", G.repair_bbox(F.col("bounding_box")).alias("b")).select(
        "image_id", "asset_idx", "b.*")


def q_repair_polygon(spark, sf):
    b = G.repair_bbox(F.col("bounding_box"))
    p = G.repair_polygon(F.col("polygon_coordinates"), b)
    return X.raw_assets(spark, sf).select("image_id", "asset_idx", F.size(p).alias("points"), A.points_text(p).alias("polygon"))


def q_fill_asset_defaults(spark, sf):
    return A.flatten_assets(fixed_assets(spark, sf))


def q_fallback_asset(spark, sf):
    images = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"))
    out = A.fallback_asset(images, fixed_assets(spark, sf), X.parts_of(spark, sf, "lineitem"))
    return out.select("image_id", "asset_idx", "unique_id", "category", "subcategory", "estimated_count", "visual_description")


def q_boxes_to_assets(spark, sf):
    return A.flatten_assets(detector_assets(spark, sf)).drop("visual_description", "estimation_basis")


def q_ring_from_bbox(spark, sf):
    return fixed_assets(spark, sf).select("image_id", "asset_idx", A.points_text(G.ring_from_bbox(F.col("bounding_box"))).alias("ring"))


def q_to_area_m2(spark, sf):
    b = X.boxes(spark, sf)
    mpp = F.when(F.col("cls_id") == 5, "bad").when(F.col("cls_id") == 4, "-2").otherwise(F.col("cls_id").cast("string"))
    return b.select("image_id", "box_idx", C.to_area_m2((F.col("x2") - F.col("x1")) * (F.col("y2") - 100), mpp).alias("area_m2"))


def q_to_length_m(spark, sf):
    b = X.boxes(spark, sf)
    return b.select("image_id", "box_idx", C.to_length_m(F.col("x2") - 200, 0.5).alias("length_m"))


def q_geo_project(spark, sf):
    p = G.geo_project(F.col("center_coordinates"))
    return fixed_assets(spark, sf).select("image_id", "asset_idx", F.round(p[0], 9).alias("lat"), F.round(p[1], 9).alias("lng"))


def q_confidence_models(spark, sf):
    a = fixed_assets(spark, sf)
    return a.select(
        "image_id", "asset_idx", C.block_confidence(F.col("estimated_count")).alias("block"),
        C.map_confidence(F.col("estimated_coverage_percent")).alias("map"),
        C.video_confidence(F.col("confidence_percent") / 100.0).alias("video"))


def q_asset_row_projection(spark, sf):
    return A.asset_rows(fixed_assets(spark, sf))


# ---- GIS, display, text

def q_gis_polygons(spark, sf):
    g = gis.gis_polygons(fixed_assets(spark, sf))
    return g.withColumns({
        "coordinates": pt_text(F.col("coordinates")), "bbox_coordinates": pt_text(F.col("bbox_coordinates")),
        "center": pt_text(F.array("center"))})


def q_gis_markers(spark, sf):
    return gis.gis_markers(fixed_assets(spark, sf)).withColumns({"lat": F.round("lat", 9), "lng": F.round("lng", 9)})


def q_heat_points(spark, sf):
    return gis.heat_points(fixed_assets(spark, sf)).withColumns({"lat": F.round("lat", 9), "lng": F.round("lng", 9)})


def q_asset_center(spark, sf):
    raw = X.raw_assets(spark, sf)
    given = G.point(F.when(F.col("asset_idx") % 3 != 0, F.col("center_coordinates.x").try_cast("double")),
                    F.col("center_coordinates.y").try_cast("double"))
    c = G.asset_center(given, G.repair_bbox(F.col("bounding_box")))
    return raw.select("image_id", "asset_idx", c.alias("c")).select("image_id", "asset_idx", "c.x", "c.y")


def q_center_line(spark, sf):
    poly = F.when(F.col("asset_idx") % 2 == 0, F.col("polygon_coordinates")).otherwise(F.slice("polygon_coordinates", 1, 1))
    line = G.center_line(poly, F.col("bounding_box"))
    return fixed_assets(spark, sf).select("image_id", "asset_idx", A.points_text(line).alias("line"))


def q_layer_shape(spark, sf):
    return fixed_assets(spark, sf).select(
        "image_id", "asset_idx", C.layer_shape(C.layer_of(F.col("category"))).alias("shape"))


def q_risk_flags(spark, sf):
    st = stats_of(spark, sf)
    out = None
    for mode, vehicles in (("map", False), ("video", True)):
        part = S.risk_flags(S.risk_inputs(st, vehicles), mode).select(
            "image_id", F.lit(mode).alias("mode"), "encroachment_risk", "drainage_risk", "environmental_risk", "flood_risk")
        out = part if out is None else out.unionByName(part)
    return out


def q_density_labels(spark, sf):
    return S.density_labels(S.risk_inputs(stats_of(spark, sf), False)).select("image_id", "green_density", "road_density")


def q_urban_density(spark, sf):
    return S.urban_density(S.image_summary(stats_of(spark, sf))).select("image_id", "urban_density_score")


def q_insight_texts(spark, sf):
    a = fixed_assets(spark, sf)
    st = S.category_stats(a)
    r = S.density_labels(S.risk_flags(S.risk_inputs(st, False), "map"))
    classes = a.groupBy("image_id").agg(F.countDistinct("category").alias("classes"), F.sum("estimated_count").alias("total"))
    g = S.governance_insights(r.join(classes, "image_id"))
    m = S.map_insights(g)
    return g.select("image_id", *[F.col("governance_insights")[i].alias(f"governance_{i + 1}") for i in range(3)],
                    *[m[i].alias(f"map_{i + 1}") for i in range(3)])


def q_pad_insights(spark, sf):
    texts = F.array("unique_id", "category", "subcategory", "subtype", "condition_status", "maintenance_priority")
    p = S.pad_insights(F.slice(texts, F.lit(1), F.col("asset_idx") % 7))
    return X.raw_assets(spark, sf).select("image_id", "asset_idx", F.size(p).alias("n"), F.array_join(p, "|").alias("insights"))


def q_result_valid(spark, sf):
    o = X.table(spark, sf, "orders")
    k = F.col("o_custkey")
    text = F.concat(
        F.lit('{"success":'), F.when(k % 5 == 0, "false").when(k % 5 == 1, '"true"').otherwise("true"),
        F.lit(',"request_id":'), F.when(k % 3 == 0, '""').otherwise(F.concat(F.lit('"r'), k.cast("string"), F.lit('"'))),
        F.lit(',"transformed":'), F.when(k % 4 == 0, "null").otherwise("{}"),
        F.lit(',"data":{"detected_assets":'), F.when(F.col("o_orderkey") % 2 == 0, "[]").otherwise("{}"),
        F.lit('},"warnings":'), F.when(F.col("o_orderkey") % 3 == 0, "7").otherwise('["w"]'), F.lit("}"))
    docs = o.select(F.col("o_orderkey").alias("result_id"), F.try_parse_json(text).alias("doc"))
    return docs.select("result_id", ingest.result_valid(docs).alias("valid"))


# ---- filters

def q_conf_filter(spark, sf):
    return B.conf_filter(X.boxes(spark, sf)).select("image_id", "box_idx", "cls_id", "x1", "y1")


def q_is_building(spark, sf):
    return X.raw_assets(spark, sf).select(
        "image_id", "asset_idx", C.is_building(F.col("category")).alias("raw_flag"),
        C.is_building(C.normalize_category(F.col("category"))).alias("flag"))


def q_layer_toggle(spark, sf):
    return gis.layer_toggle(gis.gis_markers(fixed_assets(spark, sf)), ["roads", "water", "solar"]).select("image_id", "asset_idx", "layer_id")


def q_category_search(spark, sf):
    return gis.category_search(chart_of(spark, sf), "  PARK ").select("image_id", "category", "count")


def q_degenerate_box(spark, sf):
    a = fixed_assets(spark, sf)
    return G.with_pixel_box(a, F.col("bounding_box"), F.lit(512), F.lit(384)).where("x1 IS NULL").select("image_id", "asset_idx")


# ---- joins

def q_category_dim_join(spark, sf):
    a = fixed_assets(spark, sf).withColumn("category", F.when(F.col("asset_idx") % 5 == 0, "Other").otherwise(F.col("category")))
    return gis.category_dim_join(a, A.categories(spark)).select("image_id", "asset_idx", "category", "layer_id", "color")


def q_renderable_layers(spark, sf):
    a = fixed_assets(spark, sf)
    layers = S.category_stats(a).withColumn("layer_id", C.layer_of(F.col("category")))
    shown = a.where(F.col("confidence_percent") >= 5)
    return gis.renderable_layers(layers, shown).select("image_id", "category", "layer_id")


def q_asset_layer_join(spark, sf):
    return gis.asset_layer_join(fixed_assets(spark, sf), chart_of(spark, sf).where("count > 3")).select(
        "image_id", "asset_idx", "category", "layer_id", "color")


def q_iou_pairs(spark, sf):
    return B.iou_pairs(B.conf_filter(X.boxes(spark, sf))).withColumn("iou", F.round("iou", 9))


def q_box_nms(spark, sf):
    return B.box_nms(B.conf_filter(X.boxes(spark, sf))).select("image_id", "cls_id", "box_idx")


# ---- aggregations

def q_category_stats(spark, sf):
    return stats_of(spark, sf).withColumns({"total_area_sq_m": F.round("total_area_sq_m", 6), "coverage_percent": F.round("coverage_percent", 6)})


def q_category_stats_additive(spark, sf):
    a = fixed_assets(spark, sf)
    out = S.category_stats(a, incoming=S.category_stats(a))
    return out.withColumns({"total_area_sq_m": F.round("total_area_sq_m", 6), "coverage_percent": F.round("coverage_percent", 6)})


def q_category_stats_naming(spark, sf):
    return S.category_stats_rounded(detector_assets(spark, sf))


def q_image_summary(spark, sf):
    totals = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 40).alias("given"))
    return S.image_summary(stats_of(spark, sf), totals)


def q_category_chart(spark, sf):
    return chart_of(spark, sf)


def q_priority_histogram(spark, sf):
    return S.priority_histogram(X.raw_assets(spark, sf))


def q_mean_confidence(spark, sf):
    images = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"))
    return S.mean_confidence(images, fixed_assets(spark, sf)).withColumn("mean_confidence", F.round("mean_confidence", 1))


def q_layer_counts(spark, sf):
    return S.layer_counts(gis.gis_polygons(fixed_assets(spark, sf)))


def q_area_count_summary(spark, sf):
    return S.area_count_summary(chart_of(spark, sf))


def q_height_summary(spark, sf):
    return S.height_summary(fixed_assets(spark, sf)).withColumn("avg_height", F.round("avg_height", 9))


def q_dominant_land_use(spark, sf):
    return S.dominant_land_use(stats_of(spark, sf))


def q_mode_rollup(spark, sf):
    a = fixed_assets(spark, sf).withColumn("mode", F.element_at(F.array(*[F.lit(m) for m in K.ANALYSIS_MODES]), (F.col("image_id") % 3 + 1).cast("int")))
    return S.mode_rollup(a)


# ---- ordering

def q_number_assets(spark, sf):
    a = fixed_assets(spark, sf).withColumn("ord", A.category_ord(F.col("category")))
    out = numbered(a, ["image_id"], F.col("ord") * 8 + F.floor(F.col("center_coordinates.y") / 25),
                   ["center_coordinates.y", "center_coordinates.x", "asset_idx"], "n")
    return out.select("image_id", "asset_idx", F.concat(F.lit("asset_map_"), F.col("n").cast("string")).alias("number"))


def q_rank_categories(spark, sf):
    return S.rank_categories(chart_of(spark, sf)).select("image_id", "category", "count", "rank")


def q_distinct_layers(spark, sf):
    return S.distinct_layers(chart_of(spark, sf))


# ---- heights

def q_bbox_to_pixels(spark, sf):
    b = F.struct(*[F.col(c).cast("double").alias(n) for c, n in (("bx1", "x_min"), ("by1", "y_min"), ("bx2", "x_max"), ("by2", "y_max"))])
    df = X.boxes(spark, sf).withColumnsRenamed({c: "b" + c for c in ("x1", "y1", "x2", "y2")}).withColumn(
        "given", F.when(F.col("cls_id") > 2, b).otherwise(G.list_to_bbox(F.array("bx1", "by2", "bx2", "by1"))))
    return G.with_pixel_box(df, F.col("given"), F.col("image_w"), F.col("image_h")).select("image_id", "box_idx", "x1", "y1", "x2", "y2")


def building_boxes(spark, sf):
    a = detector_assets(spark, sf).withColumns({"image_w": F.lit(512), "image_h": F.lit(384)})
    return cut_lineage(H.buildings(a))


def q_buildings(spark, sf):
    return building_boxes(spark, sf)


def q_shadow_match(spark, sf):
    m = H.match_shadows(building_boxes(spark, sf), H.box_shadows(X.shadows(spark, sf)))
    return m.select("image_id", "asset_idx", "shadow_id", F.round("score", 6).alias("score"))


def _lengths(spark, sf):
    sh = H.box_shadows(X.shadows(spark, sf))
    return H.farthest_point(H.match_shadows(building_boxes(spark, sf), sh), H.box_shadow_points(sh))


def q_farthest_point(spark, sf):
    return _lengths(spark, sf).select("image_id", "asset_idx", "shadow_id", "far_x", "far_y")


def q_shadow_length(spark, sf):
    return H.shadow_length(_lengths(spark, sf)).select("image_id", "asset_idx", F.round("length_px", 6).alias("length_px"))


def q_height_from_shadow(spark, sf):
    s = X.shadows(spark, sf)
    return s.select("image_id", "shadow_id", F.round(G.height_from_shadow(F.col("half_w") - 12, F.col("cy") - 100), 6).alias("height"))


def heights_of(spark, sf):
    sh = H.box_shadows(X.shadows(spark, sf))
    return H.building_heights(building_boxes(spark, sf), sh, H.box_shadow_points(sh))


def q_building_heights(spark, sf):
    return heights_of(spark, sf)


def q_heights_to_assets(spark, sf):
    out = H.heights_to_assets(detector_assets(spark, sf), heights_of(spark, sf))
    return out.select("image_id", "asset_idx", "shadow_length_pixels", "shadow_length_meters", "estimated_height_meters")


def q_heights_export(spark, sf):
    rec = exports.heights_export(heights_of(spark, sf))
    v = F.parse_json("record")
    return rec.select("image_id", "asset_idx", F.variant_get(v, "$.class", "string").alias("class"),
                      F.array_join(F.variant_get(v, "$.bbox", "array<int>"), " ").alias("bbox"),
                      F.variant_get(v, "$.estimated_height_meters", "double").alias("estimated_height_meters"))


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}
