"""Check SQL for the asset, box and file queries."""
from __future__ import annotations

from oracle.relations import CTES, alias, clamp, micro, milli, norm, num, q, txt
from terratally import fixed_values as K

_in = lambda xs: ", ".join(f"'{x}'" for x in xs)
EXT = "lower(regexp_extract(filename, '(\\.[^.]*)$', 1))"
PAIRS = lambda c, f, a=1, b=2: f"array_to_string(list_transform({c}, lambda p: {f(f'p[{a}]')} || ' ' || {f(f'p[{b}]')}), ';')"

CTES["bld"] = ("""SELECT image_id, asset_idx, unique_id, CAST(round_even(least(511.0, x0), 0) AS INT) AS x1, CAST(round_even(least(383.0, y0), 0) AS INT) AS y1,
    CAST(round_even(least(511.0, x9), 0) AS INT) AS x2, CAST(round_even(least(383.0, y9), 0) AS INT) AS y2 FROM (
    SELECT *, round_even(xa, 4) / 100.0 * 512 AS x0, round_even(ya, 4) / 100.0 * 384 AS y0, round_even(xb, 4) / 100.0 * 512 AS x9, round_even(yb, 4) / 100.0 * 384 AS y9
    FROM named_assets WHERE category = 'Properties & Buildings') WHERE CAST(round_even(least(511.0, x9), 0) AS INT) > CAST(round_even(least(511.0, x0), 0) AS INT)
      AND CAST(round_even(least(383.0, y9), 0) AS INT) > CAST(round_even(least(383.0, y0), 0) AS INT)""", ["named_assets"])
CTES["matched"] = ("""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, asset_idx ORDER BY score, shadow_id) AS rn FROM (
    SELECT *, d + CASE WHEN near THEN 0.0 ELSE 15.0 END + 0.05 * sqrt((cx - (x1 + x2) / 2.0) * (cx - (x1 + x2) / 2.0) + (cy - (y1 + y2) / 2.0) * (cy - (y1 + y2) / 2.0)) AS score
    FROM (SELECT b.*, s.shadow_id, s.cx, s.cy, s.half_w, s.half_h, greatest(x2 - x1, y2 - y1, 1) * 2.6 AS reach,
      sqrt(pow(greatest(x1 - cx, 0.0, cx - x2), 2) + pow(greatest(y1 - cy, 0.0, cy - y2), 2)) AS d,
      NOT (cx + half_w < x1 - 12 OR cx - half_w > x2 + 12 OR cy + half_h < y1 - 12 OR cy - half_h > y2 + 12) AS near
      FROM bld b JOIN shadows s ON s.image_id = b.image_id) WHERE d <= reach OR near)) WHERE rn = 1""", ["bld", "shadows"])
CTES["far"] = ("""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, asset_idx ORDER BY dist DESC, far_y, far_x) AS rk FROM (
    SELECT m.image_id, m.asset_idx, m.shadow_id, x1, y1, x2, y2, (x1 + x2) / 2.0 AS ox, (y1 + y2) / 2.0 AS oy, cx + sx * half_w AS far_x, cy + sy * half_h AS far_y,
      sqrt(pow((x1 + x2) / 2.0 - (cx + sx * half_w), 2) + pow((y1 + y2) / 2.0 - (cy + sy * half_h), 2)) AS dist
    FROM matched m, (VALUES (-1, -1), (1, -1), (-1, 1), (1, 1)) AS s(sx, sy))) WHERE rk = 1""", ["matched"])
CTES["cut"] = ("""SELECT f.*, coalesce((SELECT min(t) FROM (VALUES
      (CASE WHEN abs(far_x - ox) > 1e-6 THEN (x1 - ox) / (far_x - ox) END), (CASE WHEN abs(far_x - ox) > 1e-6 THEN (x2 - ox) / (far_x - ox) END),
      (CASE WHEN abs(far_y - oy) > 1e-6 THEN (y1 - oy) / (far_y - oy) END), (CASE WHEN abs(far_y - oy) > 1e-6 THEN (y2 - oy) / (far_y - oy) END)) AS v(t)
      WHERE t > 0 AND ox + t * (far_x - ox) BETWEEN x1 - 1e-3 AND x2 + 1e-3 AND oy + t * (far_y - oy) BETWEEN y1 - 1e-3 AND y2 + 1e-3), 0.0) AS t FROM far f""", ["far"])
CTES["lens"] = ("""SELECT *, sqrt(pow(ox + t * (far_x - ox) - far_x, 2) + pow(oy + t * (far_y - oy) - far_y, 2)) AS len FROM cut""", ["cut"])
CTES["hts"] = ("""SELECT b.*, l.shadow_id, round_even(coalesce(l.len, 0.0), 2) AS spx, round_even(coalesce(l.len, 0.0) * 0.2, 2) AS sm,
    round_even(coalesce(l.len, 0.0) * 0.2 * tan(radians(45.0)), 2) AS hm FROM bld b LEFT JOIN lens l ON l.image_id = b.image_id AND l.asset_idx = b.asset_idx""", ["bld", "lens"])
CTES["pair0"] = ("""SELECT image_id, cls_id, x1, y1, x2, y2, max(conf) AS conf, arg_min(box_idx, (-conf, box_idx)) AS box_idx, count(*) AS copies
    FROM good GROUP BY image_id, cls_id, x1, y1, x2, y2""", ["good"])
CTES["pairs"] = ("""SELECT *, inter / (area_a + area_b - inter) AS iou FROM (SELECT a.image_id, a.cls_id, a.box_idx AS idx_a, b.box_idx AS idx_b, a.copies AS copies_a, b.copies AS copies_b,
    greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0.0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0.0) AS inter,
    (a.x2 - a.x1) * (a.y2 - a.y1) AS area_a, (b.x2 - b.x1) * (b.y2 - b.y1) AS area_b
    FROM pair0 a JOIN pair0 b ON a.image_id = b.image_id AND a.cls_id = b.cls_id AND (a.conf > b.conf OR (a.conf = b.conf AND a.box_idx < b.box_idx)))
    WHERE inter / (area_a + area_b - inter) > 0.45""", ["pair0"])
CTES["ranked"] = ("""SELECT image_id, cls_id, box_idx, x1, y1, x2, y2, row_number() OVER (PARTITION BY image_id, cls_id ORDER BY conf DESC, box_idx) AS rk FROM good""", ["good"])
CTES["greedy_rec"] = ("""SELECT image_id, cls_id, CAST(1 AS BIGINT) AS rk, [{'i': box_idx, 'a': x1, 'b': y1, 'c': x2, 'd': y2}] AS kept FROM ranked WHERE rk = 1
    UNION ALL SELECT r.image_id, r.cls_id, r.rk, CASE WHEN len(list_filter(g.kept, lambda k:
      greatest(least(k.c, r.x2) - greatest(k.a, r.x1), 0.0) * greatest(least(k.d, r.y2) - greatest(k.b, r.y1), 0.0)
      > 0.45 * ((k.c - k.a) * (k.d - k.b) + (r.x2 - r.x1) * (r.y2 - r.y1) - greatest(least(k.c, r.x2) - greatest(k.a, r.x1), 0.0) * greatest(least(k.d, r.y2) - greatest(k.b, r.y1), 0.0)))) > 0
      THEN g.kept ELSE list_append(g.kept, {'i': r.box_idx, 'a': r.x1, 'b': r.y1, 'c': r.x2, 'd': r.y2}) END
    FROM greedy_rec g JOIN ranked r ON r.image_id = g.image_id AND r.cls_id = g.cls_id AND r.rk = g.rk + 1""", ["ranked"])
CTES["kept_ids"] = ("""SELECT image_id, cls_id, unnest(list_transform(kept, lambda k: k.i)) AS box_idx FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id, cls_id ORDER BY rk DESC) AS z FROM greedy_rec) WHERE z = 1""", ["greedy_rec"])

ROWS = """image_id, asset_idx, unique_id AS id, category, subcategory, estimated_count AS "count", estimated_area_sq_m AS area_sq_m,
    estimated_coverage_percent AS coverage_percent, confidence_percent, maintenance_priority AS priority, condition_status AS condition, center_x, center_y"""
_js = lambda c: f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
_cell = lambda e: "'\"' || replace(" + e + ", '\"', '\"\"') || '\"'"
CSV = " || ',' || ".join(
    [_cell(e) for e in ("unique_id", "category", "subcategory", "CAST(estimated_count AS VARCHAR)")]
    + [_cell(_js(c)) for c in ("estimated_area_sq_m", "estimated_coverage_percent", "confidence_percent")]
    + [_cell(e) for e in ("maintenance_priority", "condition_status")]
    + [_cell(_js(c)) for c in ("center_x", "center_y", "shadow_length_pixels", "shadow_length_meters", "estimated_height_meters")])
RISK = lambda m, built, cap, low, wet: f"""SELECT image_id, '{m}' AS mode, CASE WHEN {built} > {cap} THEN 'Moderate' ELSE 'Low' END AS encroachment_risk,
    CASE WHEN drains > 0 THEN 'Moderate' ELSE 'Low' END AS drainage_risk, CASE WHEN green < {low} THEN 'Moderate' ELSE 'Low' END AS environmental_risk,
    CASE WHEN water {wet} 5 THEN 'Moderate' ELSE 'Low' END AS flood_risk FROM risk_in"""  # noqa: E731
LEVEL = lambda c, hi, mid: f"CASE WHEN {c} >= {hi} THEN 'High' WHEN {c} >= {mid} THEN 'Moderate' ELSE 'Low' END"

SQL = {
    "ingest_gate": q(f"""SELECT file_id, status, CAST(CASE status WHEN 'accepted' THEN 200 WHEN 'file_too_large' THEN 413 ELSE 400 END AS INT) AS http_code FROM (
        SELECT file_id, CASE WHEN kind = 'image' AND mode NOT IN ({_in(K.ANALYSIS_MODES)}) THEN 'invalid_analysis_mode'
        WHEN kind = 'image' AND coalesce(content_type, '') NOT IN ({_in(K.IMAGE_TYPES)}) THEN 'invalid_image_type'
        WHEN kind = 'video' AND coalesce(content_type, '') NOT IN ({_in(K.VIDEO_TYPES)}) AND {EXT} <> '' AND {EXT} NOT IN ({_in(K.VIDEO_EXTENSIONS)}) THEN 'invalid_video_type'
        WHEN size_bytes = 0 THEN 'empty_file' WHEN size_bytes > (CASE kind WHEN 'image' THEN 50 ELSE 500 END) * 1048576 THEN 'file_too_large' ELSE 'accepted' END AS status FROM files)""", "files"),
    "media_kind": q(f"""SELECT file_id, CASE WHEN content_type LIKE 'video/%' OR {EXT} IN ({_in(K.VIDEO_EXTENSIONS)}) THEN 'video'
        WHEN content_type LIKE 'image/%' OR {EXT} IN ({_in(K.IMAGE_EXTENSIONS)}) THEN 'image' END AS media_kind FROM files""", "files"),
    "explode_tiles": """SELECT vec_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, embedding[i] > 0 AS bright
        FROM embeddings, range(1, 65) AS r(i)""",
    "scan_boxes": q("SELECT image_id, box_idx, cls_id, class_name, x1, y1, x2, y2 FROM named", "named"),
    "to_geojson": q(f"""SELECT image_id, asset_idx, 'Feature' AS type, 'Polygon' AS geometry, {PAIRS('list_append(geo, geo[1])', micro, 2, 1)} AS ring,
        unique_id AS id, category, subcategory, maintenance_priority, condition_status, color, layer_id, confidence_percent FROM located""", "located"),
    "geojson_collections": q("""SELECT image_id, CAST(0 AS INT) AS part, count(*) AS features, 'FeatureCollection' AS type, CAST(count(*) AS INT) AS in_document
        FROM located GROUP BY image_id""", "located"),
    "to_csv": q(f"SELECT image_id, asset_idx, {CSV} AS line FROM assets", "assets"),
    "latest_result": """SELECT user_id, event_id AS result_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
        FROM events WHERE event_type <> 'error' AND value > 2 AND event_id % 5 <> 0) WHERE rn = 1""",
    "safe_num": q(f"""SELECT image_id, asset_idx, coalesce({num('confidence_percent')}, 7.0) AS as_float,
        CASE WHEN {num('confidence_percent')} IS NULL OR isinf({num('confidence_percent')}) THEN CAST(3 AS BIGINT) ELSE CAST(trunc({num('confidence_percent')}) AS BIGINT) END AS as_int,
        CAST(greatest(trunc(coalesce({num('estimated_count')}, 1)), 0) AS BIGINT) AS as_count FROM raw""", "raw"),
    "safe_text": q(f"""SELECT image_id, asset_idx, {txt('unique_id', 'none')} AS id_text,
        {txt("(CASE WHEN coalesce(subcategory, '') = '' THEN subtype ELSE subcategory END)", 'General')} AS sub_text FROM raw""", "raw"),
    "clamp": q(f"""SELECT image_id, asset_idx, {clamp('confidence_percent')} AS bounded,
        CASE WHEN isinf(TRY_CAST(confidence_percent AS DOUBLE)) THEN 0.0 ELSE {clamp('confidence_percent')} END AS shown FROM raw""", "raw"),
    "normalize_category": q(f"SELECT image_id, asset_idx, {norm('category')} AS category FROM raw", "raw"),
    "class_to_category": q(f"""SELECT image_id, box_idx, {alias('class_name')} AS category, {alias("replace(class_name, '_', '-')")} AS from_dashed FROM named""", "named"),
    "repair_point": q("SELECT image_id, asset_idx, center_x AS x, center_y AS y FROM fixed", "fixed"),
    "repair_bbox": q("SELECT image_id, asset_idx, x_min, y_min, x_max, y_max FROM assets", "assets"),
    "repair_polygon": q(f"SELECT image_id, asset_idx, CAST(len(poly) AS INT) AS points, {PAIRS('poly', milli)} AS polygon FROM assets", "assets"),
    "fill_asset_defaults": q(f"SELECT * EXCLUDE (poly), {PAIRS('poly', milli)} AS polygon FROM assets", "assets"),
    "fallback_asset": q(f"""SELECT image_id, asset_idx, unique_id, category, subcategory, estimated_count, visual_description FROM assets
        UNION ALL SELECT o_orderkey, 1, 'asset_1', 'Properties & Buildings', 'Unknown', 0, '{K.TEXT_FALLBACK_DESCRIPTION}' FROM orders
        WHERE o_orderkey NOT IN (SELECT image_id FROM assets)""", "assets"),
    "boxes_to_assets": q(f"""SELECT * EXCLUDE (xa, ya, xb, yb, image_w, image_h), round_even((xa + xb) / 2.0, 4) AS center_x, round_even((ya + yb) / 2.0, 4) AS center_y,
        round_even(xa, 4) AS x_min, round_even(ya, 4) AS y_min, round_even(xb, 4) AS x_max, round_even(yb, 4) AS y_max, 'Monitored' AS condition_status, 'Medium' AS maintenance_priority,
        0.0 AS shadow_length_pixels, 0.0 AS shadow_length_meters, 0.0 AS estimated_height_meters,
        {PAIRS('[[round_even(xa,4),round_even(ya,4)],[round_even(xb,4),round_even(ya,4)],[round_even(xb,4),round_even(yb,4)],[round_even(xa,4),round_even(yb,4)]]', milli)} AS polygon FROM named_assets""", "named_assets"),
    "ring_from_bbox": q(f"SELECT image_id, asset_idx, {PAIRS('[[x_min, y_min], [x_max, y_min], [x_max, y_max], [x_min, y_max]]', milli)} AS ring FROM assets", "assets"),
    "to_area_m2": q("""SELECT image_id, box_idx, greatest((x2 - x1) * (y2 - 100), 0.0) * CASE cls_id WHEN 2 THEN 4.0 WHEN 3 THEN 9.0 ELSE 1.0 END AS area_m2 FROM boxes""", "boxes"),
    "to_length_m": q("SELECT image_id, box_idx, greatest(x2 - 200, 0.0) * 0.5 AS length_m FROM boxes", "boxes"),
    "geo_project": q("SELECT image_id, asset_idx, round(lat, 9) AS lat, round(lng, 9) AS lng FROM located", "located"),
    "confidence_models": q("""SELECT image_id, asset_idx, CASE WHEN 85 + estimated_count * 2 > 99 THEN 99.0 ELSE 85.0 + estimated_count * 2 END AS block,
        greatest(45.0, least(99.0, 60.0 + estimated_coverage_percent * 4)) AS map, greatest(35.0, least(99.0, 45.0 + confidence_percent / 100.0 * 50.0)) AS video FROM assets""", "assets"),
    "asset_row_projection": q(f"SELECT {ROWS}, visual_description, estimation_basis, shadow_length_pixels, shadow_length_meters, estimated_height_meters FROM assets", "assets"),
    "gis_polygons": q(f"""SELECT image_id, asset_idx, unique_id AS id, layer_id, category, subcategory, color, confidence_percent, {PAIRS('geo', micro)} AS coordinates,
        {PAIRS('geo_box', micro)} AS bbox_coordinates, {micro('lat')} || ' ' || {micro('lng')} AS center, maintenance_priority, condition_status FROM located""", "located"),
    "gis_markers": q("""SELECT image_id, asset_idx, unique_id AS id, layer_id, category, subcategory AS label, round(lat, 9) AS lat, round(lng, 9) AS lng, color,
        confidence_percent, estimated_area_sq_m FROM located""", "located"),
    "heat_points": q("SELECT image_id, asset_idx, round(lat, 9) AS lat, round(lng, 9) AS lng, CASE WHEN confidence_percent < 5 THEN 0.05 ELSE confidence_percent / 100.0 END AS weight FROM located", "located"),
    "asset_center": q("""SELECT image_id, asset_idx, CASE WHEN asset_idx % 3 = 0 THEN (x_min + x_max) / 2 ELSE center_x END AS x,
        CASE WHEN asset_idx % 3 = 0 THEN (y_min + y_max) / 2 ELSE center_y END AS y FROM assets""", "assets"),
    "center_line": q(f"""SELECT image_id, asset_idx, CASE WHEN asset_idx % 2 = 0 THEN {PAIRS('poly', milli)}
        WHEN x_max - x_min >= y_max - y_min THEN {PAIRS('[[x_min, (y_min + y_max) / 2], [x_max, (y_min + y_max) / 2]]', milli)}
        ELSE {PAIRS('[[(x_min + x_max) / 2, y_min], [(x_min + x_max) / 2, y_max]]', milli)} END AS line FROM assets""", "assets"),
    "layer_shape": q("""SELECT image_id, asset_idx, CASE WHEN ord IN (5, 6) THEN 'line' WHEN ord IN (2, 3, 4) THEN 'polygon' ELSE 'box' END AS shape FROM located""", "located"),
    "risk_flags": q(RISK("map", "built_m", 40, 25, ">=") + " UNION ALL " + RISK("video", "built_v", 45, 20, ">"), "risk_in"),
    "density_labels": q(f"SELECT image_id, {LEVEL('green', 60, 30)} AS green_density, {LEVEL('road', 10, 4)} AS road_density FROM risk_in", "risk_in"),
    "urban_density": q("SELECT image_id, round_even((built_up_percent + road_network_percent + green_cover_percent) / 3, 2) AS urban_density_score FROM summary", "summary"),
    "insight_texts": q(f"""SELECT r.image_id, 'Detected ' || CAST(c.total AS VARCHAR) || ' assets across ' || CAST(c.classes AS VARCHAR) || ' classes.' AS governance_1,
        'Green cover is ' || CAST(CAST(green AS DOUBLE) AS VARCHAR) || '% while built-up coverage is ' || CAST(CAST(built_m AS DOUBLE) AS VARCHAR) || '%.' AS governance_2,
        'Flood risk indicator: ' || f || '; drainage risk: ' || CASE WHEN drains > 0 THEN 'Moderate' ELSE 'Low' END || '.' AS governance_3,
        'Green density is ' || {LEVEL('green', 60, 30)} || ' (' || printf('%.2f', green) || '%).' AS map_1,
        'Road density is ' || {LEVEL('road', 10, 4)} || ' (' || printf('%.2f', road) || '%).' AS map_2, 'Urban risk score inferred from CV masks is ' || f || '.' AS map_3
        FROM (SELECT *, CASE WHEN water >= 5 THEN 'Moderate' ELSE 'Low' END AS f FROM risk_in) r
        JOIN (SELECT image_id, sum(estimated_count) AS total, count(DISTINCT category) AS classes FROM assets GROUP BY image_id) c ON c.image_id = r.image_id""", "risk_in", "assets"),
    "pad_insights": q(f"""SELECT image_id, asset_idx, CAST(len(p) AS INT) AS n, array_to_string(p, '|') AS insights FROM (
        SELECT image_id, asset_idx, CASE len(k) WHEN 0 THEN [f, f, f] WHEN 1 THEN [k[1], f, f] WHEN 2 THEN [k[1], k[2], f] ELSE k[1:5] END AS p FROM (
        SELECT image_id, asset_idx, '{K.TEXT_FILLER_INSIGHT}' AS f, list_filter(list_transform([unique_id, category, subcategory, subtype, condition_status, maintenance_priority][1:asset_idx % 7], lambda t: trim(t)),
          lambda t: t <> '') AS k FROM raw))""", "raw"),
    "result_valid": """SELECT o_orderkey AS result_id, o_custkey % 5 > 1 AND o_custkey % 3 <> 0 AND o_custkey % 4 <> 0 AND o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AS valid FROM orders""",
    "conf_filter": q("SELECT image_id, box_idx, cls_id, x1, y1 FROM good", "good"),
    "is_building": q(f"""SELECT image_id, asset_idx, coalesce(category ILIKE '%building%', false) AS raw_flag, {norm('category')} = 'Properties & Buildings' AS flag FROM raw""", "raw"),
    "layer_toggle": q("SELECT image_id, asset_idx, layer_id FROM located WHERE layer_id IN ('roads', 'water', 'solar')", "located"),
    "category_search": q("""SELECT image_id, category, "count" FROM chart WHERE category ILIKE '%park%'""", "chart"),
    "degenerate_box": q("""SELECT image_id, asset_idx FROM assets WHERE round_even(least(511.0, x_max / 100.0 * 512), 0) <= round_even(least(511.0, x_min / 100.0 * 512), 0)
        OR round_even(least(383.0, y_max / 100.0 * 384), 0) <= round_even(least(383.0, y_min / 100.0 * 384), 0)""", "assets"),
    "category_dim_join": q("""SELECT image_id, asset_idx, CASE WHEN asset_idx % 5 = 0 THEN 'Other' ELSE category END AS category,
        CASE WHEN asset_idx % 5 = 0 THEN 'unclassified' ELSE layer_id END AS layer_id, CASE WHEN asset_idx % 5 = 0 THEN '#0ea5e9' ELSE color END AS color FROM located""", "located"),
    "renderable_layers": q("SELECT DISTINCT image_id, category, layer_id FROM located WHERE confidence_percent >= 5", "located"),
    "asset_layer_join": q("""SELECT a.image_id, a.asset_idx, a.category, a.layer_id, a.color FROM located a WHERE EXISTS (
        SELECT 1 FROM chart c WHERE c.image_id = a.image_id AND c.category = a.category AND c."count" > 3)""", "located", "chart"),
    "iou_pairs": q("""SELECT image_id, cls_id, idx_a, idx_b, copies_a, copies_b, round(iou, 9) AS iou FROM pairs
        UNION ALL SELECT image_id, cls_id, box_idx, box_idx, copies, copies, 1.0 FROM pair0 WHERE copies > 1""", "pairs", "pair0"),
    "box_nms": q("SELECT image_id, cls_id, box_idx FROM kept_ids", "kept_ids"),
    "category_stats": q("""SELECT image_id, ord, category, "count", round(total_area_sq_m, 6) AS total_area_sq_m, round(coverage_percent, 6) AS coverage_percent FROM stats""", "stats"),
    "category_stats_additive": q("""SELECT s.image_id, s.ord, s.category, s."count" * 2 AS "count", round(s.total_area_sq_m * 2, 6) AS total_area_sq_m,
        round(least(100.0, s.coverage_percent + coalesce(a.c, 0)), 6) AS coverage_percent FROM stats s
        LEFT JOIN (SELECT image_id, category, sum(estimated_coverage_percent) AS c FROM assets GROUP BY ALL) a ON a.image_id = s.image_id AND a.category = s.category""", "stats", "assets"),
    "category_stats_naming": q("""SELECT i.image_id, d.ord, d.category, count(a.image_id) AS "count", round_even(coalesce(sum(a.estimated_area_sq_m), 0.0), 2) AS total_area_sq_m,
        round_even(least(100.0, coalesce(sum(least(coalesce(a.estimated_coverage_percent, 0.0), 100.0)), 0.0)), 4) AS coverage_percent
        FROM (SELECT DISTINCT image_id FROM named_assets) i CROSS JOIN dim d LEFT JOIN named_assets a ON a.image_id = i.image_id AND a.category = d.category GROUP BY ALL""", "named_assets", "dim"),
    "image_summary": q("""SELECT s.* REPLACE (greatest(total_assets_detected, coalesce(o.o_custkey % 40, 0)) AS total_assets_detected) FROM summary s LEFT JOIN orders o ON o.o_orderkey = s.image_id""", "summary"),
    "category_chart": q("SELECT * FROM chart", "chart"),
    "priority_histogram": q("""SELECT image_id, CASE WHEN coalesce(maintenance_priority, '') = '' THEN 'Unknown' ELSE maintenance_priority END AS priority, count(*) AS assets FROM raw GROUP BY ALL""", "raw"),
    "mean_confidence": q("""SELECT o_orderkey AS image_id, round(coalesce(round(m, 2), 0.0), 1) AS mean_confidence FROM orders
        LEFT JOIN (SELECT image_id, avg(confidence_percent) AS m FROM assets GROUP BY image_id) ON image_id = o_orderkey""", "assets"),
    "layer_counts": q("SELECT image_id, layer_id, count(*) AS polygons FROM located GROUP BY ALL", "located"),
    "area_count_summary": q("""SELECT image_id, category, "count", area_sq_m FROM chart UNION ALL SELECT image_id, 'TOTAL', CAST(sum("count") AS BIGINT), sum(area_sq_m) FROM chart GROUP BY image_id""", "chart"),
    "height_summary": q("""SELECT image_id, count(*) AS buildings, round(avg(estimated_height_meters), 9) AS avg_height, min(estimated_height_meters) AS min_height, max(estimated_height_meters) AS max_height
        FROM assets WHERE category = 'Properties & Buildings' AND estimated_height_meters > 0 GROUP BY image_id""", "assets"),
    "dominant_land_use": q("""SELECT image_id, CASE WHEN max(coverage_percent) > 0 THEN arg_min(category, (-coverage_percent, ord)) ELSE 'Unknown' END AS dominant_land_use FROM stats GROUP BY image_id""", "stats"),
    "mode_rollup": q(f"""SELECT mode, category, image_id, CAST(grouping(mode, category, image_id) AS BIGINT) AS level, count(*) AS assets, sum(estimated_area_sq_m) AS area_sq_m
        FROM (SELECT *, CASE image_id % 3 WHEN 0 THEN '{K.ANALYSIS_MODES[0]}' WHEN 1 THEN '{K.ANALYSIS_MODES[1]}' ELSE '{K.ANALYSIS_MODES[2]}' END AS mode FROM assets)
        GROUP BY ROLLUP (mode, category, image_id)""", "assets"),
    "number_assets": q("""SELECT image_id, asset_idx, 'asset_map_' || CAST(row_number() OVER (PARTITION BY image_id ORDER BY ord, center_y, center_x, asset_idx) AS VARCHAR) AS number FROM located""", "located"),
    "rank_categories": q("""SELECT c.image_id, c.category, c."count", CAST(row_number() OVER (PARTITION BY c.image_id ORDER BY c."count" DESC, d.ord) AS INT) AS rank FROM chart c JOIN dim d ON d.category = c.category""", "chart", "dim"),
    "distinct_layers": q("SELECT DISTINCT image_id, layer_id FROM located", "located"),
    "bbox_to_pixels": q("""SELECT image_id, box_idx, CASE WHEN ok THEN ax END AS x1, CASE WHEN ok THEN ay END AS y1, CASE WHEN ok THEN bx END AS x2, CASE WHEN ok THEN y9 END AS y2 FROM (
        SELECT *, bx > ax AND y9 > ay AS ok FROM (SELECT image_id, box_idx, CAST(least(511, x1) AS INT) AS ax, CAST(least(383, y1) AS INT) AS ay, CAST(least(511, x2) AS INT) AS bx, CAST(least(383, y2) AS INT) AS y9
        FROM (SELECT image_id, box_idx, round_even(CASE WHEN p THEN x1 / 100 * 512 ELSE x1 END, 0) AS x1, round_even(CASE WHEN p THEN y1 / 100 * 384 ELSE y1 END, 0) AS y1,
          round_even(CASE WHEN p THEN x2 / 100 * 512 ELSE x2 END, 0) AS x2, round_even(CASE WHEN p THEN y2 / 100 * 384 ELSE y2 END, 0) AS y2
          FROM (SELECT *, greatest(x2, y2) <= 100 AS p FROM boxes))))""", "boxes"),
    "buildings": q("SELECT * FROM bld", "bld"),
    "shadow_match": q("SELECT image_id, asset_idx, shadow_id, round(score, 6) AS score FROM matched", "matched"),
    "farthest_point": q("SELECT image_id, asset_idx, shadow_id, far_x, far_y FROM far", "far"),
    "shadow_length": q("SELECT image_id, asset_idx, round(len, 6) AS length_px FROM lens", "lens"),
    "height_from_shadow": q("""SELECT image_id, shadow_id, round(greatest(half_w - 12, 0.0) * tan(radians(greatest(0.001, least(89.9, cy - 100)))), 6) AS height FROM shadows""", "shadows"),
    "building_heights": q("SELECT image_id, asset_idx, x1, y1, x2, y2, shadow_id, spx AS shadow_length_pixels, sm AS shadow_length_meters, hm AS estimated_height_meters FROM hts", "hts"),
    "heights_to_assets": q("""SELECT a.image_id, a.asset_idx, coalesce(spx, 0.0) AS shadow_length_pixels, coalesce(sm, 0.0) AS shadow_length_meters, coalesce(hm, 0.0) AS estimated_height_meters
        FROM named_assets a LEFT JOIN hts h ON h.image_id = a.image_id AND h.asset_idx = a.asset_idx""", "named_assets", "hts"),
    "heights_export": q("""SELECT image_id, asset_idx, 'building' AS class, concat_ws(' ', x1, y1, x2, y2) AS bbox, hm AS estimated_height_meters FROM hts""", "hts"),
}
