"""Check SQL for responses, frames, streams and modes."""
from __future__ import annotations

from oracle.relations import CTES, clamp, norm, num, q
from terratally import fixed_values as K

TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
CTES["cut_json"] = (f"""SELECT response_id, raw_text, CASE WHEN raw_text = '' THEN '{{}}' WHEN contains(raw_text, '```') THEN {TRIM.format("regexp_replace(string_split(raw_text, '```')[2], '^json', '')")}
    WHEN strpos(raw_text, '{{') > 0 THEN substr(raw_text, strpos(raw_text, '{{'), length(raw_text) - strpos(reverse(raw_text), '}}') + 2 - strpos(raw_text, '{{'))
    ELSE {TRIM.format('raw_text')} END AS j FROM responses""", ["responses"])
CTES["fixed_json"] = ("""SELECT response_id, raw_text, regexp_replace(regexp_replace(j, '[\\x00-\\x1f\\x7f]', '', 'g'), ',\\s*([}\\]])', '\\1', 'g') AS j FROM cut_json""", ["cut_json"])
CTES["docs"] = (f"""SELECT response_id, raw_text, CASE WHEN raw_text <> '' AND json_valid(j) AND json_type(CASE WHEN json_valid(j) THEN j END) = 'OBJECT' THEN j END AS doc,
    CASE WHEN raw_text = '' THEN '{K.WARN_EMPTY}' WHEN NOT json_valid(j) THEN '{K.WARN_PARSE}' WHEN json_type(CASE WHEN json_valid(j) THEN j END) <> 'OBJECT' THEN '{K.WARN_NOT_OBJECT}' END AS parse_warning FROM fixed_json""", ["fixed_json"])
CTES["entries"] = ("""SELECT response_id, CAST(i AS INT) AS asset_idx, json_extract(doc, '$.detected_assets[' || CAST(i - 1 AS VARCHAR) || ']') AS e
    FROM (SELECT response_id, doc, unnest(range(1, CAST(json_array_length(doc, '$.detected_assets') AS BIGINT) + 1)) AS i FROM docs WHERE json_type(doc, '$.detected_assets') = 'ARRAY')""", ["docs"])
_e = lambda p: f"json_extract_string(e, '$.{p}')"
CTES["rassets"] = (f"""SELECT response_id AS image_id, asset_idx, 'asset_' || CAST(asset_idx AS VARCHAR) AS unique_id, {norm(_e('category'))} AS category, 'General' AS subcategory,
    {clamp(_e('confidence_percent'))} AS confidence_percent, CAST({num(_e('estimated_count'))} AS BIGINT) AS estimated_count, {num(_e('estimated_area_sq_m'))} AS estimated_area_sq_m,
    {clamp(_e('estimated_coverage_percent'))} AS estimated_coverage_percent, least({clamp(_e('bounding_box.x_min'))}, 10.0) AS x_min, least(20.0, {clamp(_e('bounding_box.y_max'))}) AS y_min,
    greatest({clamp(_e('bounding_box.x_min'))}, 10.0) AS x_max, greatest(20.0, {clamp(_e('bounding_box.y_max'))}) AS y_max FROM entries WHERE json_type(e) = 'OBJECT'
    UNION ALL SELECT response_id, 1, 'asset_1', 'Properties & Buildings', 'Unknown', 0, 0, 0, 0, 0, 0, 0, 0 FROM docs d
    WHERE NOT EXISTS (SELECT 1 FROM entries n WHERE n.response_id = d.response_id AND json_type(n.e) = 'OBJECT')""", ["entries", "docs"])
_s = lambda p: f"json_extract_string(doc, '$.category_statistics.\"Water Bodies\".{p}')"
CTES["rcov"] = (f"""SELECT a.image_id, CAST(sum(estimated_count) AS BIGINT) AS total, sum(estimated_coverage_percent) FILTER (category IN ('Trees & Green Cover', 'Parks & Open Spaces')) AS green,
    sum(estimated_coverage_percent) FILTER (category = 'Parks & Open Spaces') AS parks, sum(estimated_coverage_percent) FILTER (category = 'Properties & Buildings') AS built,
    coalesce(sum(estimated_coverage_percent) FILTER (category = 'Water Bodies'), 0.0) + max(coalesce({num(_s('coverage_percent'))}, 0.0)) AS water
    FROM rassets a JOIN docs d ON d.response_id = a.image_id GROUP BY a.image_id""", ["rassets", "docs"])
CTES["carried"] = ("""SELECT *, max(CASE WHEN hit THEN frame_idx END) OVER (PARTITION BY video_id ORDER BY frame_idx) AS src FROM (
    SELECT *, (frame_idx - 1) % 3 = 0 AS hit FROM (SELECT *, CAST(event_id + 1 AS INT) AS frame_idx FROM frames0))""", ["frames0"])
CTES["kept_assets"] = ("""SELECT a.*, coalesce(h.hm, 0.0) AS hm FROM named_assets a JOIN kept_ids k ON k.image_id = a.image_id AND k.box_idx = a.asset_idx
    LEFT JOIN hts h ON h.image_id = a.image_id AND h.asset_idx = a.asset_idx""", ["named_assets", "kept_ids", "hts"])
CTES["nstats"] = ("""SELECT b.image_id, least(100.0, coalesce(sum(least(estimated_coverage_percent, 100.0)) FILTER (category IN ('Trees & Green Cover', 'Parks & Open Spaces')), 0.0)) AS green,
    least(100.0, coalesce(sum(least(estimated_coverage_percent, 100.0)) FILTER (category = 'Properties & Buildings'), 0.0)) AS built,
    least(100.0, coalesce(sum(least(estimated_coverage_percent, 100.0)) FILTER (category = 'Water Bodies'), 0.0)) AS water,
    least(100.0, coalesce(sum(least(estimated_coverage_percent, 100.0)) FILTER (category = 'Parks & Open Spaces'), 0.0)) AS parks,
    least(100.0, coalesce(sum(least(estimated_coverage_percent, 100.0)) FILTER (category = 'Trees & Green Cover'), 0.0)) AS trees,
    count(DISTINCT category) AS classes, count(*) AS assets, avg(confidence_percent) AS conf, count(*) FILTER (hm > 0) AS with_height, max(hm) AS max_height
    FROM kept_assets b GROUP BY b.image_id""", ["kept_assets"])
_jt = lambda p: f"(CASE WHEN coalesce(trim(json_extract_string(doc, '{p}')), '') = '' THEN 'Unknown' ELSE trim(json_extract_string(doc, '{p}')) END)"
_ins = "list_filter(list_transform(CAST(json_extract(doc, '$.ai_insights') AS VARCHAR[]), lambda t: trim(t)), lambda t: t <> '')"

SQL = {
    "scan_responses": q("SELECT response_id, CAST(length(raw_text) AS INT) AS chars, raw_text FROM responses", "responses"),
    "extract_json": q("SELECT response_id, j AS json_text FROM cut_json", "cut_json"),
    "repair_json": q("SELECT response_id, j AS json_text FROM fixed_json", "fixed_json"),
    "parse_response": q("SELECT response_id, doc IS NOT NULL AS usable, parse_warning, json_extract_string(doc, '$.risk_analysis.flood_risk') AS flood FROM docs", "docs"),
    "explode_assets": q("SELECT response_id, asset_idx, json_type(e) = 'OBJECT' AS valid, json_extract_string(e, '$.category') AS category FROM entries", "entries"),
    "reject_bad_assets": q("SELECT response_id, asset_idx, 'Asset entry #' || CAST(asset_idx AS VARCHAR) || ' is invalid and was skipped.' AS warning FROM entries WHERE json_type(e) <> 'OBJECT'", "entries"),
    "response_assets": q("SELECT * FROM rassets", "rassets"),
    "collect_warnings": q(f"""SELECT response_id, concat_ws('|', parse_warning, CASE WHEN json_type(doc, '$.detected_assets') = 'ARRAY' THEN 'Asset entry #1 is invalid and was skipped.' END,
        CASE WHEN json_type(doc, '$.detected_assets') = 'VARCHAR' THEN '{K.WARN_NO_LIST}' END,
        CASE WHEN coalesce(json_array_length(doc, '$.detected_assets'), 0) < 2 THEN '{K.WARN_NO_ASSETS}' END,
        CASE WHEN json_type(doc, '$.category_statistics') = 'ARRAY' THEN '{K.WARN_NO_STATS}' END) AS warnings FROM docs""", "docs"),
    "validate_response": q(f"""SELECT d.response_id, {_jt('$.image_analysis.scene_type')} AS scene_type, 'Unknown' AS image_quality,
        coalesce({num("json_extract_string(doc, '$.image_analysis.estimated_total_area_sq_m')")}, 0.0) AS estimated_total_area_sq_m, 0.0 AS overall_detection_confidence_percent, 'Unknown' AS dominant_land_use,
        'Unknown' AS encroachment_risk, 'Unknown' AS drainage_risk, 'Unknown' AS environmental_risk, {_jt('$.risk_analysis.flood_risk')} AS flood_risk,
        CASE WHEN doc IS NULL THEN '{'|'.join(K.DEFAULT_INSIGHTS)}' ELSE array_to_string(list_concat(coalesce({_ins}, []), list_transform(range(greatest(0, 3 - coalesce(len({_ins}), 0))), lambda i: '{K.TEXT_FILLER_INSIGHT}'))[1:5], '|') END AS ai_insights,
        coalesce(green, 0.0) AS green_cover_percent, coalesce(built, 0.0) AS built_up_percent, 0.0 AS road_network_percent, least(100.0, water) AS water_body_percent,
        coalesce(parks, 0.0) AS open_space_percent, total AS total_assets_detected FROM docs d JOIN rcov r ON r.image_id = d.response_id""", "docs", "rcov"),
    "nested_payload": q("""SELECT image_id, CAST(0 AS INT) AS part, count(*) AS rows, CAST(count(*) AS INT) AS in_document, arg_min(unique_id, asset_idx) AS first_id, CAST(sum(estimated_count) AS BIGINT) AS total,
        CAST(count(*) AS INT) AS polygons, CAST(count(*) AS INT) AS markers, CAST(count(*) AS INT) AS points, arg_min(unique_id, asset_idx) AS first_marker, count(*) AS prioritised,
        CAST(sum(estimated_count) AS BIGINT) AS counted, round(sum(estimated_area_sq_m), 4) AS area,
        'Detected ' || CAST(CAST(sum(estimated_count) AS BIGINT) AS VARCHAR) || ' assets across ' || CAST(count(DISTINCT category) AS VARCHAR) || ' classes.' AS governance
        FROM assets GROUP BY image_id""", "assets"),
    "result_document": q("""SELECT s.image_id, CAST(0 AS INT) AS part, a.n AS rows, CAST(s.total_assets_detected AS BIGINT) AS total, round(s.green_cover_percent, 6) AS green, c.pie, c.area, a.n AS prioritised, r.f AS flood_risk,
        CAST(a.n AS INT) AS polygons, CAST(a.n AS INT) AS markers, CAST(a.n AS INT) AS points, 28.6139 AS lat, a.first_row AS first_marker, a.first_row,
        'Detected ' || CAST(CAST(s.total_assets_detected AS BIGINT) AS VARCHAR) || ' assets across ' || CAST(c.classes AS VARCHAR) || ' classes.' AS governance, r.f AS flood_again
        FROM summary s JOIN (SELECT image_id, count(*) AS n, arg_min(unique_id, asset_idx) AS first_row FROM assets GROUP BY image_id) a ON a.image_id = s.image_id
        JOIN (SELECT image_id, string_agg(h.category || ':' || CAST("count" AS VARCHAR) || h.color, '|' ORDER BY d.ord) AS pie, round(sum(area_sq_m), 4) AS area, count(*) AS classes
          FROM chart h JOIN dim d ON d.category = h.category GROUP BY image_id) c ON c.image_id = s.image_id
        JOIN (SELECT image_id, CASE WHEN water >= 5 THEN 'Moderate' ELSE 'Low' END AS f FROM risk_in) r ON r.image_id = s.image_id""", "summary", "assets", "chart", "dim", "risk_in"),
    "read_frames": q("SELECT video_id, frame_idx, ts, category, cnt, round(area_px, 6) AS area_px FROM frames", "frames"),
    "sample_frames": q("""SELECT video_id, frame_idx, k AS stride, category, cnt FROM (SELECT *, CAST(greatest(2, floor(max(frame_idx) OVER (PARTITION BY video_id) / 20.0)) AS INT) AS k FROM frames) WHERE (frame_idx - 1) % k = 0""", "frames"),
    "carry_forward": q("""SELECT a.video_id, a.frame_idx, a.frame_idx = b.frame_idx AS sampled, b.category, b.cnt, round(b.area_px, 6) AS area_px
        FROM (SELECT *, CAST(greatest(3, floor(max(frame_idx) OVER (PARTITION BY video_id) / 20.0)) AS INT) AS k FROM frames) a
        JOIN frames b ON b.video_id = a.video_id AND b.frame_idx = a.frame_idx - (a.frame_idx - 1) % a.k""", "frames"),
    "video_category_stats": q("""SELECT video_id, ord, category, "count", round(mean_area_px, 6) AS mean_area_px, round(least(100.0, mean_area_px / 100000.0 * 100.0), 8) AS coverage_percent,
        round(presence_ratio, 9) AS presence_ratio, round_even(greatest(35.0, least(99.0, 45.0 + presence_ratio * 50.0)), 2) AS confidence_percent FROM vstats""", "vstats"),
    "video_stats_with_empty": q("""SELECT v.video_id, d.ord, d.category, CAST(sum(s.cnt) AS BIGINT) AS "count", round(sum(s.area_px) / v.frames, 6) AS mean_area_px,
        round(count(*) / CAST(v.frames AS DOUBLE), 9) AS presence_ratio
        FROM (SELECT video_id, count(DISTINCT frame_idx) AS frames FROM sampled GROUP BY video_id) v JOIN sampled s ON s.video_id = v.video_id AND s.cnt > 0 JOIN dim d ON d.category = s.category
        GROUP BY v.video_id, d.ord, d.category, v.frames""", "sampled", "dim"),
    "carry_with_empty": q("""SELECT a.video_id, a.frame_idx, CASE WHEN b.cnt > 0 THEN b.category END AS category, b.cnt
        FROM (SELECT *, CAST(greatest(3, floor(max(frame_idx) OVER (PARTITION BY video_id) / 20.0)) AS INT) AS k FROM frames) a
        JOIN frames b ON b.video_id = a.video_id AND b.frame_idx = a.frame_idx - (a.frame_idx - 1) % a.k""", "frames"),
    "video_header": q("""SELECT f.video_id, CAST(max(frame_idx) AS BIGINT) AS source_total_frames, CAST(max(frame_idx) AS BIGINT) AS processed_frames,
        count(DISTINCT frame_idx) FILTER ((frame_idx - 1) % k = 0) AS detected_frames, max(k) AS frame_stride, 12.0 AS fps
        FROM (SELECT *, CAST(greatest(2, floor(max(frame_idx) OVER (PARTITION BY video_id) / 20.0)) AS INT) AS k FROM frames) f GROUP BY f.video_id""", "frames"),
    "video_assets": q("""SELECT video_id AS image_id, 'video_' || replace(replace(lower(category), ' ', '_'), '&', 'and') AS unique_id, category, "count" AS estimated_count,
        'Frame-level detections for ' || category || ' across ' || CAST(frames AS VARCHAR) || ' analyzed frames.' AS visual_description, '5000 5000;95000 5000;95000 95000;5000 95000' AS polygon FROM vstats""", "vstats"),
    "stream_video_stats": q("""SELECT v.video_id, v.frames, d.ord, d.category, CAST(coalesce(sum(f.cnt), 0) AS BIGINT) AS "count", round(coalesce(sum(f.area_px), 0.0), 4) AS area_sum,
        count(f.video_id) FILTER (f.cnt > 0 OR f.area_px > 0) AS presence FROM (SELECT video_id, count(*) AS frames FROM frames0 GROUP BY 1) v CROSS JOIN dim d
        LEFT JOIN frames0 f ON f.video_id = v.video_id AND f.category = d.category GROUP BY ALL""", "frames0", "dim"),
    "stream_window_stats": q("""SELECT date_trunc('day', ts) AS window_start, category, CAST(sum(cnt) AS BIGINT) AS "count", round(sum(area_px), 4) AS area_sum, count(*) AS frames FROM frames0
        GROUP BY 1, 2""", "frames0"),
    "stream_sample": q("SELECT video_id, CAST(event_id + 1 AS INT) AS frame_idx, category, cnt FROM frames0 WHERE event_id % 3 = 0", "frames0"),
    "stream_carry_forward": q("""SELECT a.video_id, a.frame_idx, a.hit AS sampled, b.category, b.cnt FROM carried a LEFT JOIN carried b ON b.video_id = a.video_id AND b.frame_idx = a.src""", "carried"),
    "stream_ingest": q("""SELECT response_id, status, CAST(CASE status WHEN 'accepted' THEN 200 WHEN 'file_too_large' THEN 413 ELSE 400 END AS INT) AS http_code,
        CASE WHEN status = 'accepted' THEN parse_warning END AS parse_warning, CASE WHEN status = 'accepted' THEN json_extract_string(doc, '$.image_analysis.scene_type') END AS scene_type
        FROM (SELECT *, CASE WHEN response_id % 11 = 0 THEN 'invalid_analysis_mode' WHEN response_id % 7 = 0 THEN 'invalid_image_type' WHEN raw_text = '' THEN 'empty_file'
            WHEN response_id % 5 = 0 AND length(raw_text) * 1000000 > 50 * 1048576 THEN 'file_too_large' ELSE 'accepted' END AS status FROM docs)""", "docs"),
    "naming_assets": q("""SELECT image_id, n AS asset_idx, 'naming_asset_' || CAST(n AS VARCHAR) AS unique_id, category, confidence_percent, round_even(xa, 4) AS x_min, round_even(ya, 4) AS y_min, round_even(xb, 4) AS x_max, round_even(yb, 4) AS y_max, estimated_area_sq_m FROM (
        SELECT a.*, CAST(row_number() OVER (PARTITION BY a.image_id ORDER BY b.conf DESC, b.box_idx) AS INT) AS n FROM named_assets a JOIN kept_ids k ON k.image_id = a.image_id AND k.box_idx = a.asset_idx
        JOIN boxes b ON b.image_id = a.image_id AND b.box_idx = a.asset_idx)""", "named_assets", "kept_ids", "boxes"),
    "naming_insights": q(f"""SELECT image_id, 'Naming Analysis used YOLO model detector.pt on image resolution 512x384.' AS insight_1,
        'Detected ' || CAST(count(box) AS VARCHAR) || ' asset candidates across mapped categories.' AS insight_2, '{K.NAMING_INSIGHTS[2]}' AS insight_3,
        CASE WHEN count(box) = 0 THEN '{K.WARN_NO_BOXES}|' ELSE '' END || 'Area estimates use METERS_PER_PIXEL=1.0.' AS warnings
        FROM (SELECT b.image_id, k.box_idx AS box FROM (SELECT DISTINCT image_id FROM boxes) b LEFT JOIN kept_ids k ON k.image_id = b.image_id) GROUP BY image_id""", "boxes", "kept_ids"),
    "video_insights": q(f"""SELECT v.video_id, 'Processed ' || CAST(max(t.n) AS VARCHAR) || ' frames at 12.00 FPS source rate (1000x100); analyzed ' || CAST(max(v.frames) AS VARCHAR) || ' frames with stride ' || CAST(max(t.k) AS VARCHAR) || '.' AS insight_1,
        '{K.VIDEO_INSIGHTS[1]}' AS insight_2, 'Dominant land use trend is ' || arg_min(category, (-mean_area_px, ord)) || ' with average coverage context from processed frames.' AS insight_3
        FROM vstats v JOIN (SELECT video_id, max(total_frames) AS n, max(stride) AS k FROM strided GROUP BY video_id) t ON t.video_id = v.video_id GROUP BY v.video_id""", "vstats", "strided"),
    "analyze_naming": q("""SELECT b.image_id, 'YOLO Spatial Asset Detection' AS scene_type, 196608.0 AS estimated_total_area_sq_m, 'Mixed Urban' AS dominant_land_use, coalesce(assets, 0) AS total_assets_detected,
        round(coalesce(green, 0.0), 6) AS green_cover_percent, round(coalesce(built, 0.0), 6) AS built_up_percent, 0.0 AS road_network_percent, round(coalesce(water, 0.0), 6) AS water_body_percent,
        round(coalesce(parks, 0.0), 6) AS open_space_percent, round(coalesce((built + green) / 3.0, 0.0), 6) AS urban_density_score, coalesce(assets, 0) AS assets, coalesce(classes, 0) AS classes,
        coalesce(with_height, 0) AS with_height, coalesce(max_height, 0.0) AS max_height, coalesce(round_even(conf, 2), 0.0) AS overall_detection_confidence_percent,
        'Unknown' AS encroachment_risk, 'Unknown' AS drainage_risk, 'Unknown' AS environmental_risk, 'Unknown' AS flood_risk
        FROM (SELECT DISTINCT image_id FROM boxes) b LEFT JOIN nstats n ON n.image_id = b.image_id""", "boxes", "nstats"),
    "analyze_video": q("""SELECT video_id, max(n) AS source_total_frames, max(n) AS processed_frames, max(frames) AS detected_frames, max(k) AS frame_stride, 12.0 AS fps, CAST(sum("count") AS BIGINT) AS total_assets_detected,
        round_even(coalesce(sum(cov) FILTER (ord IN (2, 3)), 0.0), 2) AS green_cover_percent, round_even(coalesce(sum(cov) FILTER (ord IN (1, 7)), 0.0), 2) AS built_up_percent,
        round_even(coalesce(sum(cov) FILTER (ord = 5), 0.0), 2) AS road_network_percent, round_even(coalesce(sum(cov) FILTER (ord = 4), 0.0), 2) AS water_body_percent, 0.0 AS open_space_percent,
        arg_min(category, (-cov, ord)) AS dominant_land_use, round_even(avg(round_even(45.0 + presence_ratio * 50.0, 2)), 2) AS overall_detection_confidence_percent,
        CASE WHEN coalesce(sum(cov) FILTER (ord IN (1, 7)), 0.0) > 45 THEN 'Moderate' ELSE 'Low' END AS encroachment_risk, CASE WHEN coalesce(sum("count") FILTER (ord = 6), 0) > 0 THEN 'Moderate' ELSE 'Low' END AS drainage_risk,
        CASE WHEN coalesce(sum(cov) FILTER (ord IN (2, 3)), 0.0) < 20 THEN 'Moderate' ELSE 'Low' END AS environmental_risk, CASE WHEN coalesce(sum(cov) FILTER (ord = 4), 0.0) > 5 THEN 'Moderate' ELSE 'Low' END AS flood_risk
        FROM (SELECT v.*, least(100.0, mean_area_px / 100000.0 * 100.0) AS cov, s.n, s.k FROM vstats v JOIN (SELECT video_id, CAST(max(total_frames) AS BIGINT) AS n, max(stride) AS k FROM strided GROUP BY video_id) s ON s.video_id = v.video_id)
        GROUP BY video_id""", "vstats", "strided"),
}
