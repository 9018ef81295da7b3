"""Shared relations of the check queries, and a small composer for WITH clauses."""
from __future__ import annotations

from terratally import fixed_values as K
from terratally.sources import fixtures as X

NINE = ", ".join(f"({i}, '{c}', '{l}', '{col}')" for i, (c, l, col, *_rest) in enumerate(K.CATEGORIES, 1))


def num(x: str) -> str:
    """Readable number or null (not a number counts as unreadable)."""
    return f"(CASE WHEN NOT isnan(TRY_CAST({x} AS DOUBLE)) THEN TRY_CAST({x} AS DOUBLE) END)"


def clamp(x: str) -> str:
    return f"(CASE WHEN {num(x)} IS NULL OR {num(x)} < 0 THEN 0.0 WHEN {num(x)} > 100 THEN 100.0 ELSE {num(x)} END)"


def txt(x: str, default: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR trim({x}) = '' THEN '{default}' ELSE trim({x}) END)"


def norm(x: str) -> str:
    """Category by exact name, then by the first matching keyword list."""
    v = f"lower(coalesce(trim({x}), ''))"
    exact = " ".join(f"WHEN {v} = '{c.lower()}' THEN '{c}'" for c, *_ in K.CATEGORIES)
    loose = " ".join(f"WHEN regexp_matches({v}, '{'|'.join(words)}') THEN '{c}'" for c, words in K.CATEGORY_KEYWORDS)
    return f"(CASE WHEN {v} = '' THEN '{K.DEFAULT_CATEGORY}' {exact} {loose} ELSE '{K.DEFAULT_CATEGORY}' END)"


def alias(x: str) -> str:
    key = f"replace(replace(lower(trim({x})), '-', '_'), ' ', '_')"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.CLASS_ALIASES.items())
    return f"(CASE {key} {cases} ELSE {norm(f'replace({x}, ' + repr('_') + ', ' + repr(' ') + ')')} END)"


def milli(x: str) -> str:
    return f"CAST(CAST(round_even({x} * 1000, 0) AS BIGINT) AS VARCHAR)"


def micro(x: str) -> str:
    return f"CAST(CAST(round_even({x} * 1000000, 0) AS BIGINT) AS VARCHAR)"


CTES: dict[str, tuple[str, list[str]]] = {
    "dim": (f"SELECT * FROM (VALUES {NINE}) AS t(ord, category, layer_id, color)", []),
    "boxes0": (X.sql_text(X.BOXES), []),
    "boxes": ("""SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY l_linenumber, l_partkey, l_suppkey, x2, y2, conf) AS INT) AS box_idx,
        cls_id, conf, x1, y1, x2, y2, image_w, image_h FROM boxes0""", ["boxes0"]),
    "named": ("""SELECT *, CASE cls_id WHEN 0 THEN 'buildings' WHEN 1 THEN 'trees' WHEN 2 THEN 'parks_open_spaces' WHEN 3 THEN 'water'
        ELSE 'class_' || CAST(cls_id AS VARCHAR) END AS class_name FROM boxes""", ["boxes"]),
    "good": ("SELECT * FROM named WHERE conf >= 0.25", ["named"]),
    "raw0": (X.sql_text(X.RAW_ASSETS), []),
    "raw": ("""SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY l_linenumber, l_partkey, l_suppkey, bx1, by1, estimated_area_sq_m, estimated_coverage_percent) AS INT) AS asset_idx FROM raw0""", ["raw0"]),
    "fixed": (f"""SELECT image_id, asset_idx,
        CASE WHEN unique_id IS NULL OR trim(unique_id) = '' THEN 'asset_' || CAST(asset_idx AS VARCHAR) ELSE trim(unique_id) END AS unique_id,
        {norm('category')} AS category,
        {txt("(CASE WHEN subcategory IS NULL OR subcategory = '' THEN subtype ELSE subcategory END)", 'General')} AS subcategory,
        {clamp('confidence_percent')} AS confidence_percent,
        CAST(CASE WHEN {num('estimated_count')} IS NULL THEN 1 WHEN {num('estimated_count')} < 0 THEN 0 ELSE trunc({num('estimated_count')}) END AS BIGINT) AS estimated_count,
        CASE WHEN coalesce({num('estimated_area_sq_m')}, 0) < 0 THEN 0.0 ELSE coalesce({num('estimated_area_sq_m')}, 0.0) END AS estimated_area_sq_m,
        CASE WHEN coalesce({num('estimated_count')}, 0) < 0 THEN 0.0 ELSE coalesce({num('estimated_count')}, 0.0) END AS length,
        CASE WHEN coalesce({num('estimated_area_sq_m')}, 0) < 0 THEN 0.0 ELSE coalesce({num('estimated_area_sq_m')}, 0.0) END AS width,
        {clamp('estimated_coverage_percent')} AS estimated_coverage_percent,
        {txt('condition_status', 'Unknown')} AS condition_status, {txt('maintenance_priority', 'Medium')} AS maintenance_priority,
        least(greatest(px, 0.0), 100.0) AS center_x, least(greatest(py, 0.0), 100.0) AS center_y,
        least(greatest(bx0, 0.0), 100.0) AS ax, least(greatest(by0, 0.0), 100.0) AS ay,
        least(greatest(coalesce(bx1, bx0), 0.0), 100.0) AS zx, least(greatest(coalesce(by1, by0), 0.0), 100.0) AS zy,
        px, py, n_points,
        '{K.TEXT_DESCRIPTION}' AS visual_description, '{K.TEXT_BASIS}' AS estimation_basis,
        0.0 AS shadow_length_pixels, 0.0 AS shadow_length_meters,
        CASE WHEN n_points > 1 AND {num('estimated_count')} > 0 THEN {num('estimated_count')} ELSE 0.0 END AS estimated_height_meters
        FROM raw""", ["raw"]),
    "assets": ("""SELECT * EXCLUDE (ax, ay, zx, zy, px, py, n_points),
        least(ax, zx) AS x_min, least(ay, zy) AS y_min, greatest(ax, zx) AS x_max, greatest(ay, zy) AS y_max,
        CASE WHEN n_points >= 3 THEN list_transform([[px, py], [px + 9, py + 1], [px + 7, py + 8], [px - 3, py + 6]][1:n_points],
            lambda p: [least(greatest(p[1], 0.0), 100.0), least(greatest(p[2], 0.0), 100.0)])
        ELSE [[least(ax, zx), least(ay, zy)], [greatest(ax, zx), least(ay, zy)], [greatest(ax, zx), greatest(ay, zy)], [least(ax, zx), greatest(ay, zy)]] END AS poly
        FROM fixed""", ["fixed"]),
    "located": ("""SELECT a.*, coalesce(d.layer_id, 'unclassified') AS layer_id, coalesce(d.color, '#0ea5e9') AS color, d.ord,
        28.6139 - ((center_y - 50.0) / 50.0) * 0.02 AS lat, 77.209 + ((center_x - 50.0) / 50.0) * 0.02 AS lng,
        list_transform(poly, lambda p: [28.6139 - ((p[2] - 50.0) / 50.0) * 0.02, 77.209 + ((p[1] - 50.0) / 50.0) * 0.02]) AS geo,
        list_transform([[x_min, y_min], [x_max, y_min], [x_max, y_max], [x_min, y_max]],
            lambda p: [28.6139 - ((p[2] - 50.0) / 50.0) * 0.02, 77.209 + ((p[1] - 50.0) / 50.0) * 0.02]) AS geo_box
        FROM assets a LEFT JOIN dim d ON a.category = d.category""", ["assets", "dim"]),
    "stats": ("""SELECT i.image_id, d.ord, d.category, CAST(coalesce(sum(a.estimated_count), 0) AS BIGINT) AS "count",
        coalesce(sum(a.estimated_area_sq_m), 0.0) AS total_area_sq_m, least(coalesce(sum(a.estimated_coverage_percent), 0.0), 100.0) AS coverage_percent
        FROM (SELECT DISTINCT image_id FROM assets) i CROSS JOIN dim d
        LEFT JOIN assets a ON a.image_id = i.image_id AND a.category = d.category GROUP BY ALL""", ["assets", "dim"]),
    "summary": ("""SELECT image_id, CAST(sum("count") AS BIGINT) AS total_assets_detected,
        least(sum(coverage_percent) FILTER (ord IN (2, 3)), 100.0) AS green_cover_percent,
        least(sum(coverage_percent) FILTER (ord IN (1, 7)), 100.0) AS built_up_percent,
        sum(coverage_percent) FILTER (ord = 5) AS road_network_percent,
        sum(coverage_percent) FILTER (ord = 4) AS water_body_percent,
        sum(coverage_percent) FILTER (ord = 3) AS open_space_percent FROM stats GROUP BY image_id""", ["stats"]),
    "chart": ("""SELECT a.image_id, a.category, CAST(sum(a.estimated_count) AS BIGINT) AS "count", sum(a.estimated_area_sq_m) AS area_sq_m,
        max(s.coverage_percent) AS coverage_percent, max(d.color) AS color, max(d.layer_id) AS layer_id
        FROM assets a JOIN stats s ON s.image_id = a.image_id AND s.category = a.category JOIN dim d ON d.category = a.category
        GROUP BY a.image_id, a.category""", ["assets", "stats", "dim"]),
    "risk_in": ("""SELECT image_id, sum(coverage_percent) FILTER (ord IN (1, 7)) AS built_v, sum(coverage_percent) FILTER (ord = 1) AS built_m,
        sum("count") FILTER (ord = 6) AS drains, sum(coverage_percent) FILTER (ord IN (2, 3)) AS green,
        sum(coverage_percent) FILTER (ord = 4) AS water, sum(coverage_percent) FILTER (ord = 5) AS road FROM stats GROUP BY image_id""", ["stats"]),
    "named_assets": (f"""SELECT image_id, box_idx AS asset_idx, 'naming_asset_' || CAST(box_idx AS VARCHAR) AS unique_id, {alias('class_name')} AS category,
        class_name AS subcategory, round_even(least(greatest(conf * 100.0, 0.0), 100.0), 2) AS confidence_percent, CAST(1 AS BIGINT) AS estimated_count,
        round_even(greatest(x2 - x1, 0) * greatest(y2 - y1, 0), 2) AS estimated_area_sq_m,
        round_even(greatest(x2 - x1, 0), 2) AS length, round_even(greatest(y2 - y1, 0), 2) AS width,
        round_even(greatest(x2 - x1, 0) * greatest(y2 - y1, 0) / (image_w * image_h) * 100.0, 4) AS estimated_coverage_percent,
        least(greatest(x1 / image_w * 100.0, 0.0), 100.0) AS xa, least(greatest(y1 / image_h * 100.0, 0.0), 100.0) AS ya,
        least(greatest(x2 / image_w * 100.0, 0.0), 100.0) AS xb, least(greatest(y2 / image_h * 100.0, 0.0), 100.0) AS yb, image_w, image_h
        FROM good""", ["good"]),
    "shadows": (X.sql_text(X.SHADOWS), []),
    "frames0": (X.sql_text(X.FRAMES), []),
    "frames": ("SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY ts, event_id) AS INT) AS frame_idx FROM frames0", ["frames0"]),
    "strided": ("""SELECT f.*, greatest(2, CAST(floor(t.n / 300.0) AS INT), 1) AS stride, t.n AS total_frames FROM frames f
        JOIN (SELECT video_id, max(frame_idx) AS n FROM frames GROUP BY video_id) t ON t.video_id = f.video_id""", ["frames"]),
    "sampled": ("SELECT * FROM strided WHERE (frame_idx - 1) % stride = 0", ["strided"]),
    "vstats": ("""SELECT v.video_id, d.ord, d.category, v.frames, CAST(coalesce(sum(s.cnt), 0) AS BIGINT) AS "count",
        coalesce(sum(s.area_px), 0.0) / v.frames AS mean_area_px,
        coalesce(count(s.video_id) FILTER (s.cnt > 0 OR s.area_px > 0), 0) / CAST(v.frames AS DOUBLE) AS presence_ratio
        FROM (SELECT video_id, count(DISTINCT frame_idx) AS frames FROM sampled GROUP BY video_id) v CROSS JOIN dim d
        LEFT JOIN sampled s ON s.video_id = v.video_id AND s.category = d.category GROUP BY v.video_id, d.ord, d.category, v.frames
        HAVING coalesce(sum(s.cnt), 0) > 0 OR coalesce(sum(s.area_px), 0) > 0""", ["sampled", "dim"]),
    "responses": (X.sql_text(X.RESPONSES), []),
    "files": (X.sql_text(X.FILES), []),
    "images": (X.sql_text(X.IMAGES), []),
    "px": (X.sql_text(X.PIXELS), []),
}


def q(select: str, *names: str) -> str:
    """``select`` with the WITH clauses of ``names`` and everything they build on."""
    done: list[str] = []

    def need(n: str) -> None:
        if n in done:
            return
        for d in CTES[n][1]:
            need(d)
        done.append(n)

    for n in names:
        need(n)
    recursive = "RECURSIVE " if any("_rec" in n for n in done) else ""
    head = ",\n".join(f"{n} AS ({CTES[n][0]})" for n in done)
    return f"WITH {recursive}{head}\n{select}" if done else select
