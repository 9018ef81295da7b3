"""Check SQL for connected regions, edges, and the queries built on them."""
from __future__ import annotations

from oracle.raster_sql import CLASS, band, box, cleaned, tone, words
from oracle.relations import CTES, q
from terratally import fixed_values as K
from terratally.plans.raster_queries import MAP_SCALE, SHADOW_AREA, VIDEO_SCALE


def labels(name: str, pixels: str, needs: list[str], reach: int) -> None:
    """CTEs for the connected runs of set pixels (image_id, w, h, mask, y, x): ``name``_runs with id, and ``name``_rec with the
    least raster index of each run's region. reach 1: corners connect; 0: sides only."""
    CTES[f"{name}_runs"] = (f"""SELECT image_id, w, h, mask, y, min(x) AS x0, max(x) AS x1, row_number() OVER () AS id FROM (
        SELECT *, x - row_number() OVER (PARTITION BY image_id, mask, y ORDER BY x) AS g FROM ({pixels})) GROUP BY image_id, w, h, mask, y, g""", needs)
    CTES[f"{name}_links"] = (f"""SELECT a.id AS a, b.id AS b FROM {name}_runs a JOIN {name}_runs b ON b.image_id = a.image_id AND b.mask = a.mask AND b.y = a.y + 1
        AND b.x0 <= a.x1 + {reach} AND a.x0 <= b.x1 + {reach}""", [f"{name}_runs"])
    CTES[f"{name}_both"] = (f"SELECT a, b FROM {name}_links UNION ALL SELECT b, a FROM {name}_links", [f"{name}_links"])
    CTES[f"{name}_rec(id, lab) USING KEY (id)"] = (f"""SELECT id, CAST(y AS BIGINT) * w + x0 FROM {name}_runs UNION
        SELECT e.b, min(l.lab) FROM {name}_rec l JOIN {name}_both e ON e.a = l.id JOIN recurring.{name}_rec c ON c.id = e.b WHERE l.lab < c.lab GROUP BY e.b""", [f"{name}_runs", f"{name}_both"])
    CTES[f"{name}_lab"] = (f"SELECT r.*, l.lab FROM {name}_runs r JOIN {name}_rec l ON l.id = r.id", [f"{name}_runs", f"{name}_rec(id, lab) USING KEY (id)"])


def long(source: str, masks: dict[str, str], extra: str = "") -> str:
    """Set pixels of several masks; masks maps a name to a condition."""
    return " UNION ALL ".join(f"SELECT image_id, w, h, '{n}' AS mask, y, x{extra} FROM ({source}) WHERE {c}" for n, c in masks.items())


def filled(name: str, source: str, masks: dict[str, str], needs: list[str]) -> None:
    """``name``_solid: set pixels with holes filled; ``name``_lab: their regions; ``name``_stats: the figures."""
    labels(f"{name}_hole", long(source, {n: f"NOT ({c})" for n, c in masks.items()}), needs, 0)
    CTES[f"{name}_outer"] = (f"SELECT DISTINCT image_id, mask, lab FROM {name}_hole_lab WHERE y = 0 OR y = h - 1 OR x0 = 0 OR x1 = w - 1", [f"{name}_hole_lab"])
    CTES[f"{name}_inner"] = (f"""SELECT image_id, w, h, mask, y, CAST(unnest(range(x0, x1 + 1)) AS INT) AS x FROM {name}_hole_lab l
        WHERE NOT EXISTS (SELECT 1 FROM {name}_outer o WHERE o.image_id = l.image_id AND o.mask = l.mask AND o.lab = l.lab)""", [f"{name}_hole_lab", f"{name}_outer"])
    CTES[f"{name}_solid"] = (f"{long(source, masks)} UNION ALL SELECT image_id, w, h, mask, y, x FROM {name}_inner", [*needs, f"{name}_inner"])
    labels(name, f"SELECT * FROM {name}_solid", [f"{name}_solid"], 1)
    CTES[f"{name}_px"] = (f"SELECT image_id, w, h, mask, lab, y, CAST(unnest(range(x0, x1 + 1)) AS INT) AS x FROM {name}_lab", [f"{name}_lab"])
    # twice the outline area that a 2x2 block with its upper left pixel set, or with only that one missing, adds
    at = lambda dy, dx: f"EXISTS (SELECT 1 FROM {name}_px n WHERE n.image_id = p.image_id AND n.mask = p.mask AND n.y = p.y + {dy} AND n.x = p.x + {dx})"
    CTES[f"{name}_corner"] = (f"""SELECT image_id, mask, lab, sum(CASE WHEN b + c + d = 3 THEN 2 WHEN b + c + d = 2 THEN 1 ELSE 0 END + CASE WHEN l = 0 AND cl = 1 AND c = 1 THEN 1 ELSE 0 END) / 2.0 AS area FROM (
        SELECT image_id, mask, lab, CAST({at(0, 1)} AS INT) AS b, CAST({at(1, 0)} AS INT) AS c, CAST({at(1, 1)} AS INT) AS d, CAST({at(0, -1)} AS INT) AS l, CAST({at(1, -1)} AS INT) AS cl FROM {name}_px p)
        GROUP BY image_id, mask, lab""", [f"{name}_px"])
    CTES[f"{name}_stats"] = (f"""SELECT s.*, c.area, max_x - min_x + 1 AS bw, max_y - min_y + 1 AS bh FROM (
        SELECT image_id, w, h, mask, lab AS comp_id, count(*) AS n, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, avg(CAST(x AS DOUBLE)) AS cx, avg(CAST(y AS DOUBLE)) AS cy
        FROM {name}_px GROUP BY image_id, w, h, mask, lab) s JOIN {name}_corner c ON c.image_id = s.image_id AND c.mask = s.mask AND c.lab = s.comp_id""", [f"{name}_px", f"{name}_corner"])


labels("gb", long("SELECT * FROM bands", {"green": "green", "bright": "bright"}), ["bands"], 1)
filled("br", "SELECT * FROM bands", {"bright": "bright", "road": "road"}, ["bands"])

# gradient edges: differences over three rows or columns with repeated borders, local maxima along the direction
_near = lambda c, order, part: f"coalesce(lag({c}) OVER ({part} ORDER BY {order}), {c}) AS lo, coalesce(lead({c}) OVER ({part} ORDER BY {order}), {c}) AS hi"
_row, _col = "PARTITION BY image_id, y", "PARTITION BY image_id, x"
CTES["sob1"] = (f"SELECT image_id, w, h, y, x, hi - lo AS ddx, lo + 2 * gray + hi AS sx FROM (SELECT *, {_near('gray', 'x', _row)} FROM hsv)", ["hsv"])
CTES["sob2"] = (f"""SELECT image_id, w, h, y, x, coalesce(lag(ddx) OVER v, ddx) + 2 * ddx + coalesce(lead(ddx) OVER v, ddx) AS dx, coalesce(lead(sx) OVER v, sx) - coalesce(lag(sx) OVER v, sx) AS dy
    FROM sob1 WINDOW v AS ({_col} ORDER BY y)""", ["sob1"])
CTES["mags"] = ("SELECT *, abs(dx) + abs(dy) AS mag FROM sob2", ["sob2"])
CTES["mag3"] = (f"SELECT *, coalesce(lag(mag) OVER r, 0) AS m_w, coalesce(lead(mag) OVER r, 0) AS m_e FROM mags WINDOW r AS ({_row} ORDER BY x)", ["mags"])
CTES["mag9"] = (f"""SELECT *, coalesce(lag(mag) OVER v, 0) AS m_n, coalesce(lead(mag) OVER v, 0) AS m_s, coalesce(lag(m_w) OVER v, 0) AS m_nw, coalesce(lag(m_e) OVER v, 0) AS m_ne,
    coalesce(lead(m_w) OVER v, 0) AS m_sw, coalesce(lead(m_e) OVER v, 0) AS m_se FROM mag3 WINDOW v AS ({_col} ORDER BY y)""", ["mag3"])
CTES["peaks"] = ("""SELECT image_id, w, h, y, x, mag > 60 AND CASE WHEN abs(dy) * 32768 < abs(dx) * 13573 THEN mag > m_w AND mag >= m_e
    WHEN abs(dy) * 32768 > abs(dx) * 13573 + abs(dx) * 65536 THEN mag > m_n AND mag >= m_s
    WHEN (dx >= 0) = (dy >= 0) THEN mag > m_nw AND mag > m_se ELSE mag > m_ne AND mag > m_sw END AS weak, mag > 160 AS strong FROM mag9""", ["mag9"])
labels("edge", long("SELECT * FROM peaks", {"edges": "weak"}), ["peaks"], 1)
CTES["edges"] = ("""SELECT p.image_id, p.w, p.h, p.y, p.x, l.lab IS NOT NULL AS edges FROM peaks p LEFT JOIN (
    SELECT l.image_id, l.y, CAST(unnest(range(x0, x1 + 1)) AS INT) AS x, l.lab FROM edge_lab l WHERE l.lab IN (
      SELECT s.lab FROM edge_lab s JOIN peaks k ON k.image_id = s.image_id AND k.y = s.y AND k.x BETWEEN s.x0 AND s.x1 AND k.weak AND k.strong WHERE s.image_id = l.image_id)) l
    ON l.image_id = p.image_id AND l.y = p.y AND l.x = p.x""", ["peaks", "edge_lab"])


def without_zero(sql: str) -> str:
    return f"SELECT * FROM ({sql}) WHERE bits <> 0"


_dark = cleaned("SELECT b.image_id, i.w, i.h, b.y, b.x, b.v - m.mean <= -7 AS dark FROM blurred b JOIN local_mean m ON m.image_id = b.image_id AND m.y = b.y AND m.x = b.x JOIN images i ON i.image_id = b.image_id", "dark", 3)
CTES["darks"] = (_dark, ["blurred", "local_mean", "images"])
filled("dk", "SELECT * FROM darks", {"dark": "dark"}, ["darks"])

# border following pixel by pixel; directions run counterclockwise from east, nb has a bit for each set neighbour
_dx, _dy = "[1, 1, 0, -1, -1, -1, 0, 1]", "[0, -1, -1, -1, 0, 1, 1, 1]"
_go = "((back + list_filter([1, 2, 3, 4, 5, 6, 7, 8], lambda k: (nb >> CAST((back + k) % 8 AS INT)) & 1 = 1)[1]) % 8)"


def outline(name: str) -> str:
    CTES[f"{name}_nb"] = (f"""SELECT p.image_id, p.mask, p.lab, p.w, p.y, p.x, CAST(sum(CASE WHEN n.x IS NULL THEN 0 ELSE 1 << d END) AS INT) AS nb
        FROM {name}_px p CROSS JOIN range(8) AS r(d) LEFT JOIN {name}_px n ON n.image_id = p.image_id AND n.mask = p.mask AND n.x = p.x + {_dx}[d + 1] AND n.y = p.y + {_dy}[d + 1]
        GROUP BY ALL HAVING nb <> 255""", [f"{name}_px"])
    CTES[f"{name}_first"] = (f"""SELECT image_id, mask, lab, x, y, nb, CAST(CASE WHEN nb & 1 = 1 THEN 0 WHEN nb & 128 = 128 THEN 7 WHEN nb & 64 = 64 THEN 6 ELSE 5 END AS BIGINT) AS back
        FROM {name}_nb WHERE lab = CAST(y AS BIGINT) * w + x""", [f"{name}_nb"])
    state = "image_id, mask, lab, step, x, y, back, nb, x9, y9, back9"
    CTES[f"{name}_walk_rec({state})"] = (f"""SELECT image_id, mask, lab, 0, x, y, back, nb, x, y, back FROM {name}_first WHERE nb <> 0 UNION ALL
        SELECT t.image_id, t.mask, t.lab, t.step + 1, n.x, n.y, (t.go + 4) % 8, n.nb, x9, y9, back9 FROM (SELECT *, {_go} AS go FROM {name}_walk_rec) t
        JOIN {name}_nb n ON n.image_id = t.image_id AND n.mask = t.mask AND n.x = t.x + {_dx}[t.go + 1] AND n.y = t.y + {_dy}[t.go + 1]
        WHERE NOT (n.x = x9 AND n.y = y9 AND (t.go + 4) % 8 = back9)""", [f"{name}_first", f"{name}_nb"])
    walk = f"{name}_walk_rec({state})"
    CTES[f"{name}_corners"] = (f"""SELECT image_id, mask, lab, step, x, y FROM (
        SELECT *, coalesce(lag(go) OVER g, last_value(go) OVER (PARTITION BY image_id, mask, lab ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS came
        FROM (SELECT *, {_go} AS go FROM {name}_walk_rec) WINDOW g AS (PARTITION BY image_id, mask, lab ORDER BY step)) WHERE go <> came
        UNION ALL SELECT image_id, mask, lab, 0, x, y FROM {name}_first WHERE nb = 0""", [walk, f"{name}_first"])
    return q(f"""SELECT image_id, mask, lab AS comp_id, string_agg(CAST(x * 1000 AS VARCHAR) || ' ' || CAST(y * 1000 AS VARCHAR), ';' ORDER BY step) AS outline
        FROM {name}_corners GROUP BY image_id, mask, lab""", f"{name}_corners")


CTES["cells"] = (f"""SELECT image_id, 35 AS w, max(gh) AS h, CAST(a.cell AS INT) AS y, x, {tone('r')}, {tone('g')}, {tone('b')} FROM (
    SELECT image_id, h, max(greatest(1, CAST(floor(35 * (h / w)) AS INT))) AS gh, y, CAST(a.cell AS INT) AS x, {tone('r')}, {tone('g')}, {tone('b')} FROM px JOIN ax a ON a.n = w AND a.pos = x GROUP BY image_id, h, y, a.cell) p
    JOIN ay a ON a.n = h AND a.pos = y GROUP BY image_id, a.cell, x""", ["px", "ax", "ay"])
CTES["classed"] = (f"SELECT image_id, w, h, y, x, {CLASS} AS mask FROM cells", ["cells"])
labels("blk", "SELECT * FROM classed", ["classed"], 0)



def put(src: str, new: dict[str, str], old: dict[str, str] | None = None) -> str:
    """Columns added, and columns replaced."""
    swap = f" REPLACE ({', '.join(f'{e} AS {n}' for n, e in old.items())})" if old else ""
    return f"SELECT *{swap}{''.join(f', {e} AS {n}' for n, e in new.items())} FROM ({src})"


def clean(src: str, **sizes: int) -> str:
    for c, k in sizes.items():
        src = cleaned(src, c, k)
    return src


def kept(name: str, first: str, masks: list[str], rule: str, gate: str = "true") -> None:
    """``name``_kept: regions that pass; ``name``_drawn: ``first`` with the masks drawn anew from them."""
    filled(name, f"SELECT * FROM {first}", {m: m for m in masks}, [first])
    CTES[f"{name}_kept"] = (f"""SELECT * FROM (SELECT *, count(*) OVER g AS c, sum(n) OVER g / (w * CAST(h AS DOUBLE)) * 100.0 AS pct FROM (
        SELECT *, greatest(bw, bh) / greatest(least(bw, bh), 1) AS aspect, area / greatest(bw * bh, 1) AS extent FROM {name}_stats) WHERE {rule} WINDOW g AS (PARTITION BY image_id, mask)) WHERE {gate}""", [f"{name}_stats"])
    CTES[f"{name}_on"] = (f"SELECT p.image_id, p.mask, p.y, p.x FROM {name}_px p JOIN {name}_kept k ON k.image_id = p.image_id AND k.mask = p.mask AND k.comp_id = p.lab", [f"{name}_px", f"{name}_kept"])
    joins = " ".join(f"LEFT JOIN (SELECT * FROM {name}_on WHERE mask = '{m}') j_{m} ON j_{m}.image_id = f.image_id AND j_{m}.y = f.y AND j_{m}.x = f.x" for m in masks)
    CTES[f"{name}_drawn"] = (f"SELECT f.* REPLACE ({', '.join(f'j_{m}.x IS NOT NULL AS {m}' for m in masks)}) FROM {first} f {joins}", [first, f"{name}_on"])


# the map masks
_m = box("SELECT b.*, e.edges FROM bands b JOIN edges e ON e.image_id = b.image_id AND e.y = b.y AND e.x = b.x", {"thick": ("edges", "max", 3)})
_m = clean(put(clean(_m, green=5), {}, {"water": "water AND NOT green"}), water=5)
_m = box(box(_m, {"grown": ("green", "max", 9)}), {"parks": ("grown", "min", 9)})
_m = clean(put(_m, {}, {"road": "(road OR thick) AND NOT green AND NOT water"}), road=3)
_m = clean(put(_m, {"building": "bright AND NOT green AND NOT water AND NOT road"}), building=3)
_m = box(_m, {"near_road": ("road", "max", 9), "near_water": ("water", "max", 9)})
_m = clean(put(_m, {"drain": "dark AND (near_road OR near_water) AND NOT green", "vehicle": "bright AND near_road"}), drain=3)
CTES["map_first"] = (_m, ["bands", "edges"])
kept("mf", "map_first", ["building", "parks", "vehicle"], f"""(mask = 'building' AND area BETWEEN {80 * MAP_SCALE} AND {20000 * MAP_SCALE} AND bw / bh > 0.25 AND bw / bh < 4 AND extent > 0.25)
    OR (mask = 'parks' AND area > {5000 * MAP_SCALE}) OR (mask = 'vehicle' AND area BETWEEN {8 * MAP_SCALE} AND {120 * MAP_SCALE} AND bw / bh > 0.4 AND bw / bh < 3.5)""")
_m = box("SELECT * FROM mf_drawn", {"near": ("building", "max", 9)})
_m = clean(put(_m, {}, {"waste": "waste AND NOT road AND NOT building", "solar": "solar AND near"}), waste=5, solar=3)
CTES["map_last"] = (_m, ["mf_drawn"])

# the frame masks
_s = VIDEO_SCALE
CTES["frame_bands"] = ("SELECT image_id, w, h, y, x, " + ", ".join(f"{band('video', n)} AS {n}" for n in ("green", "water", "road", "lowsat", "bright", "roof", "dark", "waste", "solar")) + " FROM hsv", ["hsv"])
_v = clean(put(clean("SELECT * FROM frame_bands", green=5), {}, {"water": "water AND NOT green"}), water=5)
CTES["frame_1"] = (box(box(_v, {"grown": ("green", "max", 11)}), {"parks": ("grown", "min", 11)}), ["frame_bands"])
kept("f1", "frame_1", ["parks", "water"], f"area >= CASE mask WHEN 'parks' THEN {8000 * _s} ELSE {1500 * _s} END")
CTES["frame_2"] = (clean(put("SELECT * FROM f1_drawn", {}, {"road": "(road OR lowsat) AND NOT green AND NOT water"}), road=5), ["f1_drawn"])
kept("f2", "frame_2", ["road"], f"area >= {2500 * _s} AND aspect >= 3.0 AND extent >= 0.18")
_v = put("SELECT * FROM f2_drawn", {"building": "bright AND roof AND NOT green AND NOT road AND NOT water"})
_v = box(_v, {"ctx_road": ("road", "max", 11), "ctx_water": ("water", "max", 11), "near_road": ("road", "max", 7)})
_v = put(_v, {"drain": "dark AND (ctx_road OR ctx_water) AND NOT green", "vehicle": "bright AND near_road AND NOT green"})
CTES["frame_3"] = (clean(_v, building=3, drain=3, vehicle=2), ["f2_drawn"])
kept("f3", "frame_3", ["building", "drain", "vehicle"], f"""(mask = 'building' AND area BETWEEN {220 * _s} AND {18000 * _s} AND aspect <= 4.5 AND extent >= 0.45)
    OR (mask = 'drain' AND area BETWEEN {180 * _s} AND {8000 * _s} AND aspect >= 4.0 AND extent >= 0.12)
    OR (mask = 'vehicle' AND area BETWEEN {12 * _s} AND {180 * _s} AND aspect <= 4.0 AND extent >= 0.35)""", "mask = 'drain' OR (mask = 'building' AND c >= 2 AND pct > 0.05) OR (mask = 'vehicle' AND c >= 3)")
_v = box("SELECT * FROM f3_drawn", {"near": ("building", "max", 7)})
_v = put(_v, {}, {"waste": "waste AND NOT road AND NOT building AND NOT green", "solar": "solar AND near"})
CTES["frame_4"] = (clean(_v, waste=5, solar=3), ["f3_drawn"])
kept("f4", "frame_4", ["waste", "solar"], f"""(mask = 'waste' AND area BETWEEN {2000 * _s} AND {50000 * _s} AND extent >= 0.15)
    OR (mask = 'solar' AND area BETWEEN {80 * _s} AND {4000 * _s} AND aspect <= 5.0 AND extent >= 0.40)""")
CTES["frame_last"] = ("SELECT * REPLACE (green AND (count(*) FILTER (green) OVER (PARTITION BY image_id)) > 0.01 * w * h AS green) FROM f4_drawn", ["f4_drawn"])
filled("f5", "SELECT * FROM frame_last", {"green": "green"}, ["frame_last"])
CTES["frame_regions"] = (" UNION ALL ".join(f"SELECT image_id, mask FROM f{k}_kept" for k in (1, 2, 3, 4)) + f" UNION ALL SELECT image_id, mask FROM f5_stats WHERE area >= {K.MIN_FRAME_AREA['Trees & Green Cover'] * _s}", ["f1_kept", "f2_kept", "f3_kept", "f4_kept", "f5_stats"])
MASKS = {"building": "Properties & Buildings", "green": "Trees & Green Cover", "parks": "Parks & Open Spaces", "water": "Water Bodies", "road": "Roads & Footpaths",
         "drain": "Drains & Sewage", "vehicle": "Vehicles & Parking", "waste": "Waste Dumps", "solar": "Solar Panels"}
_areas = " UNION ALL ".join(f"SELECT image_id, '{m}' AS mask, '{c}' AS category, CAST(count(*) FILTER ({m}) AS DOUBLE) AS area_px FROM frame_last GROUP BY image_id" for m, c in MASKS.items())
_rgb = {r[0]: r[3] for r in K.CATEGORIES}


def blend(i: int, c: str) -> str:
    cases = " ".join(f"WHEN {m} THEN {_rgb[MASKS[m]][i]}" for m in reversed(list(MASKS)))
    return f"CAST(round_even({c} * 0.45 + CASE {cases} ELSE {c} END * 0.55, 0) AS INT) AS {c}"


SQL = {
    "components": q("SELECT image_id, mask, lab, CAST(sum(x1 // 64 - x0 // 64 + 1) AS BIGINT) AS pieces, CAST(sum(x1 - x0 + 1) AS BIGINT) AS n FROM gb_lab GROUP BY ALL", "gb_lab"),
    "fill_holes": q(" UNION ALL ".join(f"SELECT image_id, '{m}' AS mask, y, xb, bits FROM ({words(f'''SELECT p.image_id, p.y, p.x, s.x IS NOT NULL AS set_ FROM px p LEFT JOIN br_solid s ON s.image_id = p.image_id AND s.y = p.y AND s.x = p.x AND s.mask = '{m}' ''', bits='set_')})" for m in ("bright", "road")), "px", "br_solid"),
    "region_stats": q("SELECT image_id, mask, comp_id, n, area, min_x, min_y, max_x, max_y, cx, cy, bw, bh FROM br_stats", "br_stats"),
    "region_area": q("SELECT image_id, mask, comp_id, n AS pixels, area AS outline_area FROM br_stats", "br_stats"),
    "region_outline": outline("br"),
    "edge_map": q(without_zero(words("SELECT * FROM edges", bits="edges")), "edges"),
    "shadow_regions": q(f"SELECT image_id, comp_id, n, area, min_x, min_y, max_x, max_y, cx, cy, bw, bh FROM dk_stats WHERE area >= {SHADOW_AREA}", "dk_stats"),
    "frame_observations": q(f"""SELECT a.image_id, a.category, count(r.mask) AS cnt, a.area_px FROM ({_areas}) a LEFT JOIN frame_regions r ON r.image_id = a.image_id AND r.mask = a.mask
        WHERE a.area_px > 0 GROUP BY a.image_id, a.category, a.area_px
        UNION ALL SELECT image_id, NULL, 0, 0.0 FROM ({_areas}) GROUP BY image_id HAVING max(area_px) = 0""", "frame_last", "frame_regions"),
    "class_map_blend": q(f"""SELECT image_id, y, {', '.join(f'CAST(sum({c}) AS BIGINT) AS sum_{c}, CAST(sum({c} * x) AS BIGINT) AS moment_{c}' for c in 'rgb')} FROM (
        SELECT m.image_id, m.y, m.x, {', '.join(blend(i, c) for i, c in enumerate('rgb'))} FROM map_last m JOIN px p ON p.image_id = m.image_id AND p.y = m.y AND p.x = m.x) GROUP BY image_id, y""", "map_last", "px"),
}
SQL |= {f"mask_map_{m}": q(words("SELECT * FROM map_last", bits=m), "map_last") for m in MASKS if m not in ("green", "water")}
SQL |= {f"mask_video_{m}": q(words("SELECT * FROM frame_last", bits=m), "frame_last") for m in MASKS if m != "green"}

# asset records of blocks and of map regions
_text = lambda c: f"CAST(CAST(round_even({c} * 1000, 0) AS BIGINT) AS VARCHAR)"
_ring = "array_to_string([" + ", ".join(f"{_text(x)} || ' ' || {_text(y)}" for x, y in (("x_min", "y_min"), ("x_max", "y_min"), ("x_max", "y_max"), ("x_min", "y_max"))) + "], ';')"
_norm = lambda v, size: f"least(greatest({v} / {size} * 100.0, 0.0), 100.0)"
_still = "'Monitored' AS condition_status, 0.0 AS shadow_length_pixels, 0.0 AS shadow_length_meters, 0.0 AS estimated_height_meters"
SQL["block_assets"] = q(f"""SELECT image_id, CAST(n1 AS INT) AS asset_idx, 'auto_block_' || CAST(n1 - 1 AS VARCHAR) AS unique_id, category, '{K.TEXT_BLOCK_SUBCATEGORY}' || string_split(category, ' ')[1] AS subcategory,
        least(85.0 + n * 2, 99.0) AS confidence_percent, n AS estimated_count, round_even(area_px, 2) AS estimated_area_sq_m, round_even((x1 - x0 + 1) * cw, 2) AS length, round_even((y1 - y0 + 1) * ch, 2) AS width,
        round_even(area_px / greatest(CAST(w AS DOUBLE) * h, 1.0) * 100.0, 4) AS estimated_coverage_percent, {_still}, 'Low' AS maintenance_priority, (x_min + x_max) / 2.0 AS center_x, (y_min + y_max) / 2.0 AS center_y,
        x_min, y_min, x_max, y_max, {_ring} AS polygon, '{K.TEXT_BLOCK_DESCRIPTION}' AS visual_description, '{K.TEXT_BLOCK_BASIS}' AS estimation_basis FROM (
        SELECT *, n * cw * ch AS area_px, {_norm('x0', 'gw')} AS x_min, {_norm('(x1 + 1)', 'gw')} AS x_max, {_norm('y0', 'gh')} AS y_min, {_norm('(y1 + 1)', 'gh')} AS y_max,
          row_number() OVER (PARTITION BY image_id ORDER BY lab) AS n1 FROM (
        SELECT b.*, i.w, i.h, i.w / b.gw AS cw, i.h / b.gh AS ch FROM (
          SELECT image_id, w AS gw, h AS gh, mask AS category, lab, CAST(sum(x1 - x0 + 1) AS BIGINT) AS n, min(x0) AS x0, max(x1) AS x1, min(y) AS y0, max(y) AS y1 FROM blk_lab GROUP BY image_id, w, h, mask, lab) b
        JOIN images i ON i.image_id = b.image_id))""", "blk_lab", "images")
filled("ma", "SELECT * FROM map_last", {m: m for m in MASKS}, ["map_last"])
outline("ma")
_key = {m: next(r[5] for r in K.CATEGORIES if r[0] == c) for m, c in MASKS.items()}
_ord = {m: 1 + [r[0] for r in K.CATEGORIES].index(c) for m, c in MASKS.items()}
_pick = lambda values: "CASE mask " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in values.items()) + " END"
_floor = {m: K.MIN_REGION_AREA.get(k, K.MIN_REGION_AREA_OTHER) * MAP_SCALE for m, k in _key.items()}
CTES["ma_rings"] = (f"""SELECT c.image_id, c.mask, c.lab, count(*) AS points, string_agg({_text(f"round_even({_norm('c.x', 's.w')}, 4)")} || ' ' || {_text(f"round_even({_norm('c.y', 's.h')}, 4)")}, ';' ORDER BY c.step) AS ring
        FROM ma_corners c JOIN ma_stats s ON s.image_id = c.image_id AND s.mask = c.mask AND s.comp_id = c.lab GROUP BY c.image_id, c.mask, c.lab""", ["ma_corners", "ma_stats"])
SQL["map_assets"] = q(f"""SELECT image_id, asset_idx, 'asset_map_' || CAST(asset_idx AS VARCHAR) AS unique_id, category, subcategory, round_even(least(99.0, greatest(45.0, 60.0 + cov * 4.0)), 2) AS confidence_percent,
        CAST(1 AS BIGINT) AS estimated_count, round_even(area, 2) AS estimated_area_sq_m, round_even(CAST(bw AS DOUBLE), 2) AS length, round_even(CAST(bh AS DOUBLE), 2) AS width, round_even(least(cov, 100.0), 4) AS estimated_coverage_percent,
        {_still}, 'Medium' AS maintenance_priority, round_even((px0 + px9) / 2.0, 4) AS center_x, round_even((py0 + py9) / 2.0, 4) AS center_y, x_min, y_min, x_max, y_max,
        CASE WHEN points >= 3 THEN ring ELSE {_ring} END AS polygon, subcategory || '{K.TEXT_MAP_DESCRIPTION}' AS visual_description, '{K.TEXT_MAP_BASIS}' AS estimation_basis FROM (
        SELECT *, round_even(px0, 4) AS x_min, round_even(py0, 4) AS y_min, round_even(px9, 4) AS x_max, round_even(py9, 4) AS y_max FROM (
        SELECT s.*, r.points, r.ring, {_pick({m: f"'{c}'" for m, c in MASKS.items()}).replace('mask', 's.mask')} AS category, {_pick({m: f"'{k}'" for m, k in _key.items()}).replace('mask', 's.mask')} AS subcategory,
          area / greatest(CAST(w AS DOUBLE) * h, 1.0) * 100.0 AS cov, {_norm('min_x', 'w')} AS px0, {_norm('min_y', 'h')} AS py0, {_norm('(max_x + 1)', 'w')} AS px9, {_norm('(max_y + 1)', 'h')} AS py9,
          CAST(row_number() OVER (PARTITION BY s.image_id ORDER BY {_pick(_ord).replace('mask', 's.mask')}, floor(min_y / 256), min_y, min_x, comp_id) AS INT) AS asset_idx
        FROM ma_stats s JOIN ma_rings r ON r.image_id = s.image_id AND r.mask = s.mask AND r.lab = s.comp_id WHERE area >= {_pick(_floor).replace('mask', 's.mask')}))""", "ma_stats", "ma_rings")
