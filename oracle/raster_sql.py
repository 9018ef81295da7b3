"""Check SQL for the pixel queries."""
from __future__ import annotations

import math

from oracle.relations import CTES, q
from terratally import fixed_values as K
from terratally.plans.raster_queries import SHADOW_BLOCK

TOP = "CAST('-9223372036854775808' AS BIGINT)"


def word(m: str) -> str:
    return f"CAST(sum(CASE WHEN NOT ({m}) THEN 0 WHEN x % 64 = 63 THEN {TOP} ELSE CAST(1 AS BIGINT) << CAST(x % 64 AS INT) END) AS BIGINT)"


CTES["hsv"] = ("""SELECT * EXCLUDE (h0), CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END AS hue FROM (
    SELECT *, CAST(floor((d * CASE WHEN val > 0 THEN round_even(1044480.0 / val, 0) ELSE 0 END + 2048) / 4096) AS INT) AS sat,
      CAST(floor((CASE WHEN val = r THEN g - b WHEN val = g THEN b - r + 2 * d ELSE r - g + 4 * d END * CASE WHEN d > 0 THEN round_even(122880.0 / d, 0) ELSE 0 END + 2048) / 4096) AS INT) AS h0,
      (r * 9798 + g * 19235 + b * 3735 + 16384) // 32768 AS gray
    FROM (SELECT *, greatest(r, g, b) AS val, greatest(r, g, b) - least(r, g, b) AS d FROM px))""", ["px"])


def band(mode: str, name: str) -> str:
    kind, lo, hi = K.BANDS[mode][name]
    if kind == "gray":
        return f"gray BETWEEN {lo} AND {hi}"
    return " AND ".join(f"{c} BETWEEN {a} AND {z}" for c, a, z in zip(("hue", "sat", "val"), lo, hi))


NAMES = ["green", "water", "road", "bright", "dark", "waste", "solar"]
CTES["bands"] = ("SELECT image_id, w, h, y, x, " + ", ".join(f"{band('map', n)} AS {n}" for n in NAMES) + " FROM hsv", ["hsv"])
CTES["vbands"] = ("SELECT image_id, w, h, y, x, " + ", ".join(f"{band('video', n)} AS {n}" for n in ("green", "water")) + " FROM hsv", ["hsv"])


def box(src: str, out: dict[str, tuple[str, str, int]]) -> str:
    """Box filters: {name: (column, min | max, k)}; other columns are kept."""
    def one(order: str, part: str, k: int) -> str:
        return f"OVER (PARTITION BY image_id, {part} ORDER BY {order} ROWS BETWEEN {k // 2} PRECEDING AND {k - 1 - k // 2} FOLLOWING)"
    across = ", ".join(f"{f}({c}) {one('x', 'y', k)} AS h_{n}" for n, (c, f, k) in out.items())
    down = ", ".join(f"{f}(h_{n}) {one('y', 'x', k)} AS {n}" for n, (c, f, k) in out.items())
    drop = ", ".join(f"h_{n}" for n in out)
    over = [n for n in out]
    return f"SELECT * EXCLUDE ({drop}{''.join(', ' + n for n in over if n in EXISTING)}), {down} FROM (SELECT *, {across} FROM ({src}))"


EXISTING: set = set()


def cleaned(src: str, c: str, k: int) -> str:
    """Opening then closing of column c, in place."""
    EXISTING.add(c)
    for f in ("min", "max", "max", "min"):
        src = box(src, {c: (c, f, k)})
    EXISTING.discard(c)
    return src


def words(src: str, **cols: str) -> str:
    inner = ", ".join(f"{word(e)} AS {n}" for n, e in cols.items())
    return f"SELECT image_id, y, CAST(x // 64 AS INT) AS xb, {inner} FROM ({src}) GROUP BY image_id, y, x // 64"


def weights(size: int) -> list[int]:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    g = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    w = [round(v / sum(g) * 65536) for v in g]
    w[size // 2] += 65536 - sum(w)
    return w


def conv(src: str, axis: str, part: str, w: list[int], mirror: bool, value: str = "v") -> str:
    """Weighted sums along an axis over lists of one line each."""
    r, n = len(w) // 2, len(w)
    left = ", ".join(f"l[{r + 1 - i}]" if mirror else "l[1]" for i in range(r))
    right = ", ".join(f"l[len(l) - {i + 1}]" if mirror else "l[len(l)]" for i in range(r))
    lst = "[" + ", ".join(f"{v}::DOUBLE" for v in w) + "]"
    return f"""SELECT image_id, {part}, CAST(unnest(range(len(l))) AS INT) AS {axis}, CAST(unnest(list_transform(range(1, len(l) + 1),
        lambda i: list_dot_product(list_concat([{left}], l, [{right}])[i:i + {n - 1}], {lst}))) AS BIGINT) AS v
        FROM (SELECT image_id, {part}, list(CAST({value} AS DOUBLE) ORDER BY {axis}) AS l FROM ({src}) GROUP BY image_id, {part})"""


_blur = conv(conv("SELECT image_id, y, x, gray AS v FROM hsv", "x", "y", [1, 4, 6, 4, 1], True), "y", "x", [1, 4, 6, 4, 1], True)
CTES["blurred"] = (f"SELECT image_id, y, x, (v + 128) // 256 AS v FROM ({_blur})", ["hsv"])
_w = weights(SHADOW_BLOCK)
CTES["local_mean"] = (f"SELECT image_id, y, x, (v + 2147483648) // 4294967296 AS mean FROM ({conv(conv('SELECT * FROM blurred', 'x', 'y', _w, False), 'y', 'x', _w, False)})", ["blurred"])


def axis(n: str, m: str) -> str:
    return f"""SELECT n, m, cell, pos, CAST(floor(t / sum(t) OVER (PARTITION BY n, m, cell) * 4194304.0 + 0.5) AS BIGINT) AS k FROM (
        SELECT n, m, cell, pos, greatest(0.0, 1.0 - abs((pos - c + 0.5) / f)) AS t FROM (
        SELECT n, m, cell, c, f, unnest(range(CAST(greatest(0, trunc(c - f + 0.5)) AS BIGINT), CAST(least(n, trunc(c + f + 0.5)) AS BIGINT))) AS pos FROM (
        SELECT n, m, cell, (cell + 0.5) * (n / m) AS c, greatest(n / m, 1.0) AS f FROM (
        SELECT DISTINCT {n} AS n, {m} AS m, unnest(range({m})) AS cell FROM (SELECT *, 35 AS gw, greatest(1, CAST(floor(35 * (h / w)) AS INT)) AS gh FROM images)))))"""


def tone(c: str) -> str:
    return f"CAST(greatest(0, least(255, (sum({c} * k) + 2097152) // 4194304)) AS INT) AS {c}"


CTES["ax"] = (axis("w", "gw"), ["images"])
CTES["ay"] = (axis("h", "gh"), ["images"])
CTES["regs"] = ("""SELECT image_id, box_idx AS comp_id, ['building', 'green', 'parks', 'water', 'road', 'drain'][cls_id + 1] AS mask, CAST(x2 - x1 AS INT) AS bw, CAST(y2 - y1 AS INT) AS bh,
    floor((x2 - x1) * conf) * (y2 - y1) / 2.0 AS area FROM boxes""", ["boxes"])
CLASS = """CASE WHEN g / (r + g + b + 1) > 0.36 AND g > r + 10 AND g > b + 10 THEN 'Trees & Green Cover' WHEN b / (r + g + b + 1) > 0.36 AND b > r + 10 AND b > g + 10 THEN 'Water Bodies'
    WHEN greatest(r, g, b) < 75 THEN 'Roads & Footpaths' WHEN least(r, g, b) > 165 THEN 'Properties & Buildings'
    WHEN abs(r - g) < 25 AND abs(g - b) < 25 AND r <= 100 THEN 'Roads & Footpaths' WHEN abs(r - g) < 25 AND abs(g - b) < 25 THEN 'Properties & Buildings'
    WHEN r > g AND g > b AND r / (r + g + b + 1) <= 0.4 THEN 'Parks & Open Spaces' ELSE 'Properties & Buildings' END"""
_vgreen = cleaned("SELECT * FROM vbands", "green", 5)
_mgreen = cleaned("SELECT * FROM bands", "green", 5)

SQL = {
    "rgb_to_hsv": q("SELECT image_id, y, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS sum_{c}, CAST(sum({c} * x) AS BIGINT) AS moment_{c}" for c in ("hue", "sat", "val", "gray")) + " FROM hsv GROUP BY image_id, y", "hsv"),
    "classify_rgb": q(f"SELECT image_id, y, {CLASS} AS category, count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x FROM px GROUP BY ALL", "px"),
    "band_mask": q(words("SELECT * FROM bands", **{n: n for n in NAMES}), "bands"),
    "mask_algebra": q(words("SELECT * FROM bands", either="green OR water", only_bright="bright AND NOT green", inner="road AND bright AND NOT dark"), "bands"),
    "mask_coverage": q(" UNION ALL ".join(f"""SELECT image_id, '{n}' AS mask, count(*) FILTER ({n}) AS pixels, round_even(CAST(count(*) FILTER ({n}) AS DOUBLE), 2) AS area_sq_m,
        round_even(count(*) FILTER ({n}) / CAST(count(*) AS DOUBLE) * 100.0, 4) AS coverage_percent FROM bands GROUP BY image_id""" for n in NAMES), "bands"),
    "erode": q(words(box("SELECT * FROM bands", {"odd": ("green", "min", 5), "even": ("bright", "min", 2)}), odd="odd", even="even"), "bands"),
    "dilate": q(words(box("SELECT * FROM bands", {"odd": ("green", "max", 9), "even": ("bright", "max", 2)}), odd="odd", even="even"), "bands"),
    "open_close": q(words(cleaned(_mgreen, "bright", 3), green="green", bright="bright"), "bands"),
    "local_mean_threshold": q(words("SELECT b.image_id, b.y, b.x, b.v - m.mean <= -7 AS dark FROM blurred b JOIN local_mean m ON m.image_id = b.image_id AND m.y = b.y AND m.x = b.x", dark="dark"), "blurred", "local_mean"),
    "union_masks": q(" UNION ALL ".join(f"SELECT image_id, '{n}' AS mask, y, xb, bits FROM ({words('SELECT * FROM bands', bits=n)}) WHERE bits <> 0" for n in NAMES), "bands"),
    "grid_downsample": q(f"""SELECT image_id, CAST(a.cell AS INT) AS y, x, {tone('r')}, {tone('g')}, {tone('b')} FROM (
        SELECT image_id, h, y, CAST(a.cell AS INT) AS x, {tone('r')}, {tone('g')}, {tone('b')} FROM px JOIN ax a ON a.n = w AND a.pos = x GROUP BY image_id, h, y, a.cell) p
        JOIN ay a ON a.n = h AND a.pos = y GROUP BY image_id, a.cell, x""", "px", "ax", "ay"),
    "region_filter": q("""SELECT image_id, comp_id, mask, area FROM regs WHERE area BETWEEN 2000 AND 9000 AND greatest(bw, bh) / least(bw, bh) BETWEEN 1.1 AND 1.8 AND area / (bw * bh) >= 0.2""", "regs"),
    "region_filter_map": q("""SELECT image_id, comp_id, mask, area FROM regs WHERE (mask = 'building' AND area BETWEEN 80 AND 20000 AND bw / bh > 0.25 AND bw / bh < 4 AND area / (bw * bh) > 0.25) OR (mask = 'parks' AND area > 5000)
        UNION ALL SELECT image_id, comp_id, 'vehicle', area / 100 FROM regs WHERE area / 100 BETWEEN 8 AND 120 AND bw / bh > 0.4 AND bw / bh < 3.5""", "regs"),
    "min_area_by_class": q("""SELECT image_id, comp_id, k AS mask_key FROM (SELECT *, CASE mask WHEN 'building' THEN 'properties_buildings' WHEN 'green' THEN 'trees_green_cover' WHEN 'parks' THEN 'parks_open_spaces'
        WHEN 'water' THEN 'water_bodies' WHEN 'drain' THEN 'drains_sewage' ELSE 'other' END AS k FROM regs) WHERE area / 20 >= CASE k WHEN 'properties_buildings' THEN 80 WHEN 'trees_green_cover' THEN 120
        WHEN 'parks_open_spaces' THEN 800 WHEN 'water_bodies' THEN 120 WHEN 'drains_sewage' THEN 80 ELSE 50 END""", "regs"),
    "stage_gates": q("""SELECT image_id, comp_id, mask FROM (SELECT *, count(*) OVER p AS c, sum(bw * bh) OVER p / (512 * 384) * 100.0 AS pct FROM regs WINDOW p AS (PARTITION BY image_id, mask))
        WHERE (mask = 'building' AND c >= 2 AND pct > 4) OR (mask = 'parks' AND c >= 2) OR mask = 'green'""", "regs"),
    "downscale_correction": q("""SELECT image_id, box_idx, w, h, round(s, 9) AS scale, CAST(greatest(1, round_even(w * s, 0)) AS INT) AS new_w, CAST(greatest(1, round_even(h * s, 0)) AS INT) AS new_h, round(1.0 / (s * s), 9) AS area_factor
        FROM (SELECT *, CASE WHEN greatest(w, h) <= 960 THEN 1.0 ELSE 960.0 / greatest(w, h) END AS s FROM (SELECT image_id, box_idx, CAST(x2 * 4 AS INT) AS w, CAST(y2 * 4 AS INT) AS h FROM boxes))""", "boxes"),
    "mask_map_green": q(words(_mgreen, bits="green"), "bands"),
    "mask_map_water": q(words(cleaned(f"SELECT * REPLACE (water AND NOT green AS water) FROM ({_mgreen})", "water", 5), bits="water"), "bands"),
    "mask_video_green": q(words(f"SELECT *, green AND (count(*) FILTER (green) OVER (PARTITION BY image_id)) > 0.01 * w * h AS gated FROM ({_vgreen})", bits="gated"), "vbands"),
}
