"""Points, boxes and rings in 0..100 coordinates, and their map positions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terratally import fixed_values as K
from terratally.functions.clean import clamp, clamp_display, finite


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def repair_point(p: Column) -> Column:
    return point(clamp(p["x"]), clamp(p["y"]))


def box(x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    return F.struct(
        F.least(x_min, x_max).alias("x_min"),
        F.least(y_min, y_max).alias("y_min"),
        F.greatest(x_min, x_max).alias("x_max"),
        F.greatest(y_min, y_max).alias("y_max"),
    )


def repair_bbox(b: Column) -> Column:
    """Clamped and ordered box; a missing (null) maximum collapses onto the minimum."""
    x0, y0 = clamp(b["x_min"]), clamp(b["y_min"])
    x1 = F.when(b["x_max"].isNull(), x0).otherwise(clamp(b["x_max"]))
    y1 = F.when(b["y_max"].isNull(), y0).otherwise(clamp(b["y_max"]))
    return box(x0, y0, x1, y1)


def ring_from_bbox(b: Column) -> Column:
    """Four corners, clockwise from the top left."""
    return F.array(
        point(b["x_min"], b["y_min"]),
        point(b["x_max"], b["y_min"]),
        point(b["x_max"], b["y_max"]),
        point(b["x_min"], b["y_max"]),
    )


def repair_polygon(points: Column, bbox: Column) -> Column:
    kept = F.filter(points, lambda p: p.isNotNull())
    return F.when(F.size(kept) >= 3, F.transform(kept, repair_point)).otherwise(ring_from_bbox(bbox))


def asset_center(center: Column, bbox: Column) -> Column:
    """The given centre when both parts are finite, else the box midpoint."""
    ok = finite(center["x"]).isNotNull() & finite(center["y"]).isNotNull()
    return point(
        clamp_display(F.when(ok, center["x"]).otherwise((bbox["x_min"] + bbox["x_max"]) / 2)),
        clamp_display(F.when(ok, center["y"]).otherwise((bbox["y_min"] + bbox["y_max"]) / 2)),
    )


def center_line(polygon: Column, bbox: Column) -> Column:
    """Course of a road or drain: its outline, else the mid-line along the longer side."""
    w = F.abs(bbox["x_max"] - bbox["x_min"])
    h = F.abs(bbox["y_max"] - bbox["y_min"])
    x_mid = clamp_display((bbox["x_min"] + bbox["x_max"]) / 2)
    y_mid = clamp_display((bbox["y_min"] + bbox["y_max"]) / 2)
    flat = F.array(point(clamp_display(bbox["x_min"]), y_mid), point(clamp_display(bbox["x_max"]), y_mid))
    tall = F.array(point(x_mid, clamp_display(bbox["y_min"])), point(x_mid, clamp_display(bbox["y_max"])))
    return F.when(F.size(polygon) >= 2, polygon).otherwise(F.when(w >= h, flat).otherwise(tall))


def geo_project(p: Column, lat0=K.MAP_CENTER_LAT, lng0=K.MAP_CENTER_LNG, span=K.MAP_SPAN) -> Column:
    """0..100 point to [lat, lng] around a map centre; y grows southwards."""
    lat0, lng0, span = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lat0, lng0, span))
    return F.array(
        lat0 - ((p["y"] - 50.0) / 50.0) * span,
        lng0 + ((p["x"] - 50.0) / 50.0) * span,
    )


def with_pixel_box(df: DataFrame, bbox: Column, w: Column, h: Column) -> DataFrame:
    """Add x1, y1, x2, y2: the whole-pixel box, all null when it has no width or height.

    Boxes within +-100 are percentages; corners are ordered, clamped to the raster and
    rounded half to even. Steps are separate columns so that no expression is repeated
    inside another.
    """
    keep = df.columns
    df = df.withColumns({"_" + k: F.coalesce(bbox[k], F.lit(0.0)) for k in ("x_min", "y_min", "x_max", "y_max")}
                        | {"_given": bbox.isNotNull(), "_w": w.cast("double"), "_h": h.cast("double")})
    pct = F.greatest(*[F.abs(F.col("_" + k)) for k in ("x_min", "y_min", "x_max", "y_max")]) <= 100.0
    df = df.withColumns({"_sx": F.when(pct, F.col("_w")), "_sy": F.when(pct, F.col("_h"))})

    def px(name: str, size: str) -> Column:
        v = F.col("_" + name)
        return F.when(F.col(size).isNotNull(), (v / 100.0) * F.col(size)).otherwise(v)

    df = df.withColumns({"_xa": px("x_min", "_sx"), "_xb": px("x_max", "_sx"), "_ya": px("y_min", "_sy"), "_yb": px("y_max", "_sy")})

    def snap(pick, a: str, b: str, size: str) -> Column:
        return F.rint(F.greatest(F.lit(0.0), F.least(F.col(size) - 1.0, pick(a, b)))).cast("int")

    df = df.withColumns({
        "x1": snap(F.least, "_xa", "_xb", "_w"), "y1": snap(F.least, "_ya", "_yb", "_h"),
        "x2": snap(F.greatest, "_xa", "_xb", "_w"), "y2": snap(F.greatest, "_ya", "_yb", "_h")})
    # A generated column keeps filters on the box from being rewritten into all of the above.
    whole = F.filter(F.array(F.struct("x1", "y1", "x2", "y2")),
                     lambda b: F.col("_given") & (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))
    return df.select(*keep, whole.alias("_box")).select(*keep, F.inline_outer("_box"))


def list_to_bbox(a: Column) -> Column:
    """[x1, y1, x2, y2] as a box struct; any other length is null."""
    b = F.struct(*[F.get(a, i).cast("double").alias(n) for i, n in enumerate(("x_min", "y_min", "x_max", "y_max"))])
    return F.when(F.size(a) == 4, b)


def ray_exit(b: Column, tx: Column, ty: Column) -> Column:
    """Where the ray from the box centre towards (tx, ty) leaves the box; the centre if it never does."""
    cx, cy = (b["x1"] + b["x2"]) / 2.0, (b["y1"] + b["y2"]) / 2.0
    dx, dy = tx - cx, ty - cy
    x_cuts = F.when(F.abs(dx) > 1e-6, F.array((b["x1"] - cx) / dx, (b["x2"] - cx) / dx)).otherwise(
        F.array().cast("array<double>"))
    y_cuts = F.when(F.abs(dy) > 1e-6, F.array((b["y1"] - cy) / dy, (b["y2"] - cy) / dy)).otherwise(
        F.array().cast("array<double>"))

    def inside(t: Column) -> Column:
        px, py = cx + t * dx, cy + t * dy
        return (
            (t > 0)
            & px.between(b["x1"] - 1e-3, b["x2"] + 1e-3)
            & py.between(b["y1"] - 1e-3, b["y2"] + 1e-3)
        )

    t = F.coalesce(F.array_min(F.filter(F.concat(x_cuts, y_cuts), inside)), F.lit(0.0))
    return point(cx + t * dx, cy + t * dy)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def height_from_shadow(meters: Column, angle: Column | float = K.SOLAR_ELEVATION) -> Column:
    a = angle if isinstance(angle, Column) else F.lit(float(angle))
    a = F.greatest(F.lit(1e-3), F.least(a, F.lit(89.9)))
    return F.greatest(meters, F.lit(0.0)) * F.tan(F.radians(a))
