"""Block grid of an image: shrink, classify, join equal neighbours."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terratally import fixed_values as K
from terratally.functions import clean as C, geometry as G
from terratally.functions.color import classify_rgb
from terratally.operators import raster as R, regions as Q
from terratally.operators.graylevel import lanes_of
from terratally.operators.ranking import numbered

CLASSES = {
    "c_building": "Properties & Buildings", "c_tree": "Trees & Green Cover", "c_park": "Parks & Open Spaces",
    "c_water": "Water Bodies", "c_road": "Roads & Footpaths"}


#: Image rows that are dealt out together.
BAND_ROWS = 512

#: Cells of all distinct sizes up to which their table is broadcast (8 bytes each).
BROADCAST_CELLS = 1_000_000


def _centre(cell, n, m):
    return (cell + 0.5) * (n / m)


def _weight(p, cell, n, m):
    return F.greatest(F.lit(0.0), 1.0 - F.abs((p - _centre(cell, n, m) + 0.5) / F.greatest(n / m, F.lit(1.0))))


def cell_totals(n, m):
    """Summed weights of all positions, as an array over the ``m`` cells that ``n`` positions shrink (or grow) to."""
    wide = F.greatest(n / m, F.lit(1.0))

    def total(cell):
        first = F.greatest(F.lit(0), (_centre(cell, n, m) - wide + 0.5).cast("int"))
        last = F.least(n, (_centre(cell, n, m) + wide + 0.5).cast("int")) - 1
        return F.aggregate(F.sequence(first, last), F.lit(0.0), lambda s, p: s + _weight(p, cell, n, m))

    return F.transform(F.sequence(F.lit(0), m - 1), total)


def _cells(pos, n, m):
    """First and last cell within one cell width of a position, whose weights are not zero."""
    scale = n / m
    wide = F.greatest(scale, F.lit(1.0))
    low = F.floor((pos + 0.5 - wide) / scale - 0.5).cast("int") + 1
    high = F.ceil((pos + 0.5 + wide) / scale - 0.5).cast("int") - 1
    return F.greatest(F.lit(0), low), F.least(m - 1, high)


def size_table(sizes: DataFrame, gx: int) -> DataFrame:
    """Distinct sizes (w, h) with their grid and the totals of both axes. Broadcast while it is small."""
    gh = F.greatest(F.lit(1), F.floor(F.lit(gx) * (F.col("h") / F.col("w"))).cast("int"))
    sizes = sizes.select("w", "h").distinct().withColumns({"gw": F.lit(gx), "gh": gh})
    cells = sizes.agg(F.coalesce(F.sum(F.col("gw") + F.col("gh")), F.lit(0))).first()[0]
    out = sizes.withColumns({"tx": cell_totals(F.col("w"), F.col("gw")), "ty": cell_totals(F.col("h"), F.col("gh"))})
    return F.broadcast(out) if cells <= BROADCAST_CELLS else out


def _shrink(df: DataFrame, size: str, target: str, totals: str, pos: str, keys: list[str]) -> DataFrame:
    """Triangle filter in 22-bit fixed point along one axis.

    A cell's weights are those of the positions within one cell width of its centre, divided by their sum. The cells near
    a position follow from the sizes and the sums from ``totals``, so a pixel costs the same however wide its image is,
    and all of it is plain columns.
    """
    n, m, cell = F.col(size), F.col(target), F.col("_cell")
    spread = df.withColumn("_cell", F.explode(F.sequence(*_cells(F.col(pos), n, m))))
    spread = spread.withColumn("_k", F.floor(_weight(F.col(pos), cell, n, m) / F.get(totals, cell) * 4194304.0 + 0.5).cast("bigint")).where("_k > 0")
    tone = lambda c: F.least(F.greatest(F.shiftright(F.sum(F.col(c) * F.col("_k")) + 2097152, 22), F.lit(0)), F.lit(255)).cast("int").alias(c)
    return spread.groupBy(*keys, "_cell").agg(tone("r"), tone("g"), tone("b")).withColumnRenamed("_cell", pos)


def colour_words(px: DataFrame) -> DataFrame:
    """Word rows with the colours of their 64 pixels, a byte each (``r0`` .. ``b7``), and the pixels that are there (``on``)."""
    lanes = {c + n[1:]: v for c in "rgb" for n, v in lanes_of(F.col(c)).items()}
    return R.pixel_words(px, {"on": F.lit(True)}, lanes)


def word_colours(words: DataFrame, *keys: str) -> DataFrame:
    """Word rows of ``colour_words`` back to pixel rows."""
    lanes = {c: F.array(*[f"{c}{j}" for j in range(8)]) for c in "rgb"}
    df = words.select(*keys, "xb", "on", *[v.alias(c) for c, v in lanes.items()], F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_i"))
    byte = lambda c: F.expr(f"CAST(shiftrightunsigned({c}[CAST(_i / 8 AS INT)], _i % 8 * 8) & 255 AS INT)").alias(c)
    return df.where("(shiftrightunsigned(`on`, _i) & 1L) = 1L").select(*keys, (F.col("xb") * 64 + F.col("_i")).alias("x"), *[byte(c) for c in "rgb"])


def grid_downsample(px: DataFrame, gx: int = K.GRID_COLUMNS, images: DataFrame | None = None) -> DataFrame:
    """Image to ``gx`` columns of cells with a triangle filter: across first, then down.

    Pixels move as words, dealt out by bands of image rows: the sums across need no further exchange, and those down are
    gathered per band before theirs. The filter's sums come from a table of the distinct sizes, taken from ``images`` (or
    else from the pixel rows, which carry the size of their image).
    """
    table = size_table(px if images is None else images, gx)
    keys = ["image_id", "w", "h"]
    words = colour_words(px).withColumn("_band", F.floor(F.col("y") / BAND_ROWS)).repartition("image_id", "_band")
    rows = word_colours(words, *keys, "_band", "y")
    across = _shrink(rows.join(table, ["w", "h"]), "w", "gw", "tx", "x", keys + ["_band", "y"])
    down = _shrink(across.join(table, ["w", "h"]), "h", "gh", "ty", "y", keys + ["x"])
    return down.join(table.select("w", "h", "gw", "gh"), ["w", "h"]).select(*keys, "gw", "gh", "x", "y", "r", "g", "b")


def grid_classes(px: DataFrame, gx: int = K.GRID_COLUMNS, images: DataFrame | None = None) -> DataFrame:
    g = grid_downsample(px, gx, images)
    return g.withColumn("category", classify_rgb(F.col("r"), F.col("g"), F.col("b")))


def block_assets(px: DataFrame, images: DataFrame, gx: int = K.GRID_COLUMNS, mpp: float = 1.0) -> DataFrame:
    """One asset per 4-connected block of equal class, numbered from 0 in reading order."""
    cells = grid_classes(px, gx, images).select(
        "image_id", F.col("gw").alias("w"), F.col("gh").alias("h"), "x", "y", "category")
    words = R.pixel_words(cells, {m: F.col("category") == c for m, c in CLASSES.items()})
    lab = Q.components(words, list(CLASSES), 4)
    comp = lab.groupBy("image_id", F.col("w").alias("gw"), F.col("h").alias("gh"), "mask", "lab").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        F.min("y").alias("y0"), F.max("y").alias("y1"))
    names = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    df = numbered(comp, ["image_id"], F.floor(F.col("lab") / (gx * 8)), ["lab"], "asset_idx")
    df = df.join(images.select("image_id", "w", "h"), "image_id").withColumn("category", names[F.col("mask")])
    pct = lambda v, size: F.least(F.greatest(v / F.col(size) * 100.0, F.lit(0.0)), F.lit(100.0))
    df = df.withColumns({
        "x_min": pct(F.col("x0"), "gw"), "x_max": pct(F.col("x1") + 1, "gw"), "y_min": pct(F.col("y0"), "gh"), "y_max": pct(F.col("y1") + 1, "gh"),
        "cw": F.col("w") / F.col("gw"), "ch": F.col("h") / F.col("gh")})
    df = df.withColumn("area_px", F.col("n") * F.col("cw") * F.col("ch"))
    corners = {n: F.col(n) for n in ("x_min", "y_min", "x_max", "y_max")}
    return df.select(
        "image_id", "asset_idx", F.concat(F.lit("auto_block_"), (F.col("asset_idx") - 1).cast("string")).alias("unique_id"), "category",
        F.concat(F.lit(K.TEXT_BLOCK_SUBCATEGORY), F.substring_index("category", " ", 1)).alias("subcategory"),
        C.block_confidence(F.col("n")).alias("confidence_percent"), F.col("n").cast("bigint").alias("estimated_count"),
        C.rounded(C.to_area_m2(F.col("area_px"), mpp), 2).alias("estimated_area_sq_m"),
        F.struct(C.rounded(C.to_length_m((F.col("x1") - F.col("x0") + 1) * F.col("cw"), mpp), 2).alias("length"),
                 C.rounded(C.to_length_m((F.col("y1") - F.col("y0") + 1) * F.col("ch"), mpp), 2).alias("width")).alias("estimated_dimensions_m"),
        C.rounded(F.col("area_px") / F.greatest((F.col("w").cast("double") * F.col("h")), F.lit(1.0)) * 100.0, 4).alias("estimated_coverage_percent"),
        F.lit("Monitored").alias("condition_status"), F.lit("Low").alias("maintenance_priority"),
        G.point((F.col("x_min") + F.col("x_max")) / 2.0, (F.col("y_min") + F.col("y_max")) / 2.0).alias("center_coordinates"),
        F.struct(*corners).alias("bounding_box"), G.ring_from_bbox(corners).alias("polygon_coordinates"),
        F.lit(K.TEXT_BLOCK_DESCRIPTION).alias("visual_description"),
        F.lit(K.TEXT_BLOCK_BASIS).alias("estimation_basis"),
        F.lit(0.0).alias("shadow_length_pixels"), F.lit(0.0).alias("shadow_length_meters"), F.lit(0.0).alias("estimated_height_meters"))
