"""The nine category masks of an image, for map products and for video frames."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from terratally import fixed_values as K
from terratally.functions import clean as C, geometry as G
from terratally.operators import outline as O, raster as R, regions as Q
from terratally.operators.assets import category_ord
from terratally.operators.graylevel import LANES, edge_words, gray_words
from terratally.operators.ranking import numbered
from terratally.session import by_key, cut_lineage

# mask column -> category
MAP_MASKS = {
    "building": "Properties & Buildings", "green": "Trees & Green Cover", "parks": "Parks & Open Spaces",
    "water": "Water Bodies", "road": "Roads & Footpaths", "drain": "Drains & Sewage",
    "vehicle": "Vehicles & Parking", "waste": "Waste Dumps", "solar": "Solar Panels",
}


def _named(col, mapping: dict):
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[col]


def region_filter_map(regions: DataFrame, mask: str, scale: float = 1.0) -> DataFrame:
    """Map-product filters (strict bounds, aspect is width over height); areas times ``scale``."""
    aspect = F.col("bw") / F.greatest(F.col("bh"), F.lit(1)).cast("double")
    extent = F.col("area") / F.greatest(F.col("bw") * F.col("bh"), F.lit(1)).cast("double")
    area = F.col("area")
    rule = {
        "building": area.between(80 * scale, 20000 * scale) & (aspect > 0.25) & (aspect < 4.0) & (extent > 0.25),
        "parks": area > 5000 * scale,
        "vehicle": area.between(8 * scale, 120 * scale) & (aspect > 0.4) & (aspect < 3.5),
    }[mask]
    return regions.where((F.col("mask") == mask) & rule)


# mask -> the masks that enter it, and the colour bands it starts from
MAP_FROM = {
    "building": (["green", "water", "road"], ["bright"]), "green": ([], ["green"]), "parks": (["green"], []), "water": (["green"], ["water"]),
    "road": (["green", "water"], ["road"]), "drain": (["green", "water", "road"], ["dark"]), "vehicle": (["road"], ["bright"]),
    "waste": (["road", "building"], ["waste"]), "solar": (["building"], ["solar"]),
}
VIDEO_FROM = MAP_FROM | {
    "road": (["green", "water"], ["road", "lowsat"]), "building": (["green", "water", "road"], ["bright", "roof"]),
    "vehicle": (["green", "road"], ["bright"]), "waste": (["green", "road", "building"], ["waste"]),
}


def needed(wanted: Iterable[str], sources: dict) -> tuple[set, list[str]]:
    """The masks that the wanted ones are made from, themselves included, and the colour bands of all of them."""
    need, todo = set(), list(wanted)
    while todo:
        m = todo.pop()
        if m not in need:
            need.add(m)
            todo += sources[m][0]
    return need, list(dict.fromkeys(b for m in sources if m in need for b in sources[m][1]))


def map_masks(px: DataFrame, scale: float = 1.0, wanted: Iterable[str] = tuple(MAP_MASKS)) -> DataFrame:
    """Word table with the wanted of the nine map masks.

    The pixels are read once, for the colour bands and the gray values. Two chains of filters, each behind one exchange,
    with the region filters between them. Masks that no wanted one is made from are not made.
    """
    need, raw = needed(wanted, MAP_FROM)
    has = lambda *names: [m for m in names if m in need]
    ops = lambda **by_mask: [op for m, op in by_mask.items() if m in need]
    texts = lambda **by_mask: {m: text for m, text in by_mask.items() if m in need}
    bands = {n: c for n, c in R.bands_of("map").items() if n in raw}
    if has("road"):
        words = cut_lineage(gray_words(px, bands))
        edges = edge_words(words, 60, 160).select(*R.KEY, F.col("bits").alias("edges"))
        words = words.drop(*LANES).join(by_key(edges), R.KEY, "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("bigint")))
        raw = [*raw, "edges"]
    else:
        words = R.pixel_words(px, bands)
    df = R.banded(words, [b for b in raw if b not in ("waste", "solar")], 32)
    df = R.morph(df, [R.erode("green", 5, "green"), *ops(road=R.dilate("edges", 3, "edges"))])
    df = R.morph(df, [("green", "green", "dilate", -4, 4)])
    df = R.morph(df, [R.erode("green", 5, "green")])
    df = R.combine(df, **texts(water="{water} & ~{green}"))
    df = R.morph(df, ops(water=R.erode("water", 5, "water"), parks=R.dilate("green", 9, "parks")))
    df = R.morph(df, ops(water=("water", "water", "dilate", -4, 4), parks=R.erode("parks", 9, "parks")))
    df = R.morph(df, ops(water=R.erode("water", 5, "water")))
    if has("road"):
        df = R.combine(df, road="({road} | {edges}) & ~{green} & ~{water}")
        df = R.clean(df, {"road": 3})
    df = R.combine(df, **texts(building="{bright} & ~{green} & ~{water} & ~{road}"))
    if has("drain", "vehicle"):
        df = R.morph(df, [R.dilate("road", 9, "near_road")])
    df = R.morph(df, ops(building=R.erode("building", 3, "building"), drain=R.dilate("water", 9, "near_water")))
    df = R.morph(df, ops(building=("building", "building", "dilate", -2, 2)))
    df = R.morph(df, ops(building=R.erode("building", 3, "building")))
    df = R.combine(df, **texts(drain="{dark} & ({near_road} | {near_water}) & ~{green}", vehicle="{bright} & {near_road}"))
    if has("drain"):
        df = R.clean(df, {"drain": 3})
    df = R.core(df, has(*MAP_MASKS))
    drawn = has("building", "parks", "vehicle")
    if not drawn:
        return df.select(*R.KEY, *wanted)

    first = cut_lineage(df)
    lab = cut_lineage(Q.labelled_regions(R.long_masks(first, drawn)))
    stats = Q.region_stats(lab)
    kept = region_filter_map(stats, drawn[0], scale)
    for name in drawn[1:]:
        kept = kept.unionByName(region_filter_map(stats, name, scale))
    second = Q.add_masks(first, Q.keep_regions(lab, kept), drawn)
    if not has("waste", "solar"):
        return second.select(*R.KEY, *wanted)
    df = R.banded(second, has("waste", "solar", "road", "building"), 16)
    df = R.combine(df, **texts(waste="{waste} & ~{road} & ~{building}"))
    if has("solar"):
        df = R.morph(df, [R.dilate("building", 9, "near")])
        df = R.combine(df, solar="{solar} & {near}")
    return R.core(_cleaned_last(df, has("waste", "solar")), list(wanted))


def _cleaned_last(df: R.Banded, which: list[str]) -> R.Banded:
    """Opening and closing of waste (5) and solar (3), as far as they are wanted."""
    return R.clean(df, {m: k for m, k in (("waste", 5), ("solar", 3)) if m in which})


def min_area_by_class(regions: DataFrame, scale: float = 1.0) -> DataFrame:
    """Regions at least as large as their class demands. ``mask_key`` names the class."""
    floor = F.coalesce(_named(F.col("mask_key"), K.MIN_REGION_AREA), F.lit(K.MIN_REGION_AREA_OTHER))
    return regions.where(F.col("area") >= floor * scale)


def mask_keys(mask):
    key_of = {row[0]: row[5] for row in K.CATEGORIES}
    return _named(mask, {m: key_of[c] for m, c in MAP_MASKS.items()})


def map_assets(words: DataFrame, scale: float = 1.0, mpp: float = 1.0) -> DataFrame:
    """Asset records of all regions of the nine masks, numbered in category order."""
    lab = cut_lineage(Q.labelled_regions(R.long_masks(words, list(MAP_MASKS))))
    found = Q.region_stats(lab).withColumn("mask_key", mask_keys(F.col("mask")))
    found = min_area_by_class(found, scale).withColumn("category", _named(F.col("mask"), MAP_MASKS))
    outline = O.region_outline(Q.keep_regions(lab, found))
    df = found.join(by_key(outline), ["image_id", "mask", "comp_id"]).withColumn("ord", category_ord(F.col("category")))
    df = numbered(df, ["image_id"], F.col("ord") * 1000000 + F.floor(F.col("min_y") / 256), ["min_y", "min_x", "comp_id"], "asset_idx")
    norm = lambda c, size: F.least(F.greatest(c / F.col(size) * 100.0, F.lit(0.0)), F.lit(100.0))
    df = df.withColumns({
        "x0": norm(F.col("min_x"), "w"), "y0": norm(F.col("min_y"), "h"),
        "x9": norm(F.col("max_x") + 1, "w"), "y9": norm(F.col("max_y") + 1, "h"),
        "cov": F.col("area") / F.greatest((F.col("w").cast("double") * F.col("h")), F.lit(1.0)) * 100.0})
    r4 = {n: C.rounded(F.col(c), 4) for n, c in (("x_min", "x0"), ("y_min", "y0"), ("x_max", "x9"), ("y_max", "y9"))}
    ring = F.transform("outline", lambda p: F.struct(
        C.rounded(norm(p["x"], "w"), 4).alias("x"), C.rounded(norm(p["y"], "h"), 4).alias("y")))
    poly = F.when(F.size("outline") >= 3, ring).otherwise(G.ring_from_bbox(r4))
    return df.select(
        "image_id", "asset_idx", F.concat(F.lit("asset_map_"), F.col("asset_idx").cast("string")).alias("unique_id"),
        "category", F.col("mask_key").alias("subcategory"), C.rounded(C.map_confidence(F.col("cov")), 2).alias("confidence_percent"),
        F.lit(1).cast("bigint").alias("estimated_count"), C.rounded(C.to_area_m2(F.col("area"), mpp), 2).alias("estimated_area_sq_m"),
        F.struct(C.rounded(C.to_length_m(F.col("bw").cast("double"), mpp), 2).alias("length"),
                 C.rounded(C.to_length_m(F.col("bh").cast("double"), mpp), 2).alias("width")).alias("estimated_dimensions_m"),
        C.rounded(F.least(F.col("cov"), F.lit(100.0)), 4).alias("estimated_coverage_percent"),
        F.lit("Monitored").alias("condition_status"), F.lit("Medium").alias("maintenance_priority"),
        G.point(C.rounded((F.col("x0") + F.col("x9")) / 2.0, 4), C.rounded((F.col("y0") + F.col("y9")) / 2.0, 4)).alias("center_coordinates"),
        F.struct(*[c.alias(n) for n, c in r4.items()]).alias("bounding_box"), poly.alias("polygon_coordinates"),
        F.concat("mask_key", F.lit(K.TEXT_MAP_DESCRIPTION)).alias("visual_description"),
        F.lit(K.TEXT_MAP_BASIS).alias("estimation_basis"),
        F.lit(0.0).alias("shadow_length_pixels"), F.lit(0.0).alias("shadow_length_meters"), F.lit(0.0).alias("estimated_height_meters"))


def _gated(kept: DataFrame, gates: dict[str, dict]) -> DataFrame:
    """Regions of the masks in images that pass the gate of their mask: enough of them, and enough of the image covered."""
    proof = kept.groupBy("image_id", "mask").agg(F.count(F.lit(1)).alias("c"), (F.sum("n") / F.max(F.col("w").cast("double") * F.col("h")) * 100.0).alias("pct"))
    ok = F.lit(False)
    for mask, gate in gates.items():
        passed = (F.col("mask") == mask) & (F.col("c") >= gate.get("at_least", 1))
        if gate.get("over_percent") is not None:
            passed = passed & (F.col("pct") > gate["over_percent"])
        ok = ok | passed
    return kept.join(by_key(proof.where(ok).select("image_id", "mask")), ["image_id", "mask"], "left_semi")


def stage_gates(kept: DataFrame, mask: str, at_least: int = 1, over_percent: float | None = None) -> DataFrame:
    """Regions of ``mask`` in images with enough of them (and enough of the image covered)."""
    return _gated(kept.where(F.col("mask") == mask), {mask: {"at_least": at_least, "over_percent": over_percent}})


def _draw(words: DataFrame, rules: dict[str, tuple[dict, dict]], scale: float):
    """Label the masks, filter and gate their regions; redraw. Returns the words and kept regions.

    A gate without bounds lets every image with a region pass, so nothing is looked up for it.
    """
    lab = cut_lineage(Q.labelled_regions(R.long_masks(words, list(rules))))
    ok = F.lit(False)
    for name, (bounds, _) in rules.items():
        ok = ok | ((F.col("mask") == name) & Q.within(**{k: v * scale if k.endswith("area") else v for k, v in bounds.items()}))
    kept = cut_lineage(Q.region_stats(lab).where(ok))
    if any(gate for _, gate in rules.values()):
        kept = cut_lineage(_gated(kept, {name: gate for name, (_, gate) in rules.items()}))
    return Q.add_masks(words, Q.keep_regions(lab, kept), list(rules)), kept


def _video_words(px: DataFrame, scale: float, wanted: Iterable[str]) -> tuple[DataFrame, DataFrame | None]:
    """Word table with the wanted frame masks and those they are made from, green as ``green_raw`` before its gate, and the kept regions of all but green."""
    need, raw = needed(wanted, VIDEO_FROM)
    has = lambda *names: [m for m in names if m in need]
    ops = lambda **by_mask: [op for m, op in by_mask.items() if m in need]
    texts = lambda **by_mask: {m: text for m, text in by_mask.items() if m in need}
    kept = []

    def draw(df: R.Banded, made: list[str], rules: dict[str, tuple[dict, dict]], left: list[str]) -> DataFrame:
        words = cut_lineage(R.core(df, list(dict.fromkeys(has(*made) + [b for b in left if b in raw]))))
        rules = {m: r for m, r in rules.items() if m in need}
        if not rules:
            return words
        words, found = _draw(words, rules, scale)
        kept.append(found)
        return words

    df = R.banded(R.pixel_words(px, {n: c for n, c in R.bands_of("video").items() if n in raw}), has("green", "water"), 32)
    df = R.clean(df, {"green": 5})
    df = R.combine(df, **texts(water="{water} & ~{green}"))
    df = R.morph(df, ops(water=R.erode("water", 5, "water"), parks=R.dilate("green", 11, "parks")))
    df = R.morph(df, ops(water=("water", "water", "dilate", -4, 4), parks=R.erode("parks", 11, "parks")))
    df = R.morph(df, ops(water=R.erode("water", 5, "water")))
    rest = ["road", "lowsat", "bright", "roof", "dark", "waste", "solar"]
    words = draw(df, ["green", "parks", "water"], {"parks": ({"min_area": 8000}, {}), "water": ({"min_area": 1500}, {})}, rest)

    if has("road"):
        df = R.banded(words, ["road", "lowsat", "green", "water"], 16)
        df = R.combine(df, road="({road} | {lowsat}) & ~{green} & ~{water}")
        df = R.clean(df, {"road": 5})
        words = draw(df, ["green", "parks", "water"], {"road": ({"min_area": 2500, "min_aspect": 3.0, "min_extent": 0.18}, {})}, rest)

    if has("building", "drain", "vehicle"):
        df = R.banded(words, ["green", "water", "road", *[b for b in ("bright", "roof", "dark") if b in raw]], 16)
        df = R.combine(df, **texts(building="{bright} & {roof} & ~{green} & ~{road} & ~{water}"))
        if has("drain"):
            df = R.morph(df, [R.dilate("road", 11, "ctx_road"), R.dilate("water", 11, "ctx_water")])
        if has("vehicle"):
            df = R.morph(df, [R.dilate("road", 7, "near_road")])
        df = R.combine(df, **texts(drain="{dark} & ({ctx_road} | {ctx_water}) & ~{green}", vehicle="{bright} & {near_road} & ~{green}"))
        df = R.clean(df, {m: k for m, k in (("building", 3), ("drain", 3), ("vehicle", 2)) if m in need})
        words = draw(df, ["green", "parks", "water", "road", "building", "drain", "vehicle"], {
            "building": ({"min_area": 220, "max_area": 18000, "max_aspect": 4.5, "min_extent": 0.45}, {"at_least": 2, "over_percent": 0.05}),
            "drain": ({"min_area": 180, "max_area": 8000, "min_aspect": 4.0, "min_extent": 0.12}, {}),
            "vehicle": ({"min_area": 12, "max_area": 180, "max_aspect": 4.0, "min_extent": 0.35}, {"at_least": 3}),
        }, ["waste", "solar"])

    if has("waste", "solar"):
        df = R.banded(words, has("green", "road", "building", "waste", "solar"), 16)
        df = R.combine(df, **texts(waste="{waste} & ~{road} & ~{building} & ~{green}"))
        if has("solar"):
            df = R.morph(df, [R.dilate("building", 7, "near")])
            df = R.combine(df, solar="{solar} & {near}")
        words = draw(_cleaned_last(df, has("waste", "solar")), list(MAP_MASKS), {
            "waste": ({"min_area": 2000, "max_area": 50000, "min_extent": 0.15}, {}),
            "solar": ({"min_area": 80, "max_area": 4000, "max_aspect": 5.0, "min_extent": 0.40}, {}),
        }, [])

    regions = kept[0] if kept else None
    for more in kept[1:]:
        regions = regions.unionByName(more)
    return words.withColumnRenamed("green", "green_raw"), regions


def _gated_green(words: DataFrame) -> DataFrame:
    """``words`` with ``green``: the raw green mask, empty in images that it covers too little."""
    pct = F.sum(F.bit_count("green_raw")) / F.max(F.col("w").cast("double") * F.col("h")) * 100.0
    lush = words.groupBy("image_id").agg(pct.alias("p")).where("p > 1.0").select("image_id", F.lit(True).alias("_lush"))
    return words.join(by_key(lush), "image_id", "left").withColumn(
        "green", F.when(F.col("_lush"), F.col("green_raw")).otherwise(F.lit(0).cast("bigint"))).drop("_lush")


def video_mask(px: DataFrame, mask: str, scale: float = 1.0) -> DataFrame:
    """Word table with one frame mask; masks that it is not made from are not made."""
    words, _ = _video_words(px, scale, [mask])
    return (_gated_green(words) if mask == "green" else words).select(*R.KEY, mask)


def video_masks(px: DataFrame, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Word table with the nine frame masks (empty where a gate fails), and the kept regions.

    The raw green mask is kept as ``green_raw``: it is subtracted even where green itself
    does not pass its gate.
    """
    words, kept = _video_words(px, scale, MAP_MASKS)
    words = cut_lineage(_gated_green(words))
    g = Q.region_stats(Q.labelled_regions(R.long_masks(words, ["green"])))
    g = Q.region_filter(g, min_area=K.MIN_FRAME_AREA["Trees & Green Cover"] * scale)
    return words, kept.unionByName(g)


def frame_observations(px: DataFrame, scale: float = 1.0) -> DataFrame:
    """Regions and covered pixels per frame and category; categories without a mask are left out.

    A frame without any mask is one row without a category, of count and area 0, so that later divisors count it.
    """
    return frame_observations_of(*video_masks(px, scale))


def frame_observations_of(words: DataFrame, kept: DataFrame) -> DataFrame:
    counts = kept.groupBy("image_id", "mask").agg(F.count(F.lit(1)).alias("cnt"))
    area = R.long_masks(words, list(MAP_MASKS)).groupBy("image_id", "mask").agg(
        F.sum(F.bit_count("bits")).cast("double").alias("area_px")).where("area_px > 0")
    seen = area.join(by_key(counts), ["image_id", "mask"], "left")
    return words.select("image_id").distinct().join(by_key(seen), "image_id", "left").select(
        "image_id", _named(F.col("mask"), MAP_MASKS).alias("category"), F.coalesce("cnt", F.lit(0)).alias("cnt"), F.coalesce("area_px", F.lit(0.0)).alias("area_px"))


def class_map_blend(px: DataFrame, words: DataFrame, mode: str = "map") -> DataFrame:
    """Pixel colours with the category colours laid over: the last mask in order wins."""
    order = list(MAP_MASKS) if mode == "map" else ["green", "parks", "water", "road", "building", "drain", "vehicle", "waste", "solar"]
    rgb = {row[0]: (row[3] if mode == "map" else tuple(reversed(row[4]))) for row in K.CATEGORIES}
    own, over = (0.45, 0.55) if mode == "map" else (0.70, 0.30)
    # pixels meet their word, of which there are 64 times fewer, and test their bit
    at = words.select("image_id", "y", "xb", *order)
    df = px.withColumn("xb", F.floor(F.col("x") / 64).cast("int")).join(by_key(at), ["image_id", "y", "xb"])
    bit = lambda m: F.expr(f"(shiftrightunsigned(`{m}`, CAST(x % 64 AS INT)) & 1L) = 1L")
    df = df.withColumns({m: bit(m) for m in order})
    out = {}
    for i, c in enumerate(("r", "g", "b")):
        paint = F.coalesce(*[F.when(F.col(m), F.lit(rgb[MAP_MASKS[m]][i])) for m in reversed(order)], F.col(c))
        out[c] = F.rint(F.col(c) * own + paint * over).cast("int")
    return df.select("image_id", "y", "x", *[c.alias(n) for n, c in out.items()])
