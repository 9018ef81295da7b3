"""Model-response text: extraction, repair, parsing and validation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terratally import fixed_values as K
from terratally.functions import clean as C
from terratally.operators import assets as A, stats as S
from terratally.session import by_key, cut_lineage


def extract_json(text: Column) -> Column:
    """First fenced block, else from the first ``{`` to the last ``}``, else the trimmed text."""
    fence = r"(?is)```(?:json)?\s*(.*?)\s*```"
    start, back = F.instr(text, "{"), F.instr(F.reverse(text), "}")
    end = F.length(text) - back + 1
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "{}")
        .when(F.regexp_like(text, F.lit(fence)), F.trim(F.regexp_extract(text, fence, 1)))
        .when((start > 0) & (back > 0) & (end > start), F.substring(text, start, end - start + 1))
        .otherwise(F.regexp_replace(text, r"^\s+|\s+$", "")))


def repair_json(candidate: Column) -> Column:
    """Control characters and trailing commas removed."""
    clean = F.regexp_replace(F.regexp_replace(candidate, r"^\s+|\s+$", ""), r"[\x00-\x1f\x7f]", "")
    return F.regexp_replace(clean, r",\s*([}\]])", "$1")


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def parse_response(responses: DataFrame, *kept: str) -> DataFrame:
    """``doc`` (VARIANT, null when unusable) and the parse warning, if any; ``kept`` names further columns to keep."""
    repaired = repair_json(extract_json(F.col("raw_text")))
    df = responses.withColumn("_v", F.try_parse_json(repaired))
    empty = F.coalesce("raw_text", F.lit("")) == ""
    warning = (F.when(empty, K.WARN_EMPTY).when(F.col("_v").isNull(), K.WARN_PARSE)
               .when(~is_object(F.col("_v")), K.WARN_NOT_OBJECT))
    doc = F.when(~empty & is_object(F.col("_v")), F.col("_v"))
    return df.select("response_id", doc.alias("doc"), warning.alias("parse_warning"), *kept)


def _get(path: str, typ: str = "string", col: str = "doc") -> Column:
    return F.try_variant_get(col, path, typ)


def explode_assets(parsed: DataFrame) -> DataFrame:
    """Entries of detected_assets with their 1-based position; ``entry`` is VARIANT."""
    items = F.when(is_list(_get("$.detected_assets", "variant")), _get("$.detected_assets", "array<variant>"))
    return parsed.select("response_id", F.posexplode(items).alias("_p", "entry")).select(
        "response_id", (F.col("_p") + 1).alias("asset_idx"), "entry", is_object(F.col("entry")).alias("valid"))


def reject_bad_assets(entries: DataFrame) -> DataFrame:
    """Entries that are not objects, with their warning."""
    return entries.where(~F.col("valid")).select(
        "response_id", "asset_idx",
        F.format_string(K.TEXT_BAD_ENTRY, "asset_idx").alias("warning"))


def box_side(name: str) -> Column:
    """Side of a stated box as text; a side stated as null is 0, a side left out stays null."""
    value = F.try_variant_get("entry", f"$.bounding_box.{name}", "variant")
    stated = F.is_variant_null(value)
    return F.when(stated, F.lit("0")).otherwise(F.try_variant_get("entry", f"$.bounding_box.{name}", "string"))


def entry_fields(entries: DataFrame) -> DataFrame:
    """Object entries as loosely typed records, ready for ``fill_asset_defaults``."""
    get = lambda p, t="string": _get(p, t, "entry")
    obj = lambda p, names: F.struct(*[get(f"{p}.{n}").alias(n) for n in names])
    pts = F.transform(
        F.filter(get("$.polygon_coordinates", "array<variant>"), is_object),
        lambda p: F.struct(F.try_variant_get(p, "$.x", "string").alias("x"), F.try_variant_get(p, "$.y", "string").alias("y")))
    plain = ["unique_id", "category", "subcategory", "subtype", "confidence_percent", "estimated_count",
             "estimated_area_sq_m", "estimated_coverage_percent", "condition_status", "maintenance_priority",
             "visual_description", "estimation_basis", "shadow_length_pixels", "shadow_length_meters",
             "estimated_height_meters"]
    return entries.where("valid").select(
        F.col("response_id").alias("image_id"), "asset_idx", *[get(f"$.{n}").alias(n) for n in plain],
        obj("$.estimated_dimensions_m", ["length", "width"]).alias("estimated_dimensions_m"),
        obj("$.center_coordinates", ["x", "y"]).alias("center_coordinates"),
        F.struct(*[box_side(n).alias(n) for n in ("x_min", "y_min", "x_max", "y_max")]).alias("bounding_box"),
        pts.alias("polygon_coordinates"))


def response_assets(parsed: DataFrame) -> DataFrame:
    """Cleaned records of all responses, with a placeholder where a response has none."""
    found = A.fill_asset_defaults(entry_fields(explode_assets(parsed)))
    return A.fallback_asset(parsed.select(F.col("response_id").alias("image_id")), found)


def incoming_stats(parsed: DataFrame) -> DataFrame:
    """Category statistics the response itself states, coerced; one row for each known category it names.

    The entries are taken apart once, as a lateral table, and only those of known categories are looked into.
    """
    number = F.create_map(*[F.lit(x) for i, n in enumerate(S.NAMES, 1) for x in (n, i)])
    stated = F.when(is_object(_get("$.category_statistics", "variant")), _get("$.category_statistics", "variant"))
    docs = parsed.select(F.col("response_id").alias("image_id"), stated.alias("_stated")).where("_stated IS NOT NULL")
    rows = docs.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("_stated").outer())).withColumn("ord", number[F.col("key")]).where("ord IS NOT NULL")
    get = lambda p: _get(p, col="value")
    return rows.select(
        "image_id", "ord", F.col("key").alias("category"),
        F.greatest(C.safe_int(get("$.count")), F.lit(0).cast("bigint")).alias("count"),
        F.greatest(C.safe_float(get("$.total_area_sq_m")), F.lit(0.0)).alias("total_area_sq_m"),
        C.clamp(get("$.coverage_percent")).alias("coverage_percent"))


def header_fields(parsed: DataFrame) -> DataFrame:
    """Header, risk and insight fields with defaults, one row per response."""
    text = lambda p, d="Unknown": C.safe_text(_get(p), d)
    usable = F.col("doc").isNotNull()
    given = F.when(is_list(_get("$.ai_insights", "variant")), _get("$.ai_insights", "array<string>"))
    insights = F.when(usable, S.pad_insights(given)).otherwise(F.array(*[F.lit(t) for t in K.DEFAULT_INSIGHTS]))
    return parsed.select(
        "response_id", text("$.image_analysis.scene_type").alias("scene_type"),
        text("$.image_analysis.image_quality").alias("image_quality"),
        F.greatest(C.safe_float(_get("$.image_analysis.estimated_total_area_sq_m")), F.lit(0.0)).alias("estimated_total_area_sq_m"),
        C.clamp(_get("$.image_analysis.overall_detection_confidence_percent")).alias("overall_detection_confidence_percent"),
        text("$.image_analysis.dominant_land_use").alias("dominant_land_use"),
        *[text(f"$.risk_analysis.{r}").alias(r) for r in ("encroachment_risk", "drainage_risk", "environmental_risk", "flood_risk")],
        F.greatest(C.safe_int(_get("$.summary_statistics.total_assets_detected")), F.lit(0).cast("bigint")).alias("given"),
        insights.alias("ai_insights"))


def collect_warnings(parsed: DataFrame) -> DataFrame:
    """All warnings of a response in the order the checks run.

    Entry warnings are ordered by position. Their number per response is bounded by the
    length of one response text.
    """
    entries = explode_assets(parsed)
    bad = reject_bad_assets(entries).groupBy("response_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("asset_idx", "warning"))), lambda w: w["warning"]).alias("_bad"))
    good = entries.where("valid").select("response_id").distinct().withColumn("_has", F.lit(True))
    listed = _get("$.detected_assets", "variant")
    stats = _get("$.category_statistics", "variant")
    head = parsed.select(
        "response_id", "parse_warning",
        F.when(listed.isNotNull() & ~is_list(listed), K.WARN_NO_LIST).alias("_nolist"),
        F.when(stats.isNotNull() & ~is_object(stats), K.WARN_NO_STATS).alias("_nostats"))
    none = F.array().cast("array<string>")
    return head.join(by_key(bad), "response_id", "left").join(by_key(good), "response_id", "left").select(
        "response_id", F.array_compact(F.concat(
            F.array("parse_warning"), F.coalesce("_bad", none), F.array(
                "_nolist", F.when(F.col("_has").isNull(), K.WARN_NO_ASSETS), "_nostats"))).alias("warnings"))


def validate_response(parsed: DataFrame, additive: bool = True) -> DataFrame:
    """One validated row per response: header, recomputed summary, risk, insights.

    With ``additive`` the stated category statistics and the assets add up, as in
    the service this models; otherwise only the assets count. The parsed documents and
    the assets are read several times, so each is written out once.
    """
    parsed = cut_lineage(parsed)
    assets = cut_lineage(response_assets(parsed))
    stats = S.category_stats(assets, incoming_stats(parsed) if additive else None)
    head = header_fields(parsed)
    counts = assets.groupBy("image_id").agg(F.sum("estimated_count").alias("asset_total"))
    summary = S.image_summary(stats).drop("total_assets_detected").withColumnRenamed("image_id", "response_id")
    return (head.join(by_key(summary), "response_id")
            .join(by_key(counts.withColumnRenamed("image_id", "response_id")), "response_id")
            .withColumn("total_assets_detected", F.greatest("asset_total", "given")).drop("asset_total", "given"))
