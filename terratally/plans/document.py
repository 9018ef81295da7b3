"""The full result document of an image: cards, statistics, map layers, insights, charts and table rows as JSON."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terratally import fixed_values as K
from terratally.functions import clean as C
from terratally.operators import assets as A, gis, stats as S
from terratally.session import by_key

CARDS = ["total_assets_detected", "green_cover_percent", "built_up_percent", "road_network_percent", "water_body_percent", "open_space_percent",
         "overall_detection_confidence_percent", "estimated_total_area_sq_m", "urban_density_score"]
RISKS = ["encroachment_risk", "drainage_risk", "environmental_risk", "flood_risk"]


def _listed(assets: DataFrame, layers: dict[str, list], part: Column) -> DataFrame:
    """The rows of an image's part in every layer, as lists in asset order.

    Every layer has one row for each asset, so all of them are gathered in one exchange; nothing is joined.
    """
    rows = gis.placed(assets).select("image_id", part.alias("part"), F.struct("asset_idx", *[F.struct(*cols).alias(n) for n, cols in layers.items()]).alias("_r"))
    both = rows.groupBy("image_id", "part").agg(F.array_sort(F.collect_list("_r")).alias("_r"))
    return both.select("image_id", "part", *[F.col("_r")[n].alias(n) for n in layers])


def _charts(assets: DataFrame, stats: DataFrame) -> DataFrame:
    """(image_id, chart, priorities): the image's categories in order with their figures, and its assets by priority.

    Everything is gathered by image alone, which needs no exchange where the assets are dealt out by image.
    """
    covers = stats.where("coverage_percent > 0").groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "coverage_percent"))).alias("_cover"))
    entry = F.struct(A.category_ord(F.col("category")).alias("ord"), "category", "count", "area_sq_m")
    chart = S.category_totals(assets).groupBy("image_id").agg(F.array_sort(F.collect_list(entry)).alias("_chart"))
    prio = S.priority_histogram(assets).groupBy("image_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("priority", "assets")))).alias("priorities"))
    full = F.transform("_chart", lambda c: F.struct(
        c["ord"].alias("ord"), c["category"].alias("category"), c["count"].alias("count"), c["area_sq_m"].alias("area_sq_m"),
        F.coalesce(F.col("_cover")[c["category"]], F.lit(0.0)).alias("coverage_percent"), C.color_of(c["category"]).alias("color"), C.layer_of(c["category"]).alias("layer_id")))
    return chart.join(by_key(covers), "image_id", "left").join(by_key(prio), "image_id", "left").select("image_id", full.alias("chart"), "priorities")


def result_document(report: DataFrame, assets: DataFrame, stats: DataFrame, lat0: float = K.MAP_CENTER_LAT, lng0: float = K.MAP_CENTER_LNG,
                    part_size: int = 10_000) -> DataFrame:
    """(image_id, part, rows, payload): one document per image, in parts of ``part_size`` assets.

    ``report``: image_id, the card figures, the four risks and ``ai_insights``. Cards, statistics, insights and charts are the
    same in every part; layers and table rows are those of the part. An image without assets has one part without rows.
    """
    part = F.greatest(F.floor((F.col("asset_idx") - 1) / part_size), F.lit(0)).cast("int")
    lists = _listed(assets, {"asset_table_rows": A.row_columns(), "leaflet_polygons": gis.polygon_columns(lat0, lng0),
                             "leaflet_markers": gis.marker_columns(lat0, lng0), "heatmap_points": gis.heat_columns(lat0, lng0)}, part)

    # a mode that states no risk or insight leaves them unknown
    head = report.select("image_id", *CARDS, *RISKS, "ai_insights").join(by_key(_charts(assets, stats)), "image_id", "left")
    head = head.withColumns({"classes": F.coalesce(F.size("chart"), F.lit(0)), "total": F.col("total_assets_detected"), "green": F.col("green_cover_percent"), "built": F.col("built_up_percent")})
    head = S.governance_insights(head)

    items = lambda *names: F.transform("chart", lambda c: F.struct(*[c[old].alias(new) for old, new in names]))
    by_category = lambda field: F.map_from_entries(F.transform("chart", lambda c: F.struct(c["category"], c[field])))
    empty = F.array().cast("array<string>")
    # the head meets all parts of its image; lists gathered where the image lies stay there
    done = head.join(by_key(lists), "image_id", "left").select(
        "image_id", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce(F.size("asset_table_rows"), F.lit(0)).cast("bigint").alias("rows"),
        F.struct(*CARDS).alias("analytics_cards"),
        F.struct(by_category("count").alias("category_counts"), by_category("area_sq_m").alias("category_total_area_sq_m"),
                 F.col("priorities").alias("maintenance_priorities"), F.struct(*RISKS).alias("risk_indicators")).alias("asset_statistics"),
        F.struct(F.struct(F.lit(lat0).alias("lat"), F.lit(lng0).alias("lng")).alias("map_center"), "leaflet_polygons", "leaflet_markers", "heatmap_points").alias("gis_mapping"),
        F.struct(F.coalesce("ai_insights", empty).alias("ai_insights_cards"), F.array("environmental_risk", "flood_risk").alias("environmental_risks"),
                 F.array("encroachment_risk").alias("encroachment_warnings"), F.array("drainage_risk").alias("drainage_observations"), "governance_insights").alias("dashboard_insights"),
        F.struct(items(("category", "name"), ("count", "value"), ("color", "color")).alias("pie_chart_data"),
                 items(("category", "name"), ("area_sq_m", "area_sq_m"), ("color", "color")).alias("area_distribution_data"),
                 items(("category", "name"), ("coverage_percent", "coverage_percent"), ("color", "color")).alias("coverage_graph_data"),
                 items(*[(c, c) for c in ("category", "count", "area_sq_m", "coverage_percent", "color", "layer_id")]).alias("category_comparison_data")).alias("chart_data"),
        "asset_table_rows")
    names = ["analytics_cards", "asset_statistics", "gis_mapping", "dashboard_insights", "chart_data", "asset_table_rows"]
    return done.select("image_id", "part", "rows", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("payload"))
