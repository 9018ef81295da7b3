"""Input relations derived from the given tables, one SQL text per relation.

``{grid}`` marks the row generator, the only place where engines differ:
Spark explodes sequences, other engines unnest ranges.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from terratally.operators.ranking import crowded, numbered
from terratally.session import parts_for, spread

IMAGE_W, IMAGE_H = 96, 64
#: Rows of ``lineitem`` that a task takes, a quarter of TASK_ROWS: their records and documents are about fifty times as wide.
LINE_ROWS = 100_000

BOXES = """
SELECT l_orderkey AS image_id, l_linenumber, l_partkey, l_suppkey,
  CAST(l_partkey % 6 AS INT) AS cls_id, l_discount * 10 AS conf,
  CAST((l_partkey * 37) % 300 AS DOUBLE) AS x1,
  CAST((l_suppkey * 91 + l_partkey * 7) % 200 AS DOUBLE) AS y1,
  CAST((l_partkey * 37) % 300 AS DOUBLE) + 40 + l_quantity * 4 AS x2,
  CAST((l_suppkey * 91 + l_partkey * 7) % 200 AS DOUBLE) + 40 + l_quantity * 3 AS y2,
  CAST(512 AS INT) AS image_w, CAST(384 AS INT) AS image_h
FROM {lineitem}
"""

RAW_ASSETS = """
SELECT l_orderkey AS image_id, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 5 = 1 THEN '  ' ELSE concat(' a', CAST(l_partkey AS STRING), ' ') END AS unique_id,
  CASE CAST(l_partkey % 20 AS INT) WHEN 0 THEN 'parking lot' WHEN 1 THEN 'street' WHEN 2 THEN 'storm water drain'
    WHEN 3 THEN 'underground drain' WHEN 4 THEN 'greenhouse' WHEN 5 THEN ' Solar Array ' WHEN 6 THEN ''
    WHEN 7 THEN 'xyz' WHEN 8 THEN 'WATER BODIES' WHEN 9 THEN NULL WHEN 10 THEN 'Sewage outlet'
    WHEN 11 THEN 'delivery truck' WHEN 12 THEN 'Landfill' WHEN 13 THEN 'main road' WHEN 14 THEN 'built-up block'
    WHEN 15 THEN 'manhole cover' WHEN 16 THEN 'photovoltaic' WHEN 17 THEN 'car' WHEN 18 THEN 'lake' ELSE 'Waste Dumps' END AS category,
  CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' roof ' ELSE '   ' END AS subcategory,
  CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'alt type' WHEN 1 THEN '' ELSE NULL END AS subtype,
  CASE CAST((l_partkey + l_linenumber) % 9 AS INT) WHEN 0 THEN '5' WHEN 1 THEN ' 5 ' WHEN 2 THEN '1e1' WHEN 3 THEN 'abc' WHEN 4 THEN NULL
    WHEN 5 THEN 'NaN' WHEN 6 THEN 'Infinity' WHEN 7 THEN '-3' ELSE '250' END AS confidence_percent,
  CASE CAST((l_suppkey + l_linenumber) % 6 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '3' WHEN 2 THEN '2.9' WHEN 3 THEN '-4' WHEN 4 THEN 'many' ELSE '12' END AS estimated_count,
  CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '-10.5' ELSE CAST(CAST(floor(l_quantity * 8) AS BIGINT) AS STRING) END AS estimated_area_sq_m,
  CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN '120' WHEN 1 THEN NULL ELSE CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING) END AS estimated_coverage_percent,
  CASE CAST(l_linenumber % 3 AS INT) WHEN 0 THEN 'Good' WHEN 1 THEN NULL ELSE ' Worn ' END AS condition_status,
  CASE CAST(l_linenumber % 5 AS INT) WHEN 0 THEN 'High' WHEN 1 THEN NULL WHEN 2 THEN 'Low' WHEN 3 THEN '' ELSE 'Urgent' END AS maintenance_priority,
  CAST(l_partkey % 130 - 10 AS DOUBLE) AS px, CAST(l_suppkey % 120 - 5 AS DOUBLE) AS py,
  CAST(l_partkey % 97 AS DOUBLE) AS bx0, CAST(l_suppkey % 89 AS DOUBLE) AS by0,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_partkey % 97 AS DOUBLE) + l_quantity - 10 END AS bx1,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_suppkey % 89 AS DOUBLE) + l_quantity / 2 - 4 END AS by1,
  CAST(l_linenumber % 5 AS INT) AS n_points
FROM {lineitem}
"""

SHADOWS = """
SELECT o_orderkey AS image_id, CAST(k AS INT) AS shadow_id,
  CAST((o_custkey * 13 + k * 57) % 480 AS DOUBLE) AS cx, CAST((o_orderkey * 7 + k * 83) % 360 AS DOUBLE) AS cy,
  CAST(10 + (o_custkey + k * 5) % 30 AS DOUBLE) AS half_w, CAST(6 + (o_orderkey + k * 3) % 20 AS DOUBLE) AS half_h
FROM {orders} {grid_k}
"""

FRAMES = """
SELECT user_id AS video_id, event_id, CAST(ts AS TIMESTAMP) AS ts,
  CASE event_type WHEN 'signup' THEN 'Properties & Buildings' WHEN 'view' THEN 'Trees & Green Cover'
    WHEN 'click' THEN 'Roads & Footpaths' WHEN 'purchase' THEN 'Water Bodies' ELSE 'Drains & Sewage' END AS category,
  CAST(event_id % 4 AS INT) AS cnt, value * 100 AS area_px
FROM {events}
"""

RESPONSES = """
SELECT o_orderkey AS response_id,
  CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN concat('```json', chr(10), j, chr(10), '```') WHEN 1 THEN concat('Here it is: ', j, ' done')
    WHEN 2 THEN replace(j, '}}]', '}},]') WHEN 3 THEN 'no json here' WHEN 4 THEN '' WHEN 5 THEN '[1, 2]'
    WHEN 6 THEN replace(j, '"image_analysis"', concat(chr(10), '"image_analysis"')) ELSE j END AS raw_text
FROM (SELECT o_orderkey, concat(
    '{{"image_analysis":{{"scene_type":" ', o_orderpriority, ' ","estimated_total_area_sq_m":"', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '"}},',
    '"risk_analysis":{{"flood_risk":"', o_orderstatus, '"}},',
    CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN '"category_statistics":[],' WHEN 1 THEN '"category_statistics":{{"Water Bodies":{{"count":2,"total_area_sq_m":"7.5","coverage_percent":40}}}},' ELSE '' END,
    '"ai_insights":[', CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN '"one"," ",null' ELSE '"a","b","c","d","e","f"' END, '],',
    '"detected_assets":', CASE CAST(o_custkey % 7 AS INT) WHEN 0 THEN '"none"' WHEN 1 THEN '[5]' ELSE concat('[5,{{"category":"',
    CASE o_orderstatus WHEN 'F' THEN 'parking lot' WHEN 'O' THEN 'street' ELSE 'storm water drain' END,
    '","estimated_count":"', CAST(o_custkey % 9 AS STRING),
    '","confidence_percent":', CAST(o_orderkey % 140 AS STRING),
    ',"estimated_area_sq_m":', CAST(o_custkey % 50 AS STRING), ',"estimated_coverage_percent":', CAST(o_custkey % 30 AS STRING),
    ',"bounding_box":{{"x_min":', CAST(o_custkey % 60 AS STRING), ',"y_min":20,"x_max":10,"y_max":', CAST(o_orderkey % 110 AS STRING),
    '}}}}]') END, '}}') AS j FROM {orders}) q
"""

FILES = """
SELECT p_partkey AS file_id,
  concat('shot_', CAST(p_partkey AS STRING), CASE CAST(p_size % 7 AS INT) WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.mp4' WHEN 3 THEN '.MOV' WHEN 4 THEN '.gif' WHEN 5 THEN '' ELSE '.webm' END) AS filename,
  CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'video/mp4' WHEN 3 THEN 'text/plain' WHEN 4 THEN NULL ELSE 'image/gif' END AS content_type,
  CAST(CASE WHEN p_size % 9 = 0 THEN 0 ELSE p_size * p_size * 250000 END AS BIGINT) AS size_bytes,
  CASE CAST(p_size % 5 AS INT) WHEN 0 THEN 'block_analysis' WHEN 1 THEN 'naming_analysis' WHEN 2 THEN 'asset_map_analysis' WHEN 3 THEN 'heat_analysis' ELSE 'block_analysis' END AS mode,
  CASE WHEN p_size % 2 = 0 THEN 'image' ELSE 'video' END AS kind
FROM {part}
"""

IMAGES = """
SELECT s_suppkey AS image_id, CAST(96 AS INT) AS w, CAST(64 AS INT) AS h FROM {supplier}
"""

# A drawn scene per image: 8x8 ground patches, a road strip with vehicles and a dark
# drain beside it, roofs with a courtyard or a solar panel, a pond.
PIXELS = """
SELECT image_id, w, h, y, x,
  CAST(CASE t WHEN 0 THEN 60 WHEN 1 THEN 60 WHEN 2 THEN 150 WHEN 3 THEN 200 WHEN 4 THEN 20 WHEN 5 THEN 190 WHEN 6 THEN 30 WHEN 7 THEN 230 WHEN 8 THEN 160 ELSE 96 END + v AS INT) AS r,
  CAST(CASE t WHEN 0 THEN 140 WHEN 1 THEN 90 WHEN 2 THEN 120 WHEN 3 THEN 200 WHEN 4 THEN 22 WHEN 5 THEN 120 WHEN 6 THEN 50 WHEN 7 THEN 230 WHEN 8 THEN 150 ELSE 180 END + v AS INT) AS g,
  CAST(CASE t WHEN 0 THEN 50 WHEN 1 THEN 160 WHEN 2 THEN 95 WHEN 3 THEN 198 WHEN 4 THEN 24 WHEN 5 THEN 70 WHEN 6 THEN 95 WHEN 7 THEN 228 WHEN 8 THEN 140 ELSE 70 END + v AS INT) AS b
FROM (
  SELECT image_id, w, h, y, x, CAST((x * 3 + y * 5 + image_id) % 4 AS BIGINT) AS v,
    CASE
      WHEN y BETWEEN ry AND ry + 6 THEN CASE WHEN (x + image_id * 5) % 24 < 5 AND y BETWEEN ry + 2 AND ry + 4 THEN 7 ELSE 2 END
      WHEN y BETWEEN ry + 7 AND ry + 9 THEN 4
      WHEN (x - px) * (x - px) + (y - py) * (y - py) < 110 THEN 1
      WHEN patch % 11 IN (0, 1) THEN CASE
        WHEN patch % 3 = 0 AND x % 8 BETWEEN 3 AND 4 AND y % 8 BETWEEN 3 AND 4 THEN 4
        WHEN patch % 3 = 1 AND x % 8 BETWEEN 2 AND 6 AND y % 8 BETWEEN 2 AND 5 THEN 6 ELSE 3 END
      WHEN patch % 11 = 2 THEN 5
      WHEN patch % 11 = 3 THEN 8
      WHEN patch % 11 IN (4, 5) THEN 9
      ELSE 0 END AS t
  FROM (
    SELECT s_suppkey AS image_id, CAST(96 AS INT) AS w, CAST(64 AS INT) AS h, CAST(y AS INT) AS y, CAST(x AS INT) AS x,
      8 + (s_suppkey * 7) % 40 AS ry, 12 + (s_suppkey * 29) % 72 AS px, 10 + (s_suppkey * 17) % 44 AS py,
      (s_suppkey * 53 + CAST(floor(x / 8) AS BIGINT) * 97 + CAST(floor(y / 8) AS BIGINT) * 61 + CAST(floor(x / 16) AS BIGINT) * CAST(floor(y / 16) AS BIGINT) * 7) % 977 AS patch
    FROM {supplier} {grid_yx}
  ) a
) s
"""

_SPARK_GRIDS = {
    "grid_k": "LATERAL VIEW explode(sequence(0, 3)) gk AS k",
    "grid_yx": f"LATERAL VIEW explode(sequence(0, {IMAGE_H - 1})) gy AS y LATERAL VIEW explode(sequence(0, {IMAGE_W - 1})) gx AS x",
}
_OTHER_GRIDS = {
    "grid_k": ", range(4) AS gk(k)",
    "grid_yx": f", range({IMAGE_H}) AS gy(y), range({IMAGE_W}) AS gx(x)",
}
_TABLES = ("supplier", "orders", "lineitem", "events", "part")


def sql_text(template: str) -> str:
    """The relation's text for an engine where the tables are plain views."""
    return template.format(**{t: t for t in _TABLES}, **_OTHER_GRIDS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def relation(spark: SparkSession, sf_dir: str, template: str, tables: dict | None = None) -> DataFrame:
    for name, text in _SPARK_GRIDS.items():
        template = template.replace("{" + name + "}", text)
    used = {t: (tables or {}).get(t) or table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in template}
    return spark.sql(template, **used)


def parts_of(spark: SparkSession, sf_dir: str, name: str) -> int | None:
    """Partitions for a shuffle of the rows of a table, counted in its footers."""
    return parts_for(spark, spark.read.parquet(f"{sf_dir}/{name}.parquet").count())


def lines(spark: SparkSession, sf_dir: str, template: str, order: list[str], name: str) -> DataFrame:
    """A relation over ``lineitem`` with its rows numbered in every image, in ``order``.

    Rows meet by image as the table has them, before the relation widens them, and stay dealt out by image. Images with
    more rows than a task should sort are numbered by buckets.
    """
    scan = table(spark, sf_dir, "lineitem")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    parts = parts_for(spark, rows)

    def whole(t: DataFrame) -> DataFrame:
        # a given number stays as it is; without one, small tables end in few tasks
        number = [max(-(-rows // LINE_ROWS), 4 * (parts or 0), spark.sparkContext.defaultParallelism)] if parts or rows > LINE_ROWS else []
        t = t.repartition(*number, "l_orderkey")
        rank = F.row_number().over(Window.partitionBy("image_id").orderBy(*order))
        return relation(spark, sf_dir, template, {"lineitem": t}).withColumn(name, rank)

    many = crowded(scan, ["l_orderkey"], rows)
    if many is None:
        return whole(scan)
    large = relation(spark, sf_dir, template, {"lineitem": scan.where(many)})
    return whole(scan.where(~many)).unionByName(numbered(large, ["image_id"], F.col("l_linenumber"), order, name, parts=parts))


def boxes(spark, sf_dir) -> DataFrame:
    df = lines(spark, sf_dir, BOXES, ["l_linenumber", "l_partkey", "l_suppkey", "x2", "y2", "conf"], "box_idx")
    return df.drop("l_linenumber", "l_partkey", "l_suppkey")


def raw_assets(spark, sf_dir) -> DataFrame:
    """Loosely typed asset records: texts for numbers, partial boxes, short polygons."""
    df = lines(spark, sf_dir, RAW_ASSETS, ["l_linenumber", "l_partkey", "l_suppkey", "bx1", "by1", "estimated_area_sq_m", "estimated_coverage_percent"], "asset_idx")
    pts = F.array(*[
        F.struct((F.col("px") + dx).cast("string").alias("x"), (F.col("py") + dy).cast("string").alias("y"))
        for dx, dy in ((0, 0), (9, 1), (7, 8), (-3, 6))
    ])
    return df.select(
        "image_id", "asset_idx", "unique_id", "category", "subcategory", "subtype", "confidence_percent",
        "estimated_count", "estimated_area_sq_m",
        F.struct(F.col("estimated_count").alias("length"), F.col("estimated_area_sq_m").alias("width")).alias("estimated_dimensions_m"),
        "estimated_coverage_percent", "condition_status", "maintenance_priority",
        F.struct(F.col("px").cast("string").alias("x"), F.col("py").cast("string").alias("y")).alias("center_coordinates"),
        F.struct(*[F.col(a).cast("string").alias(n) for a, n in
                   (("bx0", "x_min"), ("by0", "y_min"), ("bx1", "x_max"), ("by1", "y_max"))]).alias("bounding_box"),
        F.slice(pts, F.lit(1), F.col("n_points")).alias("polygon_coordinates"),
        F.lit(None).cast("string").alias("visual_description"), F.lit(None).cast("string").alias("estimation_basis"),
        F.lit(None).cast("string").alias("shadow_length_pixels"), F.lit(None).cast("string").alias("shadow_length_meters"),
        F.when(F.col("n_points") > 1, F.col("estimated_count")).alias("estimated_height_meters"),
    )


def shadows(spark, sf_dir) -> DataFrame:
    return relation(spark, sf_dir, SHADOWS)


def frames(spark, sf_dir) -> DataFrame:
    df = relation(spark, sf_dir, FRAMES)
    return numbered(df, ["video_id"], F.unix_date(F.to_date("ts")), ["ts", "event_id"], "frame_idx").drop("event_id")


def responses(spark, sf_dir) -> DataFrame:
    return relation(spark, sf_dir, RESPONSES)


def files(spark, sf_dir) -> DataFrame:
    return relation(spark, sf_dir, FILES)


def images(spark, sf_dir) -> DataFrame:
    return relation(spark, sf_dir, IMAGES)


def pixels(spark, sf_dir) -> DataFrame:
    """An image is 6144 pixels and 128 words: what a task gathers of 2000 images fits its memory, however many there are."""
    images = spread(spark.read.parquet(f"{sf_dir}/supplier.parquet"), 2000)
    return relation(spark, sf_dir, PIXELS, {"supplier": images})
