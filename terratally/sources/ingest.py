"""Entry gate for files, media kinds, saved results, and readers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terratally import fixed_values as K
from terratally.functions import clean as C


def extension(filename: Column) -> Column:
    """Last suffix in lower case with its dot, or an empty text."""
    return F.lower(F.regexp_extract(filename, r"[^./\\](\.[^./\\]+)$", 1))


def content_type(filename: Column) -> Column:
    """Media type that goes with a file's extension, or null."""
    known = [F.lit(x) for kv in K.TYPE_OF_EXTENSION.items() for x in kv]
    return F.create_map(*known)[extension(filename)]


def file_manifest(spark: SparkSession, path: str, mode: str = K.ANALYSIS_MODES[0]) -> DataFrame:
    """Names, types, kinds and sizes of the files under a path, ready for ``ingest_gate``; contents are not read.

    The type follows from the name, as the files carry none. Files that are no video are held to the image rules.
    """
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return meta.select(
        F.col("path").alias("file_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
        F.col("length").alias("size_bytes")).withColumn("content_type", content_type(F.col("filename"))).withColumn(
        "kind", F.when(F.coalesce("content_type", F.lit("")).startswith("video/"), "video").otherwise("image")).withColumn("mode", F.lit(mode))


def ingest_gate(files: DataFrame) -> DataFrame:
    """First failed check of each file as ``status`` and ``http_code``; passed files are ``accepted``.

    Columns used: kind (image or video), mode, content_type, filename, size_bytes.
    """
    image = F.col("kind") == "image"
    typ = F.coalesce("content_type", F.lit(""))
    ext = F.coalesce(F.nullif(extension(F.col("filename")), F.lit("")), F.lit(".mp4"))
    good_video = typ.isin(*K.VIDEO_TYPES) | ext.isin(*K.VIDEO_EXTENSIONS)
    limit = F.when(image, F.lit(K.MAX_IMAGE_BYTES)).otherwise(F.lit(K.MAX_VIDEO_BYTES))
    status = (
        F.when(image & ~F.coalesce(F.col("mode"), F.lit("")).isin(*K.ANALYSIS_MODES), "invalid_analysis_mode")
        .when(image & ~typ.isin(*K.IMAGE_TYPES), "invalid_image_type")
        .when(~image & ~good_video, "invalid_video_type")
        .when(F.coalesce("size_bytes", F.lit(0)) == 0, "empty_file")
        .when(F.col("size_bytes") > limit, "file_too_large")
        .otherwise("accepted"))
    code = F.when(F.col("status") == "accepted", 200).when(F.col("status") == "file_too_large", 413).otherwise(400)
    return files.withColumn("status", status).withColumn("http_code", code)


def media_kind(files: DataFrame) -> DataFrame:
    """``video`` or ``image`` by type prefix, else by extension; otherwise null."""
    typ = F.coalesce("content_type", F.lit(""))
    low = F.lower(F.coalesce("filename", F.lit("")))
    ends = lambda exts: F.regexp_like(low, F.lit("(" + "|".join("\\" + e for e in exts) + ")$"))
    is_video = typ.startswith("video/") | ends(K.VIDEO_EXTENSIONS)
    is_image = typ.startswith("image/") | ends(K.IMAGE_EXTENSIONS)
    return files.withColumn("media_kind", F.when(is_video, "video").when(is_image, "image"))


def explode_tiles(df: DataFrame, array: str, width: int, keys: list[str]) -> DataFrame:
    """Packed row-major arrays to (keys, y, x, v)."""
    pos = F.posexplode(array).alias("_pos", "v")
    return df.select(*keys, pos).select(
        *keys, F.floor(F.col("_pos") / width).cast("int").alias("y"), (F.col("_pos") % width).cast("int").alias("x"), "v")


def result_valid(results: DataFrame) -> Column:
    """Shape check on a saved result document (VARIANT column ``doc``)."""
    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get("doc", path, "variant")), F.lit("VOID"))

    filled = lambda path: ~kind(path).isin("VOID") & ~F.coalesce(
        F.try_variant_get("doc", path, "string"), F.lit("")).isin("", "0", "false")
    is_list = lambda path: kind(path).startswith("ARRAY")
    ok = (
        F.coalesce(F.schema_of_variant("doc"), F.lit("VOID")).startswith("OBJECT")
        & (kind("$.success") == "BOOLEAN") & F.coalesce(F.try_variant_get("doc", "$.success", "boolean"), F.lit(False))
        & filled("$.request_id") & filled("$.data") & filled("$.transformed")
        & is_list("$.data.detected_assets") & is_list("$.warnings"))
    return F.coalesce(ok, F.lit(False))


def latest_result(results: DataFrame, key: str) -> DataFrame:
    """Newest saved result per key that succeeded and has both data and transformed."""
    good = results.where(F.col("success") & F.col("has_data") & F.col("has_transformed"))
    return good.groupBy(key).agg(F.max(F.struct("ts", "result_id")).alias("m")).select(key, "m.result_id", "m.ts")


FRAME_SCHEMA = "video_id BIGINT, frame_idx INT, ts TIMESTAMP, category STRING, cnt INT, area_px DOUBLE"


def read_frames(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Frame observations from parquet, as a table or as a stream, with a fixed schema."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(FRAME_SCHEMA).parquet(path)


RESPONSE_SCHEMA = "response_id BIGINT, raw_text STRING"


def scan_responses(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Model responses: one per text file, named by its path, or with ``lines`` one JSON record per line."""
    if lines:
        return spark.read.schema(RESPONSE_SCHEMA).json(path)
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("response_id"), F.col("value").alias("raw_text"))
