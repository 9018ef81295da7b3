"""Frame and response streams on Structured Streaming."""
from __future__ import annotations

import re
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from terratally.operators import frames as V, responses as P
from terratally.operators.ranking import carry_last
from terratally.operators.stats import NAMES, _unpivot
from terratally.session import new_dir, ship_package
from terratally.sources import ingest
from terratally.streaming.state import CarrySampled, RunningTotals
from terratally.streaming.upsert import UpsertTable

#: Frame numbers of a block: a long video is several keys.
BLOCK = 65536
#: Keys of a stream's state, each with many videos. Part of the layout: a path goes on with the number it began with.
SLOTS = 512
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that keyed state with timers needs, for the queries started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def append_table(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Run the stream over what is available and return the table that it appends to.

    ``path`` names the table; its state lies beside it. The same path on the next start goes on where the last one
    ended. Without a path the stream starts afresh in a new folder.
    """
    spark = stream.sparkSession
    path = path or new_dir(spark, label)
    q = (stream.writeStream.outputMode("append").format("parquet").option("path", path)
         .option("checkpointLocation", path + "-state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, path: str, mode: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run the stream over what is available; batches already taken in are not read again."""
    with keyed_state(stream.sparkSession):
        q = (stream.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", path + "-state").trigger(availableNow=True).start())
        q.awaitTermination()


def upsert_table(stream: DataFrame, keys: list[str], label: str, path: str | None = None, mode: str = "update", **rules) -> DataFrame:
    """Run the stream and return the latest row per key, over all starts with the same path.

    ``rules``: ``prefer`` and ``order`` of the UpsertTable, which say which of several rows stays.
    """
    path = path or new_dir(stream.sparkSession, label)
    table = UpsertTable(stream.sparkSession, path, stream.schema, keys, **rules)
    run_batches(stream, path, mode, table.add)
    return table.read()


def _block():
    return F.floor((F.col("frame_idx") - 1) / BLOCK).cast("int")


def _slot(part: str):
    return F.pmod(F.xxhash64("video_id", part), F.lit(SLOTS)).cast("int")


def _millis(spark: SparkSession, late: str) -> int:
    """Lateness in milliseconds; the watermark counts a month as 31 days."""
    ms = spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL '{late}')").first()[0]
    return ms * 11 // 10 if re.search("month|year", late.lower()) else ms


def stream_video_stats(frames: DataFrame, path: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts, areas and presence per video and category; a frame counts once, whatever it shows.

    The running totals of a block of BLOCK frame numbers lie in keyed state, SLOTS keys for all videos, and single frames
    beside them until they are ``late`` behind the newest ``ts``; rows that come later than the watermark are dropped. When
    all of a block is closed, its totals are a row of the table, and a block that goes on later starts another. Rows of a
    frame share their ``ts``.
    """
    ship_package(frames.sparkSession)
    keyed = (frames.withColumn("part", _block()).withWatermark("ts", late).withColumn("ms", F.unix_millis("ts")).withColumn("slot", _slot("part")).groupBy("slot")
             .transformWithState(RunningTotals(_millis(frames.sparkSession, late)), RunningTotals.OUT, "Update", "EventTime"))
    rows = upsert_table(keyed, ["video_id", "part", "first"], "video-stats", path)
    sums = [F.sum("frames").alias("frames")]
    for i in range(len(NAMES)):
        sums += [F.sum(F.col(c)[i]).alias(f"{name}_{i + 1}") for c, name in (("counts", "count"), ("areas", "area_sum"), ("present", "presence"))]
    return _unpivot(rows.groupBy("video_id").agg(*sums), ["video_id", "frames"], ["count", "area_sum", "presence"])


def stream_window_stats(frames: DataFrame, window: str = "1 day", late: str = "1 hour", path: str | None = None) -> DataFrame:
    """The same sums per event-time window and category, open windows included; rows later than ``late`` are dropped."""
    agg = (frames.withWatermark("ts", late).groupBy(F.window("ts", window), "category")
           .agg(F.sum("cnt").alias("count"), F.sum("area_px").alias("area_sum"), F.count(F.lit(1)).alias("frames")))
    agg = agg.select(F.col("window.start").alias("window_start"), "category", "count", "area_sum", "frames")
    return upsert_table(agg, ["window_start", "category"], "windows", path)


def stream_sample(frames: DataFrame, stride: int, path: str | None = None) -> DataFrame:
    """Frame 1 and every ``stride``-th after it."""
    return append_table(frames.where((F.col("frame_idx") - 1) % stride == 0), "sampled", path)


def stream_carry_forward(frames: DataFrame, stride: int, path: str | None = None, late: str = "1 hour") -> DataFrame:
    """All frames so far; those not sampled show the observations of the last sampled frame of their video.

    Keyed state, SLOTS keys for all videos, holds the frames of a block of BLOCK frame numbers until they are ``late`` behind
    the newest ``ts``, and the sampled frame before them, so batches may come in any order within that time; later rows are dropped. ``ts`` must rise
    with the frame number inside a video. What a block passes on to the next ones is one row of a second, short table:
    only frames before the first sampled one of their block look there, when the result is read.
    """
    spark = frames.sparkSession
    ship_package(spark)
    path = path or new_dir(spark, "carried")
    keyed = (frames.withColumn("block", _block()).withWatermark("ts", late).withColumn("ms", F.unix_millis("ts")).withColumn("slot", _slot("block")).groupBy("slot")
             .transformWithState(CarrySampled(stride, _millis(spark, late)), CarrySampled.OUT, "Update", "EventTime"))
    rows_schema, tails_schema = (T.StructType([f for f in keyed.schema.fields if f.name not in gone]) for gone in (("tail", "first"), ("tail", "sampled", "known")))
    rows = UpsertTable(spark, path + "/rows", rows_schema, ["video_id", "frame_idx"])
    tails = UpsertTable(spark, path + "/tails", tails_schema, ["video_id", "first"], order=["frame_idx"])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        rows.add(batch.where("NOT tail"), batch_id)
        tails.add(batch.where("tail"), batch_id)
        batch.unpersist()

    run_batches(keyed, path, "update", write)
    done, cols = rows.read(), ["video_id", "frame_idx", "sampled", "seen"]
    asking = done.where("NOT known").select("video_id", "frame_idx", F.col("sampled"), "seen")
    sources = tails.read().select("video_id", "frame_idx", F.lit(None).cast("boolean").alias("sampled"), "seen")
    filled = carry_last(asking.unionByName(sources), ["video_id"], "frame_idx", ["seen"]).where("sampled IS NOT NULL").select(cols)
    out = done.where("known").select(cols).unionByName(filled)
    return out.select("video_id", "frame_idx", "sampled", F.explode_outer("seen").alias("_o")).select(
        "video_id", "frame_idx", "sampled", *[F.col("_o")[c].alias(c) for c in V.OBSERVATION])


def stream_ingest(arrivals: DataFrame, path: str | None = None) -> DataFrame:
    """Uploaded files and their responses through the gate and the parser, one row per ``response_id``.

    ``arrivals``: the columns of the gate (kind, mode, content_type, filename, size_bytes), response_id, ts and raw_text.
    Refused files come out with their status and code and without a document. Of several rows of an id, an accepted one
    stays before refused ones, then the one of the later batch, then (within a batch) the one with the newest ``ts``, then
    the largest of the remaining columns. However old a row is, none is dropped.
    """
    gated = ingest.ingest_gate(arrivals)
    parsed = P.parse_response(gated, "ts", "status", "http_code")
    ok = F.col("status") == "accepted"
    rows = parsed.select("response_id", "ts", "status", "http_code", ok.alias("accepted"), F.when(ok, F.col("parse_warning")).alias("parse_warning"),
                         F.when(ok, F.to_json("doc")).alias("document"))
    return upsert_table(rows, ["response_id"], "ingested", path, mode="append", prefer=["accepted"], order=["ts"])


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Stream over the files called ``name`` in a folder, with the schema found there."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
