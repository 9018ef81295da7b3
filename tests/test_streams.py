"""Streams in several starts and batches against the batch results; the upsert table."""
import datetime

import pytest
from pyspark.sql import functions as F

from terratally.operators import frames as V
from terratally.session import new_dir
from terratally.streaming import video as ST
from terratally.streaming.upsert import UpsertTable

FRAMES = "video_id bigint, frame_idx int, ts timestamp, category string, cnt int, area_px double"
START = datetime.datetime(2024, 1, 1)
NAMES = ["Water Bodies", "Solar Panels"]


def arriving(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def plain(df, cols):
    return sorted(map(str, df.select(cols).collect()))


def test_streams_resume_and_equal_the_batch(spark, monkeypatch):
    """Batches out of order within the lateness, blocks of few frames, a restart between, frames without observations."""
    monkeypatch.setattr(ST, "BLOCK", 8)
    folder, out = new_dir(spark, "arriving"), new_dir(spark, "streams")
    rows = [(v, i, START + datetime.timedelta(minutes=i), NAMES[(i + k) % 2], (i * v) % 3, float(i + k)) for v in (1, 2) for i in range(1, 31) for k in range(1 + i % 2)]
    rows += [(3, i, START + datetime.timedelta(minutes=i), None, 0, 0.0) for i in (1, 4, 5)] + [(4, 7, START + datetime.timedelta(minutes=7), "elsewhere", 5, None)]
    rows[0], rows[40] = rows[40], rows[0]

    def run():
        s = lambda: arriving(spark, folder, FRAMES)
        return {
            "stats": ST.stream_video_stats(s(), out + "/stats"), "windows": ST.stream_window_stats(s(), "10 minutes", "1 day", out + "/windows"),
            "sample": ST.stream_sample(s(), 3, out + "/sample"), "carry": ST.stream_carry_forward(s(), 3, out + "/carry")}

    parts = [rows[:25], rows[50:], rows[25:50]]
    for p in parts[:2]:
        arrive(spark, folder, p, FRAMES)
    run()
    arrive(spark, folder, parts[2], FRAMES)
    got = run()
    batch = spark.createDataFrame(rows, FRAMES)
    hit = (F.col("frame_idx") - 1) % 3 == 0
    expected = {
        "stats": V.video_totals_by_category(batch), "sample": batch.where(hit), "carry": V.carry_sampled(batch, hit),
        "windows": batch.groupBy(F.window("ts", "10 minutes").alias("w"), "category").agg(F.sum("cnt").alias("count"), F.sum("area_px").alias("area_sum"), F.count(F.lit(1)).alias("frames")).select(
            F.col("w.start").alias("window_start"), "category", "count", "area_sum", "frames")}
    for k, df in expected.items():
        assert plain(got[k], df.columns) == plain(df, df.columns), k
    # nothing new: the same results again
    again = run()
    for k, df in expected.items():
        assert plain(again[k], df.columns) == plain(df, df.columns), k


def state_rows(spark, path):
    return spark.read.format("statestore").option("path", path + "-state").option("stateVarName", "frames").load()


def test_state_ends_with_the_watermark(spark):
    """A long video in many batches: the state keeps the last frames only, and the results are those of the batch."""
    folder, out = new_dir(spark, "arriving"), new_dir(spark, "long")
    frame = lambda i: (1, i, START + datetime.timedelta(minutes=10 * i), NAMES[i % 2], i % 4, float(i))
    rows = [frame(i) for i in range(1, 121)]
    kept = []
    for a in range(0, 120, 40):
        arrive(spark, folder, rows[a:a + 40], FRAMES)
        stats = ST.stream_video_stats(arriving(spark, folder, FRAMES), out + "/stats", "2 hours")
        carry = ST.stream_carry_forward(arriving(spark, folder, FRAMES), 7, out + "/carry", "2 hours")
        kept.append([len(r.value.frame) for p in ("/stats", "/carry") for r in state_rows(spark, out + p).collect()])
    assert max(map(max, kept[1:])) <= 41 + 13  # the last batch and what the watermark left before it
    batch = spark.createDataFrame(rows, FRAMES)
    want = V.video_totals_by_category(batch)
    assert plain(stats, want.columns) == plain(want, want.columns)
    want = V.carry_sampled(batch, (F.col("frame_idx") - 1) % 7 == 0)
    assert plain(carry, want.columns) == plain(want, want.columns)


def test_pause_longer_than_the_lateness(spark):
    """A key that was cleared goes on: its frames look back to what it passed on before."""
    folder, out = new_dir(spark, "arriving"), new_dir(spark, "paused")
    at = lambda i: START + datetime.timedelta(minutes=i)
    rows = [(1, 1, at(1), "Water Bodies", 4, 1.0), (1, 2, at(2), "Water Bodies", 9, 2.0)], [(2, 1, at(5000), "Solar Panels", 1, 1.0)], [(1, 3, at(9000), "Solar Panels", 2, 5.0), (1, 4, at(9001), "Solar Panels", 3, 6.0)]
    for part in rows:
        arrive(spark, folder, part, FRAMES)
        stats = ST.stream_video_stats(arriving(spark, folder, FRAMES), out + "/stats")
        carry = ST.stream_carry_forward(arriving(spark, folder, FRAMES), 3, out + "/carry")
    got = {(r.video_id, r.frame_idx): (r.sampled, r.category, r.cnt) for r in carry.collect()}
    water = "Water Bodies"
    assert got == {(1, 1): (True, water, 4), (1, 2): (False, water, 4), (1, 3): (False, water, 4), (1, 4): (True, "Solar Panels", 3), (2, 1): (True, "Solar Panels", 1)}
    assert {(r.video_id, r.category): (r.frames, r["count"], r.presence) for r in stats.where("count > 0").collect()} == {
        (1, water): (4, 13, 2), (1, "Solar Panels"): (4, 5, 2), (2, "Solar Panels"): (1, 1, 1)}


def test_late_rows_are_dropped(spark):
    folder, out = new_dir(spark, "arriving"), new_dir(spark, "late")
    for i, minute in ((50, 500), (60, 600), (1, 1)):
        arrive(spark, folder, [(1, i, START + datetime.timedelta(minutes=minute), "Water Bodies", 1, 1.0)], FRAMES)
        stats = ST.stream_video_stats(arriving(spark, folder, FRAMES), out + "/stats")
    assert stats.where("category = 'Water Bodies'").first().frames == 2


def test_empty_stream(spark):
    folder, out = new_dir(spark, "arriving"), new_dir(spark, "none")
    arrive(spark, folder, [], FRAMES)
    assert ST.stream_video_stats(arriving(spark, folder, FRAMES), out + "/stats").count() == 0
    assert ST.stream_carry_forward(arriving(spark, folder, FRAMES), 2, out + "/carry").count() == 0


# ---- ingest

ARRIVALS = "response_id bigint, ts timestamp, raw_text string, kind string, mode string, content_type string, filename string, size_bytes bigint"


def arrival(i, minute, text="{}", kind="image", mode="block_analysis", typ="image/png", name="a.png", size=10):
    return (i, START + datetime.timedelta(minutes=minute), text, kind, mode, typ, name, size)


def test_ingest_gate_and_winners(spark):
    folder, out = new_dir(spark, "arriving"), new_dir(spark, "ingested")
    batches = [
        [arrival(1, 5, '{"a": 1}'), arrival(2, 5, '{"a": 2}'), arrival(3, 5, typ="image/gif"), arrival(4, 5, size=0), arrival(5, 5, size=60 << 20),
         arrival(6, 5, mode="x"), arrival(7, 5, kind="video", typ="text/plain", name="a.txt"), arrival(8, 5, "no json"),
         arrival(9, 5, '{"a": "older"}'), arrival(9, 6, '{"a": "newer"}'), arrival(10, 5, '{"a": "x"}'), arrival(10, 5, '{"a": "y"}')],
        [arrival(1, -90 * 1440, '{"a": "old but later"}'), arrival(2, 9, typ="image/gif"), arrival(3, 9, '{"a": 3}')]]
    for part in batches:
        arrive(spark, folder, part, ARRIVALS)
        got = ST.stream_ingest(arriving(spark, folder, ARRIVALS), out)
    rows = {r.response_id: (r.status, r.http_code, r.document) for r in got.collect()}
    assert rows == {
        1: ("accepted", 200, '{"a":"old but later"}'),  # the later batch
        2: ("accepted", 200, '{"a":2}'),  # a refused file does not displace it
        3: ("accepted", 200, '{"a":3}'), 4: ("empty_file", 400, None), 5: ("file_too_large", 413, None), 6: ("invalid_analysis_mode", 400, None),
        7: ("invalid_video_type", 400, None), 8: ("accepted", 200, None), 9: ("accepted", 200, '{"a":"newer"}'), 10: ("accepted", 200, '{"a":"y"}')}
    assert got.where("response_id = 8").first().parse_warning is not None and got.where("response_id = 4").first().parse_warning is None


def test_upsert_table_compacts(spark):
    path, schema = new_dir(spark, "upserts"), spark.createDataFrame([], "k bigint, v string").schema
    t = lambda: UpsertTable(spark, path, schema, ["k"], buckets=8, compact_after=3)
    want = {}
    for batch in range(8):
        rows = [(k, f"{batch}-{k}") for k in ([batch, 100] if batch < 6 else [0])]
        want.update(rows)
        t().add(spark.createDataFrame(rows, schema), batch)
        assert {r.k: r.v for r in t().read().collect()} == want, batch
    m = t().manifest()
    assert m["merged"] == 5 and m["open"] == [6, 7] and len(set(m["buckets"].values())) > 1  # untouched buckets keep their files
    t().add(spark.createDataFrame([(0, "repeated")], schema), 2)  # merged long ago
    t().add(spark.createDataFrame([(0, "7-0")], schema), 7)  # a batch that is run again
    assert {r.k: r.v for r in t().read().collect()} == want
    before = t().read()
    t().compact()
    assert t().manifest()["open"] == [] and {r.k: r.v for r in t().read().collect()} == want == {r.k: r.v for r in before.collect()}
    t().compact()
    folder = t().folder
    assert len([n for n in folder.names("manifest") if n.isdigit()]) == 2 and set(folder.names("batches")) <= {"6", "7"}


def test_two_writers_do_not_overwrite(spark):
    schema = spark.createDataFrame([], "k bigint").schema
    t = UpsertTable(spark, new_dir(spark, "upserts"), schema, ["k"])
    m = t.manifest()
    t.publish(m)
    with pytest.raises(OSError):
        t.publish(m)
