"""What the third review found."""
import datetime

from pyspark.sql import functions as F

from terratally.operators import masks as M, raster as R
from terratally import session
from terratally.operators import assets as A, frames as V
from terratally.sources import fixtures as X
from terratally.session import new_dir
from terratally.streaming import video as ST
from tests.test_raster import blobs, box, raster, words_of
from tests.test_streams import FRAMES, NAMES, START, arrive, arriving, plain, state_rows


def test_a_chain_of_filters_is_one_array_job(spark):
    """Plans stay short however many filters follow each other; images of different sizes meet in one call."""
    small, wide = blobs(5, (1, 9, 70), 0.6), blobs(6, (2, 20, 130), 0.6)
    words = words_of(spark, {"m": small}).withColumn("image_id", F.lit(7).cast("bigint")).unionByName(words_of(spark, {"m": wide}))
    df = R.core(R.combine(R.clean(R.banded(words, ["m"], 32, 6), {"m": 5}), inv="~{m}", both="{m} | ~{m}"), ["m", "both"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("MapInPandas") == 1
    got = df.cache()
    for m, rows in ((small, got.where("image_id = 7").withColumn("image_id", F.lit(0))), (wide, got.where("image_id < 7"))):
        for kind, lo, hi in (("erode", -2, 2), ("dilate", -4, 4), ("erode", -2, 2)):
            m = box(m, lo, hi, kind)
        assert (raster(rows, "m", *m.shape) == m).all()


def test_gates_of_several_masks(spark):
    rows = [(i, 10, 10, m, k, 30) for i, m, n in ((1, "building", 2), (2, "building", 1), (2, "road", 1), (3, "vehicle", 3), (4, "vehicle", 2)) for k in range(n)]
    df = spark.createDataFrame(rows, "image_id bigint, w int, h int, mask string, comp_id bigint, n bigint")
    got = M._gated(df, {"building": {"at_least": 2, "over_percent": 0.05}, "road": {}, "vehicle": {"at_least": 3}})
    assert sorted((r.image_id, r.mask) for r in got.collect()) == [(1, "building")] * 2 + [(2, "road")] + [(3, "vehicle")] * 3


def test_state_of_many_videos_is_a_few_slots_of_open_frames(spark, monkeypatch):
    """The first batch leaves only what later batches may still add to; videos share a key and keep their own totals."""
    monkeypatch.setattr(ST, "SLOTS", 4)
    folder, out = new_dir(spark, "arriving"), new_dir(spark, "slots")
    rows = [(v, i, START + datetime.timedelta(minutes=10 * i + v), NAMES[(i + v) % 2], (i * v) % 3, float(i)) for i in range(1, 41) for v in range(1, 31)]
    for part in (rows[:600], rows[600:]):
        arrive(spark, folder, part, FRAMES)
        stats = ST.stream_video_stats(arriving(spark, folder, FRAMES), out + "/stats", "30 minutes")
        carry = ST.stream_carry_forward(arriving(spark, folder, FRAMES), 7, out + "/carry", "30 minutes")
        for p, extra in (("/stats", 0), ("/carry", 1)):
            held = [r.value for r in state_rows(spark, out + p).collect()]
            assert 0 < len(held) <= 4 and all(len(v.frame) <= (6 + extra) * len(v.video) for v in held)
    batch = spark.createDataFrame(rows, FRAMES)
    want = V.video_totals_by_category(batch)
    assert plain(stats, want.columns) == plain(want, want.columns)
    want = V.carry_sampled(batch, (F.col("frame_idx") - 1) % 7 == 0)
    assert plain(carry, want.columns) == plain(want, want.columns)


def test_wide_rows_are_dealt_out_by_their_number(spark, monkeypatch):
    """A task sorts about TASK_ROWS rows, however many there are, and the numbers stay the same."""
    sf = "/root/testdata/sf0.001"
    images = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"))
    read = lambda: A.fallback_asset(images, A.fill_asset_defaults(X.raw_assets(spark, sf)), X.parts_of(spark, sf, "lineitem"))
    few = read()
    monkeypatch.setattr(session, "TASK_ROWS", 200)
    many = read()
    n = -(-X.table(spark, sf, "lineitem").count() // 200)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions")) and many.rdd.getNumPartitions() >= 2 * n
    cols = ["image_id", "asset_idx", "unique_id", "category", "estimated_count"]
    assert plain(few, cols) == plain(many, cols)
