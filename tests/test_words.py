"""Words made of pixels: how long the compiled methods are, and the gray values in lanes."""
import numpy as np
import pytest

from terratally.operators import graylevel as GL, raster as R
from terratally.session import spread
from terratally.sources import fixtures as X
from tests.test_gray import pixel_df, scene

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("mode", ["map", "video"])
def test_bands_stay_below_the_method_limit(spark, mode):
    """The JVM does not compile methods of more than 8000 bytes; the video bands had one of 8610."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = R.band_words(X.pixels(spark, SF), mode)._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) < 8000


@pytest.mark.parametrize("width", [90, 130])
def test_gray_words_hold_every_pixel(spark, width):
    img = scene(3, 12, width)
    rows = GL.gray_words(pixel_df(spark, img), R.bands_of("map")).collect()
    assert len(rows) == len(img) * 12 * -(-width // 64)
    got = np.zeros((len(img), 12, -(-width // 64) * 64), np.uint8)
    for r in rows:
        got[r.image_id, r.y, r.xb * 64:r.xb * 64 + 64] = np.array([r[c] for c in GL.LANES], "<i8").view(np.uint8)
    assert (got[:, :, :width] == img).all() and not got[:, :, width:].any()


def test_partitions_hold_few_rows(spark):
    scan = spark.read.parquet(f"{SF}/orders.parquet")
    n = scan.count()
    assert spread(scan, 100).rdd.getNumPartitions() >= n // 100
    assert spread(scan, n).rdd.getNumPartitions() == spread(scan).rdd.getNumPartitions()
