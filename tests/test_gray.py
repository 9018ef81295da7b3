"""Gray-value filters and spatial joins against plain loops."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from terratally.operators import graylevel as GL, masks as M, spatial as SP
from tests.test_raster import flood, raster


def pixel_df(spark, img):
    n, h, w = img.shape
    rows = [(i, w, h, y, x, int(img[i, y, x]), int(img[i, y, x]), int(img[i, y, x])) for i in range(n) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id bigint, w int, h int, y int, x int, r int, g int, b int")


def scene(seed, h=40, w=90):
    rng = np.random.default_rng(seed)
    img = rng.integers(60, 80, (2, h, w))
    img[:, 10:25, 20:50] += 120
    img[:, 5:30, 60:64] = 5
    return img


def canny(img, low, high):
    h, w = img.shape
    p = np.pad(img.astype(int), 1, mode="edge")
    mag, dirs = np.zeros((h + 2, w + 2), int), {}
    for y in range(h):
        for x in range(w):
            a = p[y:y + 3, x:x + 3]
            dx = int(a[0, 2] + 2 * a[1, 2] + a[2, 2] - a[0, 0] - 2 * a[1, 0] - a[2, 0])
            dy = int(a[2, 0] + 2 * a[2, 1] + a[2, 2] - a[0, 0] - 2 * a[0, 1] - a[0, 2])
            mag[y + 1, x + 1], dirs[y, x] = abs(dx) + abs(dy), (dx, dy)
    weak, strong = np.zeros((h, w), bool), np.zeros((h, w), bool)
    for (y, x), (dx, dy) in dirs.items():
        m, c = mag[y + 1, x + 1], mag[y:y + 3, x:x + 3]
        if m <= low:
            continue
        ratio = abs(dy) * 32768
        if ratio < abs(dx) * 13573:
            keep = m > c[1, 0] and m >= c[1, 2]
        elif ratio > abs(dx) * (13573 + 65536):
            keep = m > c[0, 1] and m >= c[2, 1]
        elif (dx < 0) == (dy < 0):
            keep = m > c[0, 0] and m > c[2, 2]
        else:
            keep = m > c[0, 2] and m > c[2, 0]
        weak[y, x] = keep
        strong[y, x] = keep and m > high
    lab = flood(weak, 8)
    return weak & np.isin(lab, np.unique(lab[strong]))


@pytest.mark.parametrize("tile", [512, 64])
def test_edges(spark, tile, monkeypatch):
    monkeypatch.setattr(GL, "TILE", tile)
    img = scene(1)
    got = raster(GL.edge_map(pixel_df(spark, img)).withColumnRenamed("bits", "e"), "e", *img.shape)
    for i in range(len(img)):
        assert (got[i] == canny(img[i], 60, 160)).all()


@pytest.mark.parametrize("tile", [512, 64])
def test_dark(spark, tile, monkeypatch):
    monkeypatch.setattr(GL, "TILE", tile)
    img = scene(2)
    got = raster(GL.local_mean_threshold(pixel_df(spark, img), 31, 7), "dark", *img.shape)
    w = GL.gauss_weights(31)
    for i, a in enumerate(img):
        p = np.pad(a, 2, mode="reflect")
        k = np.outer([1, 4, 6, 4, 1], [1, 4, 6, 4, 1])
        h, wd = a.shape
        bl = np.array([[((p[y:y + 5, x:x + 5] * k).sum() + 128) >> 8 for x in range(wd)] for y in range(h)])
        q = np.pad(bl, 15, mode="edge").astype(np.int64)
        kk = np.outer(w, w)
        mean = np.array([[((q[y:y + 31, x:x + 31] * kk).sum() + (1 << 31)) >> 32 for x in range(wd)] for y in range(h)])
        assert (got[i] == (bl - mean <= -7)).all()


def test_rect_join(spark):
    rng = np.random.default_rng(5)

    def rects(n, big):
        x, y = rng.uniform(-50, 3000, n), rng.uniform(-50, 3000, n)
        s = rng.choice([2, 30, 200, 900, big], n)
        return [(int(rng.integers(0, 2)), i, float(a), float(b), float(a + c), float(b + c / 2)) for i, (a, b, c) in enumerate(zip(x, y, s))]

    left, right = rects(120, 5000), rects(150, 2600)
    cols = lambda p: f"k int, {p} int, {p}_x0 double, {p}_y0 double, {p}_x1 double, {p}_y1 double"
    got = sorted((r.k, r.l, r.r) for r in SP.rect_join(spark.createDataFrame(left, cols("l")), spark.createDataFrame(right, cols("r")), ["k"]).collect())
    want = sorted((a[0], a[1], b[1]) for a in left for b in right
                  if a[0] == b[0] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5])
    assert got == want


def test_video_gates(spark):
    rows = [(1, 1, "vehicle", 5, 10, 10)] * 2 + [(2, i, "vehicle", 5, 10, 10) for i in range(3)]
    df = spark.createDataFrame(rows, "image_id int, comp_id int, mask string, n int, w int, h int")
    assert {r.image_id for r in M.stage_gates(df, "vehicle", 3).collect()} == {2}
    assert M.stage_gates(df, "vehicle", 3, 20.0).count() == 0
