"""Filled masks and outer regions over tiles: nested rings, islands in holes, spirals, noise."""
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame, functions as F

from terratally.operators import raster as R, regions as G
from tests.test_raster import blobs, filled, flood, words_of


def rings(h, w, gap=2, shift=0):
    y, x = np.mgrid[:h, :w]
    d = np.minimum(np.minimum(y, h - 1 - y), np.minimum(x, w - 1 - x)) - shift
    return (d >= 0) & (d % (2 * gap) < gap)


def spiral(n):
    m = np.zeros((n, n), bool)
    y = x = 0
    dy, dx = 0, 1
    m[0, 0] = True
    while True:
        ahead = lambda k: (0 <= y + dy * k < n and 0 <= x + dx * k < n and m[y + dy * k, x + dx * k])
        if not (0 <= y + dy < n and 0 <= x + dx < n) or ahead(2):
            dy, dx = dx, -dy
            if not (0 <= y + dy < n and 0 <= x + dx < n) or m[y + dy, x + dx] or ahead(2):
                return m
        y, x = y + dy, x + dx
        m[y, x] = True


SCENES = {
    "rings": np.stack([rings(40, 200), rings(40, 200, 1, 1)]),
    "islands": np.stack([rings(40, 200, 3, 2) ^ (blobs(1, (40, 200), 0.05)), rings(40, 200, 4) & ~blobs(2, (40, 200), 0.01)]),
    "noise": blobs(7, (2, 40, 200), 0.55),
    "all and nothing": np.stack([np.ones((40, 200), bool), np.zeros((40, 200), bool)]),
    "giant hole": np.stack([rings(40, 200, 1, 0) & ~rings(40, 200, 1, 2) | (np.pad(np.zeros((38, 198), bool), 1, constant_values=True)), np.pad(np.ones((36, 196), bool), 2)]),
    "spiral": np.stack([spiral(70), ~spiral(70)]),
    "one row": blobs(3, (2, 1, 130), 0.5),
}


@pytest.mark.parametrize("tiles", [(1024, 16), (6, 1)])
def test_enclosure(spark, tiles):
    images = {10 * k + i: m[i] for k, m in enumerate(SCENES.values()) for i in range(2)}
    parts = [words_of(spark, {"m": m}).withColumn("image_id", F.col("image_id") + 10 * k) for k, m in enumerate(SCENES.values())]
    long = R.long_masks(reduce(DataFrame.unionByName, parts), ["m"])
    full = {i: filled(a) for i, a in images.items()}
    solid = {i: np.zeros(a.shape, bool) for i, a in images.items()}
    for r in G.pieces(G.fill_holes(long, *tiles)).collect():
        solid[r.image_id][r.y, r.x0:r.x1 + 1] = True
    labels = {i: np.full(a.shape, -1) for i, a in images.items()}
    for r in G.labelled_regions(long, False, *tiles).collect():
        assert (labels[r.image_id][r.y, r.x0:r.x1 + 1] == -1).all()
        labels[r.image_id][r.y, r.x0:r.x1 + 1] = r.lab
    for i, a in full.items():
        assert (solid[i] == a).all() and (labels[i] == flood(a, 8)).all(), i
