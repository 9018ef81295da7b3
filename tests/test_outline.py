"""Outlines against border following pixel by pixel."""
import numpy as np
import pytest

from terratally.operators import outline as O, raster as R, regions as G
from tests.test_raster import blobs, filled, flood, words_of

AROUND = [(1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1)]  # east, then counterclockwise


def followed(m):
    """Corners of the outer border of the region in ``m``."""
    ys, xs = np.nonzero(m)
    x, y = int(xs[0]), int(ys[0])
    on = lambda x, y: 0 <= y < m.shape[0] and 0 <= x < m.shape[1] and m[y, x]
    back = next((d for d in (4, 3, 2, 1, 0, 7, 6, 5) if on(x + AROUND[d][0], y + AROUND[d][1])), None)
    if back is None:
        return [(x, y)]
    start, points = (x, y, back), []
    while True:
        points.append((x, y))
        go = next(d % 8 for d in range(back + 1, back + 9) if on(x + AROUND[d % 8][0], y + AROUND[d % 8][1]))
        x, y, back = x + AROUND[go][0], y + AROUND[go][1], (go + 4) % 8
        if (x, y, back) == start:
            break
    n = len(points)
    step = [(points[(i + 1) % n][0] - p[0], points[(i + 1) % n][1] - p[1]) for i, p in enumerate(points)]
    return [p for i, p in enumerate(points) if step[i] != step[i - 1]]


def picture(text):
    return np.array([[c == "#" for c in line] for line in text.split()])


SHAPES = {
    "C": ("#####  ##... ##... #####".replace("  ", " "), [(0, 0), (0, 3), (4, 3), (2, 3)]),
    "dot": ("#", [(0, 0)]),
    "bar": ("####", [(0, 0), (3, 0)]),
    "post": ("# # #", [(0, 0), (0, 2)]),
    "slope": ("#.. .#. ..#", [(0, 0), (2, 2)]),
    "box": ("### ### ###", [(0, 0), (0, 2), (2, 2), (2, 0)]),
}


def corners(m):
    y, x = np.nonzero(m)
    return [(int(a), int(b)) for _, a, b in zip(*O.outlines(*O.runs_of(np.zeros(len(y), np.int64), y, x, x)))]


@pytest.mark.parametrize("name", list(SHAPES))
def test_shapes(name):
    text, want = SHAPES[name]
    m = picture(text)
    assert corners(m) == followed(m)
    if name != "C":
        assert corners(m) == want


@pytest.mark.parametrize("p", [0.3, 0.45, 0.6, 0.8])
def test_noise(p):
    for seed in range(40):
        full = filled(blobs(seed, (1, 14, 17), p)[0])
        lab = flood(full, 8)
        for c in np.unique(lab[lab >= 0]):
            assert corners(lab == c) == followed(lab == c), (seed, c)


def test_table(spark):
    """Regions over several words and tiles, a C and a ring among them."""
    m = blobs(5, (2, 26, 140), 0.5)
    m[0, 2:20, 60:90] = False
    m[0, 4:16, 62:80] = True
    m[0, 7:13, 66:82] = False  # a C
    m[1, 2:20, 60:90] = False
    m[1, 4:16, 62:80] = True
    m[1, 7:13, 66:76] = False  # a ring
    lab = G.labelled_regions(R.long_masks(words_of(spark, {"m": m}), ["m"]), False, 6, 1)
    got = {(r.image_id, r.comp_id): [(int(p.x), int(p.y)) for p in r.outline] for r in O.region_outline(lab).collect()}
    want = {}
    for i, a in enumerate(m):
        ref = flood(filled(a), 8)
        want.update({(i, int(c)): followed(ref == c) for c in np.unique(ref[ref >= 0])})
    assert got == want
