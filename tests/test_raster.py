"""Words, filters and regions against brute force on small random rasters."""
import numpy as np
import pytest

from terratally.operators import raster as R, regions as G


def words_of(spark, masks):
    """Word table of boolean arrays {name: (images, h, w)}."""
    rows = []
    first = next(iter(masks.values()))
    n, h, w = first.shape
    for i in range(n):
        for y in range(h):
            for xb in range((w + 63) // 64):
                vals = []
                for m in masks.values():
                    seg = m[i, y, xb * 64:xb * 64 + 64]
                    v = sum(1 << int(j) for j in np.flatnonzero(seg))
                    vals.append(v - (1 << 64) if v >= 1 << 63 else v)
                rows.append((i, w, h, y, xb, *vals))
    schema = "image_id bigint, w int, h int, y int, xb int, " + ", ".join(f"{m} bigint" for m in masks)
    return spark.createDataFrame(rows, schema)


def raster(df, name, n, h, w):
    out = np.zeros((n, h, w), bool)
    for r in R.word_pixels(df, [name]).where(name).collect():
        out[r.image_id, r.y, r.x] = True
    return out


def box(m, lo, hi, kind):
    n, h, w = m.shape
    out = np.empty_like(m)
    for y in range(h):
        for x in range(w):
            win = m[:, max(0, y + lo):max(0, y + hi + 1), max(0, x + lo):max(0, x + hi + 1)].reshape(n, -1)
            if win.shape[1] == 0:
                out[:, y, x] = kind == "erode"
            else:
                out[:, y, x] = win.all(1) if kind == "erode" else win.any(1)
    return out


def flood(m, conn):
    """Region number per pixel, the raster index of the first pixel."""
    h, w = m.shape
    lab = np.full((h, w), -1)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if conn == 8 else [])
    for y in range(h):
        for x in range(w):
            if m[y, x] and lab[y, x] < 0:
                stack = [(y, x)]
                lab[y, x] = y * w + x
                while stack:
                    a, b = stack.pop()
                    for dy, dx in steps:
                        c, d = a + dy, b + dx
                        if 0 <= c < h and 0 <= d < w and m[c, d] and lab[c, d] < 0:
                            lab[c, d] = y * w + x
                            stack.append((c, d))
    return lab


def filled(m):
    lab = flood(~m, 4)
    edge = set(lab[0]) | set(lab[-1]) | set(lab[:, 0]) | set(lab[:, -1])
    return m | ((lab >= 0) & ~np.isin(lab, list(edge)))


def blobs(seed, shape, p=0.45):
    rng = np.random.default_rng(seed)
    return rng.random(shape) < p


@pytest.mark.parametrize("band", [512, 7])
def test_filters(spark, band):
    m = blobs(1, (2, 21, 150), 0.6)
    ops = [("e3", "m", "erode", -1, 1), ("d3", "m", "dilate", -1, 1), ("e2", "m", "erode", -1, 0), ("d9", "m", "dilate", -4, 4)]
    df = R.core(R.morph(R.banded(words_of(spark, {"m": m}), ["m"], 8, band), ops), ["e3", "d3", "e2", "d9"], band).cache()
    for name, _, kind, lo, hi in ops:
        assert (raster(df, name, *m.shape) == box(m, lo, hi, kind)).all(), name


def test_clean(spark):
    m = blobs(2, (2, 30, 100), 0.7)
    for k in (3, 2):
        got = raster(R.core(R.clean(R.banded(words_of(spark, {"m": m}), ["m"], 32, 9), {"m": k}), ["m"], 9), "m", *m.shape)
        lo, hi = R.span(k)
        want = m
        for kind in ("erode", "dilate", "dilate", "erode"):
            want = box(want, lo, hi, kind)
        assert (got == want).all()


@pytest.mark.parametrize("rows,words", [(1024, 16), (5, 1)])
@pytest.mark.parametrize("conn", [4, 8])
def test_components(spark, rows, words, conn):
    m = blobs(3, (2, 23, 140))
    got = G.components(words_of(spark, {"m": m}), ["m"], conn, rows, words).collect()
    want = [flood(a, conn) for a in m]
    assert sum(r.x1 - r.x0 + 1 for r in got) == m.sum()
    for r in got:
        assert (want[r.image_id][r.y, r.x0:r.x1 + 1] == r.lab).all()


@pytest.mark.parametrize("rows,words", [(1024, 16), (6, 1)])
def test_regions(spark, rows, words):
    m = blobs(4, (2, 26, 140), 0.5)
    lab = G.labelled_regions(R.long_masks(words_of(spark, {"m": m}), ["m"]), False, rows, words)
    got = {(r.image_id, r.comp_id): r for r in G.region_stats(lab).collect()}
    count = 0
    for i, a in enumerate(m):
        solid = filled(a)
        ref = flood(solid, 8)
        for c in np.unique(ref[ref >= 0]):
            count += 1
            ys, xs = np.nonzero(ref == c)
            part = np.pad(ref == c, ((0, 1), (0, 1)))
            quad = part[:-1, :-1].astype(int) + part[1:, :-1] + part[:-1, 1:] + part[1:, 1:]
            r = got[(i, c)]
            assert (r.n, r.min_x, r.max_x, r.min_y, r.max_y) == (len(ys), xs.min(), xs.max(), ys.min(), ys.max())
            assert r.area == (quad == 4).sum() + (quad == 3).sum() / 2
            assert abs(r.cx - xs.mean()) < 1e-9 and abs(r.cy - ys.mean()) < 1e-9
    assert count == len(got)
