"""The full mask chains against plain arrays on a few scenes."""
import numpy as np
import pytest

from terratally import fixed_values as K
from terratally.operators import masks as M
from terratally.sources import fixtures as X
from tests.test_gray import canny
from tests.test_raster import box, filled, flood, raster

SCENES = 3


@pytest.fixture(scope="module")
def scenes(spark):
    px = X.pixels(spark, "/root/testdata/sf0.001").where(f"image_id < {SCENES}").cache()
    rgb = np.zeros((SCENES, 64, 96, 3), int)
    for r in px.collect():
        rgb[r.image_id, r.y, r.x] = r.r, r.g, r.b
    return px, rgb


def bands(rgb, mode):
    r, g, b = (rgb[..., i] for i in range(3))
    v, d = rgb.max(-1), rgb.max(-1) - rgb.min(-1)
    s = (d * np.rint(1044480 / np.maximum(v, 1)).astype(int) + 2048) >> 12
    h = np.where(v == r, g - b, np.where(v == g, b - r + 2 * d, r - g + 4 * d))
    h = (h * np.where(d > 0, np.rint(122880 / np.maximum(d, 1)), 0).astype(int) + 2048) >> 12
    h = np.where(h < 0, h + 180, h)
    gray = (r * 9798 + g * 19235 + b * 3735 + 16384) >> 15
    out = {}
    for name, (kind, lo, hi) in K.BANDS[mode].items():
        if kind == "gray":
            out[name] = (gray >= lo) & (gray <= hi)
        else:
            out[name] = np.logical_and.reduce([(c >= a) & (c <= z) for c, a, z in zip((h, s, v), lo, hi)])
    return out, gray


def grow(m, k, kind="dilate"):
    return box(m, -(k // 2), k - 1 - k // 2, kind)


def clean(m, k):
    for kind in ("erode", "dilate", "dilate", "erode"):
        m = grow(m, k, kind)
    return m


def pick(m, rule, at_least=1, over=None):
    """Filled regions that satisfy rule(area, width, height), if there are enough of them."""
    out = np.zeros_like(m)
    for i, a in enumerate(m):
        lab = flood(filled(a), 8)
        kept = []
        for c in np.unique(lab[lab >= 0]):
            part = lab == c
            ys, xs = np.nonzero(part)
            p = np.pad(part.astype(int), ((0, 1), (0, 1)))
            quad = p[:-1, :-1] + p[1:, :-1] + p[:-1, 1:] + p[1:, 1:]
            area = (quad == 4).sum() + (quad == 3).sum() / 2
            if rule(area, xs.max() - xs.min() + 1, ys.max() - ys.min() + 1):
                kept.append(part)
        total = sum(k.sum() for k in kept) / a.size * 100
        if len(kept) >= at_least and (over is None or total > over):
            out[i] = np.logical_or.reduce(kept)
    return out


def test_map_masks(spark, scenes):
    px, rgb = scenes
    k = 1 / 16
    b, gray = bands(rgb, "map")
    green = clean(b["green"], 5)
    water = clean(b["water"] & ~green, 5)
    edges = grow(np.stack([canny(g, 60, 160) for g in gray]), 3)
    road = clean((b["road"] | edges) & ~green & ~water, 3)
    building = clean(b["bright"] & ~green & ~water & ~road, 3)
    building = pick(building, lambda a, w, h: 80 * k <= a <= 20000 * k and 0.25 < w / h < 4 and a / (w * h) > 0.25)
    parks = pick(grow(grow(green, 9), 9, "erode"), lambda a, w, h: a > 5000 * k)
    near = grow(road, 9)
    want = {
        "building": building, "green": green, "parks": parks, "water": water, "road": road,
        "drain": clean(b["dark"] & (near | grow(water, 9)) & ~green, 3),
        "vehicle": pick(b["bright"] & near, lambda a, w, h: 8 * k <= a <= 120 * k and 0.4 < w / h < 3.5),
        "waste": clean(b["waste"] & ~road & ~building, 5), "solar": clean(b["solar"] & grow(building, 9), 3)}
    got = M.map_masks(px, k).cache()
    for name, m in want.items():
        assert (raster(got, name, *m.shape) == m).all(), name


def test_video_masks(spark, scenes):
    px, rgb = scenes
    k = 1 / 40
    b, _ = bands(rgb, "video")

    def rule(lo, hi=np.inf, amin=0, amax=np.inf, ext=0):
        return lambda a, w, h: lo * k <= a <= hi * k and amin <= max(w, h) / min(w, h) <= amax and a / (w * h) >= ext

    raw = clean(b["green"], 5)
    green = np.stack([g if g.mean() > 0.01 else g & False for g in raw])
    water = pick(clean(b["water"] & ~raw, 5), rule(1500))
    road = pick(clean((b["road"] | b["lowsat"]) & ~raw & ~water, 5), rule(2500, amin=3, ext=0.18))
    building = pick(clean(b["bright"] & b["roof"] & ~raw & ~road & ~water, 3), rule(220, 18000, amax=4.5, ext=0.45), 2, 0.05)
    want = {
        "building": building, "green": green, "parks": pick(grow(grow(raw, 11), 11, "erode"), rule(8000)), "water": water, "road": road,
        "drain": pick(clean(b["dark"] & (grow(road, 11) | grow(water, 11)) & ~raw, 3), rule(180, 8000, amin=4, ext=0.12)),
        "vehicle": pick(clean(b["bright"] & grow(road, 7) & ~raw, 2), rule(12, 180, amax=4, ext=0.35), 3),
        "waste": pick(clean(b["waste"] & ~road & ~building & ~raw, 5), rule(2000, 50000, ext=0.15)),
        "solar": pick(clean(b["solar"] & grow(building, 7), 3), rule(80, 4000, amax=5, ext=0.4))}
    got, _ = M.video_masks(px, k)
    for name, m in want.items():
        assert (raster(got, name, *m.shape) == m).all(), name


@pytest.mark.parametrize("mode", ["map", "video"])
def test_one_mask_makes_what_it_needs(spark, scenes, mode, monkeypatch):
    px, _ = scenes
    made = []
    monkeypatch.setattr(M.Q, "labelled_regions", lambda long, real=M.Q.labelled_regions: made.append(1) or real(long))
    k = 1 / 16 if mode == "map" else 1 / 40
    draws = {"map": {"building": 1, "parks": 1, "vehicle": 1, "waste": 1, "solar": 1},
             "video": {"parks": 1, "water": 1, "road": 2, "building": 3, "drain": 3, "vehicle": 3, "waste": 4, "solar": 4}}[mode]
    whole = (M.map_masks(px, k) if mode == "map" else M.video_masks(px, k)[0]).cache()
    for mask in M.MAP_MASKS:
        made.clear()
        one = M.map_masks(px, k, [mask]) if mode == "map" else M.video_mask(px, mask, k)
        assert sorted(one.select(*M.R.KEY, mask).collect()) == sorted(whole.select(*M.R.KEY, mask).collect()), mask
        assert len(made) == draws.get(mask, 0), mask
