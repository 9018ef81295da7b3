"""Overlap suppression and shadow search against plain loops, at sizes that force clusters, rounds and tiles."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terratally.operators import boxes as B, shadow_search as SS, suppress as SP

BOXES = "image_id bigint, cls_id int, box_idx int, conf double, x1 double, y1 double, x2 double, y2 double, note string"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0.0) * max(h, 0.0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def plain_nms(rows, threshold):
    kept, flat = {}, []
    for r in sorted(rows, key=lambda r: (-r[3], r[2])):
        box = r[4:8]
        if not (box[2] > box[0] and box[3] > box[1]) or not all(map(math.isfinite, box)):
            flat.append(r)
            continue
        group = kept.setdefault(r[:2], {})
        # exact copies share the fate of their best member
        if all(iou(k, box) <= threshold for k in group):
            group[box] = r
    return sorted((r[0], r[1], r[2]) for r in [*flat, *[x for g in kept.values() for x in g.values()]])


def scene(kind, n=300, seed=3):
    rnd = np.random.default_rng(seed)
    if kind == "jitter":  # shifted copies of few objects
        at = rnd.uniform(0, 60, (3, 2))[rnd.integers(0, 3, n)] + rnd.normal(0, 2, (n, 2))
        size = np.full((n, 2), 40.0) + rnd.normal(0, 1, (n, 2))
    elif kind == "chain":  # each box overlaps the next, and ranks fall along the chain
        at, size = np.stack([np.arange(n) * 3.0, np.zeros(n)], 1), np.full((n, 2), 10.0)
    else:  # all sizes
        size = 2.0 ** rnd.uniform(-2, 12, (n, 2))
        at = rnd.uniform(0, 400, (n, 2))
    conf = 1 - np.arange(n) / n if kind == "chain" else np.round(rnd.uniform(0, 1, n), 1 if kind == "jitter" else 3)
    return [(int(i % 3 == 0 and kind != "chain"), int(kind == "sizes" and i % 2), i, float(conf[i]), float(at[i, 0]), float(at[i, 1]), float(at[i, 0] + size[i, 0]), float(at[i, 1] + size[i, 1]), "n") for i in range(n)]


@pytest.mark.parametrize("kind", ["jitter", "chain", "sizes"])
@pytest.mark.parametrize("limit", [40, 200_000])
def test_nms(spark, monkeypatch, kind, limit):
    monkeypatch.setattr(SP, "SWEEP", limit)
    rows = scene(kind)
    rows += [(0, 0, 900, 0.5, 5.0, 5.0, 5.0, 9.0, "flat"), (0, 0, 901, 0.5, float("nan"), 0.0, 1.0, 1.0, "nan"), (0, 0, 902, 0.5, 0.0, 0.0, float("inf"), 1.0, "inf")]
    rows += [(*rows[5][:2], 903, 0.99, *rows[5][4:])]  # a copy with a better rank
    for t in (0.45, 0.1):
        got = sorted((r.image_id, r.cls_id, r.box_idx) for r in B.box_nms(spark.createDataFrame(rows, BOXES), t).collect())
        assert got == plain_nms(rows, t), (kind, limit, t)


def test_sweep_compares_with_kept_boxes_only(monkeypatch):
    """m shifted copies of one object cost about m comparisons."""
    calls = []
    real = SP._iou_over
    monkeypatch.setattr(SP, "_iou_over", lambda *a: calls.append(1) or real(*a))
    rnd = np.random.default_rng(1)
    boxes = [(x, y, x + 50.0, y + 50.0) for x, y in rnd.normal(0, 1, (2000, 2)).tolist()]
    assert SP.swept(boxes, 0.45, SP.levels_apart(0.45)) == [0] and len(calls) <= 2000


def test_rounds_do_not_follow_the_chain(spark, monkeypatch):
    monkeypatch.setattr(SP, "SWEEP", 100)
    rounds = []
    real = SP.best_first
    monkeypatch.setattr(SP, "best_first", lambda *a: rounds.append(1) or real(*a))
    rows = scene("chain", 300)
    assert B.box_nms(spark.createDataFrame(rows, BOXES), 0.45).count() == 150 and len(rounds) <= 4


def test_nms_edges(spark):
    assert B.box_nms(spark.createDataFrame([], BOXES)).count() == 0
    tie = [(1, 0, i, 0.5, 0.0, 0.0, 10.0, 10.0 + i * 0.1, "") for i in (3, 1, 2)]
    assert [r.box_idx for r in B.box_nms(spark.createDataFrame(tie, BOXES)).collect()] == [1]


# ---- shadows

def plain_match(buildings, shadows, factor=2.6, pad=14.0):
    out = {}
    for img, idx, x1, y1, x2, y2 in buildings:
        size, best = max(x2 - x1, y2 - y1, 1), None
        for simg, sid, cx, cy, sx0, sy0, sx1, sy1 in shadows:
            if simg != img:
                continue
            dist = math.sqrt(max(x1 - cx, 0.0, cx - x2) ** 2 + max(y1 - cy, 0.0, cy - y2) ** 2)
            touch = sx1 >= x1 - pad and sx0 <= x2 + pad and sy1 >= y1 - pad and sy0 <= y2 + pad
            if dist <= size * factor or touch:
                score = dist + (0.0 if touch else 15.0) + 0.05 * math.sqrt((cx - (x1 + x2) / 2.0) ** 2 + (cy - (y1 + y2) / 2.0) ** 2)
                best = min(best or (math.inf, 0), (score, sid))
        if best:
            out[img, idx] = best[1]
    return out


def shadow_scene(seed=2):
    rnd = np.random.default_rng(seed)
    b, s = [], []
    for img, nb, ns in ((1, 60, 500), (2, 20, 3), (3, 5, 0), (4, 0, 5), (5, 120, 90)):
        for i in range(nb):
            x, y, w, h = rnd.integers(0, 900), rnd.integers(0, 900), rnd.integers(1, 60), rnd.integers(1, 60)
            b.append((img, i, int(x), int(y), int(x + w), int(y + h)))
        for j in range(ns):
            cx, cy = rnd.integers(0, 900, 2) if j % 3 else (450, 450)
            r = float(rnd.integers(1, 20)) if j % 50 else 700.0  # some reach across the image
            cx, cy = float(cx), float(cy)
            s.append((img, j, cx, cy, cx - r, cy - r, cx + r, cy + r))
    s += [(i, j + 1000, *rest) for i, j, *rest in s[:20]]  # copies
    return b, s


BUILDINGS = "image_id bigint, asset_idx int, x1 int, y1 int, x2 int, y2 int"
SHADOWS = "image_id bigint, shadow_id bigint, cx double, cy double, sx0 double, sy0 double, sx1 double, sy1 double"


@pytest.mark.parametrize("limit,leaf", [(50_000, 4), (50_000, 32), (40, 8)])
def test_shadow_match(spark, monkeypatch, limit, leaf):
    monkeypatch.setattr(SS, "LIMIT", limit)
    monkeypatch.setattr(SS, "LEAF", leaf)
    b, s = shadow_scene()
    got = SS.match_shadows(spark.createDataFrame(b, BUILDINGS), spark.createDataFrame(s, SHADOWS), 2.6, 14.0).collect()
    assert {(r.image_id, r.asset_idx): r.shadow_id for r in got} == plain_match(b, s) and len(got) == len({(r.image_id, r.asset_idx) for r in got})


def test_few_leaves_are_opened():
    """In a dense field a building opens a few leaves, not all in its reach."""
    import pyarrow as pa

    n = 20_000
    rnd = np.random.default_rng(0)
    c = rnd.uniform(0, 1000, (2, n))
    s = pa.table({"image_id": np.ones(n, np.int64), "shadow_id": np.arange(n), "cx": c[0], "cy": c[1], "sx0": c[0] - 1, "sy0": c[1] - 1, "sx1": c[0] + 1, "sy1": c[1] + 1})
    b = pa.table({"image_id": [1], "x1": [400.0], "y1": [400.0], "x2": [600.0], "y2": [600.0], "size": [200.0], "bound": [math.inf]})
    opened = []
    got = SS.searcher(2.6, 14.0, 32, opened)(b, s)
    assert sum(opened) < 20 and got.column("shadow_id")[0].as_py() == int(np.argmin(np.hypot(c[0] - 500, c[1] - 500)))
