"""Nearest neighbours, hard negatives and lexical search against brute force."""
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terratally.llm import hard_negatives as H, lexical as X, nearest as N

SF = "/root/testdata/sf0.01"
ODD = [(400, None, 1), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (402, [float("nan")] * 6, 1), (403, [float("inf")] * 6, 1), (500, [1.0], 1), (550, [], 1)]


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for c in ("v", "x", "part", "grp", "size", "cell", "p", "bad", "score", "rank", "place", "bound", "query_id"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def random_rows(n=260, seed=4):
    """Vectors of six components in three labels; 20 are copies of one, and a third lie near one point."""
    rnd = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rnd.normal(size=6).astype(np.float32)], int(rnd.integers(3))) for i in range(n)]
    near = np.array(rows[7][1])
    rows = [(i, [float(x) for x in (near + rnd.normal(size=6) * 0.01).astype(np.float32)], 1) if i % 3 == 2 else (i, v, y) for i, v, y in rows]
    return rows + [(n + i, rows[3][1], i % 2) for i in range(20)]


# ---- hard negatives

@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 33, 40), (64, 64, 64), (35, 7, 51), (0, 5, 40), (40, 0, 40)])
def test_strassen(shape):
    rnd = np.random.default_rng(1)
    a, b = (rnd.integers(-1000, 1000, s) for s in (shape[:2], shape[1:]))
    assert (H.strassen(a, b, 4) == a @ b).all() and H.strassen(a, b, 4).shape == (shape[0], shape[2])


def test_strassen_of_large_numbers():
    rnd = np.random.default_rng(2)
    a, b = (rnd.integers(-2**28, 2**28, s) for s in ((20, 30), (30, 25)))
    exact = a.astype(object) @ b.astype(object)
    assert (H.strassen(a, b, 3) == exact).all()
    wide = np.array([[2.0**62, 1.0], [-2.0**70, 3.0]])
    assert H.scores(wide, wide).tolist() == [[2**63 - 1, 1 - 2**63], [1 - 2**63, 2**63 - 1]]


def mined_by_hand(rows, every=50, k=5, m=3):
    good = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in good:
        if i % every == 0:
            s = [(-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in good if j != i and len(w) == len(v)]
            for p, j, _ in sorted(x for x in s if x[2] == y)[:k]:
                fit = sorted((q, n) for q, n, z in s if z != y and 50 * -p <= 100 * -q <= 95 * -p)[:m]
                out += [(i, j, r + 1, n, -p, -q) for r, (q, n) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **kw):
    return sorted(tuple(r) for r in H.mine(vectors(spark, rows), F.col("vec_id") % 50 == 0, **kw).collect())


def test_hard_negatives(spark, monkeypatch):
    for name, n in (("PART", 40), ("GROUP", 3), ("ROWS", 2), ("LEAF", 2)):
        monkeypatch.setattr(H, name, n)
    rows = random_rows() + ODD + [(None, [1.0] * 6, 1), (450, [1.0] * 6, None)]
    want = mined_by_hand(rows)
    assert want and mined(spark, rows) == want


def test_hard_negative_edges(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 1)]) == []  # no other label
    assert mined(spark, [(0, [1.0], 1), (1, [0.8], 2)]) == []  # no positive
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.9], 2), (4, [0.99], 2), (5, [0.1], 2), (6, [-1.0], 1)]
    assert mined(spark, rows) == mined_by_hand(rows) == [(0, 1, 1, 2, 65536, 58880), (0, 1, 2, 3, 65536, 58880)]
    twice = [(0, [1.0], 1), (0, [0.5], 1), (1, [1.0], 1), (2, [0.4], 2)]  # the smaller vector asks
    assert mined(spark, twice) == [(0, 1, 1, 2, 32768, 13056)] if 100 * 13056 >= 50 * 32768 else mined(spark, twice) == []
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert mined(spark, [(0, [1.0], 9), (1, [1.0], 0), (2, [0.9], 9)], label=label) == [(0, 1, 1, 2, 65536, 58880)]


# ---- nearest neighbours

def nearest_by_hand(rows, every=100, k=10):
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    return {i: sorted((math.sqrt(((v - w) ** 2).sum()), j) for j, w in good if j != i and len(w) == len(v))[:k] for i, v in good if i % every == 0}


def found(spark, rows, **kw):
    got = {}
    for r in N.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0, **kw).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    return {q: sorted(v) for q, v in got.items()}


def test_chi_square():
    assert abs(N.chi_square(N.chi_square_at(0.9, 12), 12) - 0.9) < 1e-9
    rnd = np.random.default_rng(0)
    assert abs(np.mean((rnd.normal(size=(100_000, 12)) ** 2).sum(axis=1) <= N.chi_square_at(0.98, 12)) - 0.98) < 0.003


def test_leaves_hold_every_row():
    p = np.random.default_rng(3).normal(size=(1000, 12))
    p[:300] = p[0]
    assert sorted(N.leaves(p, 32)) == list(range(1000))
    tree = N.splits(p, 3)
    assert set(N.cell_of(p, tree, 3)) <= set(range(8)) and len(tree) == 7


def test_nearest_exact_when_sure(spark, monkeypatch):
    """With a test that (almost) never stops, the answers are those of brute force, ties included."""
    for name, n in (("PART", 30), ("LEAF", 4), ("CELLS", 8), ("GROUP", 2)):
        monkeypatch.setattr(N, name, n)
    rows = random_rows(401) + [(700, [0.0] * 6, 1), (800, None, 1), (900, [1.0], 1), (1000, [float("nan")] * 6, 1), (None, [1.0] * 6, 1)]
    got, want = found(spark, rows, sure=1 - 1e-12), nearest_by_hand(rows)
    assert set(got) == {q for q, v in want.items() if v}
    for q, v in got.items():
        assert [(r, i) for r, _, i in v] == [(r + 1, i) for r, (_, i) in enumerate(want[q])]
        assert np.allclose([s for _, s, _ in v], [s for s, _ in want[q]], rtol=1e-14, atol=0)


def test_nearest_edges(spark):
    assert found(spark, []) == {}
    assert found(spark, [(0, [1.0, 2.0], 1)]) == {}
    assert found(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [4.0, 6.0], 1)]) == {0: [(1, 0.0, 1), (2, 5.0, 2)]}
    assert found(spark, [(0, [3e38, 1.0], 1), (0, [3e38, 1.0], 2), (1, [-3e38, 1.0], 1)])[0][0][2] == 1


def test_recall(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got, want = found(spark, rows), nearest_by_hand(rows)
    hits = [len({i for *_, i in got[q]} & {i for _, i in v}) / len(v) for q, v in want.items()]
    assert np.mean(hits) >= 0.95 and all(len(v) == 10 for v in got.values())


# ---- lexical search

def ranked_by_hand(docs, items, k=50):
    cut = lambda t: Counter(re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or ""))
    tf = [(i, cut(t)) for i, t in docs]
    total, terms = sum(1 for _, c in tf if c), sum(c.total() for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(cut(t))
    out = []
    for q, words in asked.items():
        w = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) for t in words if df[t]}
        s = []
        for i, c in tf:
            m = 50 + 50 * c.total() * total // max(terms, 1)
            score = sum(v * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, v in w.items() if c[t])
            if score > 0:
                s.append((-score, i is None, i or 0, i))
        out += [(q, r + 1, i, -x) for r, (x, _, _, i) in enumerate(sorted(s, key=lambda v: v[:3])[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, **kw):
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("clash")).withColumn("grp", F.lit("clash"))
    return sorted((tuple(r) for r in X.ranked(docs, q, **kw).collect()), key=str)


@pytest.fixture
def small(monkeypatch):
    for name, n in (("SHARD_DOCS", 12), ("RANGE", 5), ("GROUP", 2), ("PIECE", 40)):
        monkeypatch.setattr(X, name, n)


@pytest.mark.parametrize("k", [1, 4, 50])
def test_ranked(spark, make, awkward, small, k):
    rnd = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)] + ["Ñandú", "ñandú", "日本", "x1"]
    p = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rnd.choice(words, n, p=p / p.sum()))
    docs = awkward + [(1000 + i, text(int(rnd.integers(1, 30)))) for i in range(80)] + [(1000, "w1 w2"), (None, "w3 w3 alpha"), (None, "w3 w3 alpha"), (5000, "\x1cw1\x1cW1\x0b")]
    items = [(i, text(8)) for i in range(5)] + [(7, None), (8, ""), (9, "unheard of"), (10, "ALPHA beta'ñandú"), (10, "w39 w5"), (None, "w1"), (11, "w1 " * 500)]
    want = ranked_by_hand(docs, items, k)
    assert len(want) > 5 and ranked(spark, make(docs), items, k=k, block=4) == want


def test_ranked_hot_term(spark, make, small):
    """A term in every document weighs nothing; copies are ranked by id."""
    docs = [(i, "hot " + ("rare" if i % 3 == 0 else "common")) for i in range(60)]
    items = [(1, "hot"), (2, "hot rare"), (3, "common")]
    assert ranked(spark, make(docs), items, k=7, block=4) == ranked_by_hand(docs, items, 7)


def test_ranked_empty(spark, make):
    assert ranked(spark, make([]), [(1, "a")]) == [] and ranked(spark, make([(1, "a")]), []) == [] and ranked(spark, make([(1, None)]), [(1, "a")]) == []


def test_rejected_blocks_stay_packed(monkeypatch):
    """Where one list decides, the blocks of the others that hold no candidate are never unpacked."""
    n = 4000
    m, opened = np.full(n, 100), []
    unpack = X.unpack
    monkeypatch.setattr(X, "unpack", lambda data: opened.append(1) or unpack(data))

    def postings(docs):
        docs, tf = np.array(docs), np.ones(len(docs), np.int64)
        cuts = [docs[i:i + 128] for i in range(0, len(docs), 128)]
        return X.Postings([int(c[-1]) for c in cuts], [int(X.impacts(np.int64(1), np.int64(100)))] * len(cuts), [X.pack(c, tf[:len(c)]) for c in cuts], m)

    lists = [(10, postings(range(n))), (5000, postings([17, 900]))]
    d, s = X.search(lists, n, 2, 5000 * int(X.impacts(np.int64(1), np.int64(100))))
    assert sorted(d) == [17, 900] and len(opened) <= 4 and (s == 5010 * int(X.impacts(np.int64(1), np.int64(100)))).all()
