"""Exact, near and substring deduplication against brute force."""
import hashlib
import random

import numpy as np
import pytest

from terratally.llm import exact_dedup, jaccard_join, suffix_dedup


def exact_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact(make, awkward):
    rows = awkward + [(200 + k, "hot") for k in range(300)] + [(None, "nobody"), (None, "hot"), (7, "seven again")]
    assert sorted(map(tuple, exact_dedup.deduplicate(make(rows).repartition(6)).collect()), key=str) == exact_by_hand(rows)


def test_exact_with_a_history(make):
    """Members join their slot's group, nonmembers are grouped among themselves."""
    earlier = exact_dedup.winners(exact_dedup.digest_rows(make([(1, "a"), (2, "a"), (90, "b"), (3, "only there")])))
    docs = make([(10, "a"), (11, "b"), (12, "new"), (13, "new"), (14, "once"), (None, "new"), (15, None), (16, "")])
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(docs, earlier).collect()}
    assert got == {(10, 10, 3, True), (11, 90, 2, False), (12, 13, 3, False), (13, 13, 3, True), (None, 13, 3, False), (14, 14, 1, True), (15, 16, 2, False), (16, 16, 2, True)}
    none = exact_dedup.deduplicate(docs, earlier.limit(0)).collect()
    assert {(r.doc_id, r.keep_id) for r in none} == {(10, 10), (11, 11), (12, 13), (13, 13), (None, 13), (14, 14), (15, 16), (16, 16)}


def test_exact_empty(make):
    assert exact_dedup.deduplicate(make([])).count() == 0


def test_minimal_perfect_hash():
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(5000)]
    words = exact_dedup.words_of(digests)
    levels = exact_dedup.build_levels(words)
    assert sorted(exact_dedup.slots_of(words, exact_dedup.unpack_levels(*exact_dedup.pack_levels(levels))).tolist()) == list(range(5000))


def near_by_hand(rows):
    def lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    sets = {}
    for i, t in rows:
        w = [x.decode() for x in lower(t).encode().split()]
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()}


def test_near_awkward(make, awkward):
    assert near_rows(make(awkward)) == near_by_hand(awkward)


@pytest.mark.parametrize("small,tile,few,split", [(3, 16, 6, 5), (8, 2048, 256, 4096)])
def test_near_with_large_groups(make, monkeypatch, small, tile, few, split):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "SPLIT", split)
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    line, texts = [rnd.choice(words) for _ in range(14)], []
    for size in (7, 20, 60, 150):
        base = [rnd.choice(words) for _ in range(size)]
        for _ in range(60):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 5]) * size // 60 + rnd.choice([0, 0, 1])):
                w[rnd.randrange(size)] = rnd.choice(words)
            texts.append(" ".join(w))
    texts += [" ".join(line + [rnd.choice(words) for _ in range(rnd.randrange(14))]) for _ in range(120)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    assert near_rows(make(rows)) == near_by_hand(rows)


def test_sketches_bound_the_difference():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        n = int(rnd.integers(1, 400))
        a = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) < 0.9], rnd.integers(0, 2**63, int(rnd.integers(0, 40)), dtype=np.uint64)]))
        x, y = (np.frombuffer(jaccard_join.bit_sketch(s), "<u8") for s in (a, b))
        words = min(len(x), len(y))
        assert jaccard_join.hamming(jaccard_join.folded(x, words), jaccard_join.folded(y, words)) <= len(np.setxor1d(a, b))


def test_linked_sets_share_a_key():
    """Pairs at the limit of similarity, of all sizes."""
    rnd = np.random.default_rng(2)
    for n in [*range(5, 60), 100, 333, 1000]:
        for _ in range(4):
            a = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
            drop = len(a) // 9
            new = rnd.integers(0, 2**63, drop, dtype=np.uint64)
            b = np.unique(np.concatenate([rnd.permutation(a)[drop:], new]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            doc, key = jaccard_join.block_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert set(key[doc == 0].tolist()) & set(key[doc == 1].tolist())


def test_near_tells_clashing_words_apart(make, clashing):
    """Words whose sums modulo 2**64 agree for every base, and words that only end differently."""
    a, b = clashing
    rows = [(1, f"one two {a} four five"), (2, f"one two {b} four five"), (3, f"one two {b} four five"), (4, "one two abcdefg four five"), (5, "one two abcdefgh four five"),
            (6, "one two abcdefgh\0 four five"), (7, "one two a\0 four five"), (8, "one two a four five")]
    assert near_rows(make(rows)) == near_by_hand(rows)


def test_near_empty_and_null_ids(make):
    assert jaccard_join.near_duplicates(make([])).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f")]
    assert sorted(map(str, [r.component_id for r in jaccard_join.near_duplicates(make(rows)).collect()])) == ["2", "2", "None"]


def substrings_by_hand(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = hashlib.blake2b(b[k:k + 100], digest_size=12).digest()
            if w in seen:
                gone[k:k + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(b), runs, bytes(x for x, g in zip(b, gone) if not g))
    return out


def substring_rows(df):
    got = {}
    for r in suffix_dedup.deduplicate(df).collect():
        assert len(r.starts) == len(r.ends) and r.n_bytes - len(r.kept) == sum(r.ends) - sum(r.starts)
        got[r.doc_id] = (r.n_bytes, len(r.starts), bytes(r.kept))
    return got


def passages():
    rnd = random.Random(11)
    words = ["ab", "cde", "é", "日本", "fghi", "jk", "lmnop"]
    passage = " ".join(rnd.choice(words) for _ in range(70))
    rows = []
    for k in range(80):
        own = [" ".join(rnd.choice(words) + str(rnd.randrange(99)) for _ in range(rnd.randrange(60))) for _ in range(2)]
        cut = rnd.randrange(120)
        rows.append((k, rnd.choice([own[0] + passage[cut:] + own[1], own[0], passage[:len(passage) - cut] + own[1], "x" * rnd.randrange(400), "xy" * rnd.randrange(300)])))
    return rows + [(90, rows[3][1]), (91, rows[4][1]), (92, ""), (93, None), (94, "z" * 99), (95, "z" * 100), (96, "z" * 101)]


@pytest.mark.parametrize("hot", [8, 0.01])
def test_substrings(make, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = passages()
    assert substring_rows(make(rows).repartition(4)) == substrings_by_hand(rows)


def test_substrings_awkward(make, awkward):
    rows = [(i, t if t is None or len(t) < 5000 else t[:20_000]) for i, t in awkward]
    assert substring_rows(make(rows)) == substrings_by_hand(rows)


def test_substrings_repeated_rows_and_empty(make):
    text = "".join(map(str, range(100)))
    got = sorted((str(r.doc_id), len(r.kept)) for r in suffix_dedup.deduplicate(make([(1, text), (1, text), (2, text), (None, text)])).collect())
    assert got == [("1", len(text)), ("1", len(text)), ("2", 0), ("None", 0)]
    assert suffix_dedup.deduplicate(make([])).count() == 0


@pytest.mark.parametrize("parts,hot", [(1, 8), (5, 8), (5, 0.01)])
def test_substrings_of_texts_that_share_an_id(make, monkeypatch, parts, hot):
    """Null and repeated ids with other texts: a passage at the same place in each of them stays once."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    head = " ".join(f"common {k}" for k in range(40))
    # the first two texts have the same 32-bit blake2b
    texts = [head + chr(0x4E00 + k % 5000) + f" tail {k}" for k in (94376, 110901, *range(12))]
    rows = [(None, t) for t in texts] + [(5, t + " five") for t in texts[:3]] + [(None, "x" * 300), (None, "x" * 301)]
    order = sorted(rows, key=lambda r: (r[0] is None, int.from_bytes(hashlib.blake2b(r[1].encode(), digest_size=8).digest(), "little")))
    expected = substrings_by_hand([(k, t) for k, (_, t) in enumerate(order)])
    got = [(r.doc_id, r.n_bytes, len(r.starts), bytes(r.kept)) for r in suffix_dedup.deduplicate(make(rows).repartition(parts)).collect()]
    assert sorted(got, key=str) == sorted(((i, *expected[k]) for k, (i, _) in enumerate(order)), key=str)
    assert sum(head.encode() in r[3] for r in got) == 1


def kept_rows(df, columns):
    assert df.columns == columns
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_keep_last_goes_by_row(make):
    rows = [(1, "one"), (None, "one"), (None, "one"), (None, "nobody"), (None, None), (3, ""), (4, "four"), (4, "five"), (5, "five"), (5, "five"), (None, "four")]
    docs = make(rows).repartition(3)
    expected = [(1, "one"), (None, "nobody"), (3, ""), (4, "four"), (5, "five"), (5, "five")]
    assert kept_rows(exact_dedup.keep_last(docs), docs.columns) == sorted(expected, key=str)


def test_filters_with_clashing_names(make):
    docs = make([(1, "a b c d e"), (2, "a b c d e"), (3, "f")]).selectExpr("*", "'x' AS gone_id", "'y' AS GONE_DIGEST")
    for keep, ids in ((exact_dedup.keep_last, [2, 3]), (jaccard_join.keep_first, [1, 3])):
        out = keep(docs)
        assert out.columns == docs.columns
        assert sorted((r.doc_id, r.gone_id) for r in out.collect()) == [(i, "x") for i in ids]


def test_keep_first_goes_by_row(make):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    # two classes meet under id 7 only; id 8 has a copy and a text of its own
    rows = [(7, a), (7, b), (2, a + " end"), (9, b + " end"), (9, b + " end"), (8, b + " other"), (8, c), (None, a), (None, c), (8, c)]
    docs = make(rows).repartition(3)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect() if r.doc_id is not None) == sorted(
        [(7, 56, 2), (7, 56, 7), (2, 57, 2), (9, 57, 7), (9, 57, 7), (8, 57, 7), (8, 56, 8), (8, 56, 8)])
    expected = [(7, b), (2, a + " end"), (8, c), (8, c), (None, a), (None, c)]
    assert kept_rows(jaccard_join.keep_first(docs), docs.columns) == sorted(expected, key=str)


def test_substrings_of_whole_long_texts(make, awkward):
    assert max(len(t or "") for _, t in awkward) > 100_000
    assert substring_rows(make(awkward).repartition(3)) == substrings_by_hand(awkward)


def test_a_common_passage_makes_no_groups(make, monkeypatch):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(12)]
    rows = []
    for k in range(60):
        words = [word() for _ in range(300)]
        words[k:k] = passage
        rows.append((k, " ".join(words)))
        if k % 6 == 0:  # a near copy, which shares the passage with all others
            rows.append((k + 100, " ".join(words[:150] + ["other"] + words[151:])))
    for k in range(12):  # one family of many near copies keeps its group
        rows.append((k + 200, " ".join([*rows[1][1].split()[:300 - k], "last"])))
    left = []
    monkeypatch.setattr(jaccard_join, "regrouped", lambda members, roots, real=jaccard_join.regrouped: left.append({r.node for r in members.collect()}) or real(members, roots))
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(make(rows, clash=False)).collect()}
    assert len(left[0]) <= 15
    sets = {i: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    want = {i: i for i in sets}
    for _ in range(3):
        for i in sets:
            want[i] = min(want[j] for j in sets if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    assert got == want
