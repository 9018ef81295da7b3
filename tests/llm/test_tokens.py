"""Encoding, edit-aware counts, packing and token output against the tokenizer libraries."""
import base64
import collections
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from terratally.llm import bpe, feistel, packing, queries, token_counts, token_output


@pytest.fixture(scope="module")
def ranks():
    return bpe.rank_vocabulary(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def merges():
    return bpe.merges_vocabulary(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


@pytest.fixture(scope="module")
def other():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_round_trip(make, awkward, ranks, library):
    got = {r.doc_id: tuple(r)[1:] for r in bpe.round_trip(make(awkward), ranks).collect()}
    for i, text in awkward:
        ids = library.encode_ordinary(text or "")
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_clashing_words(make, ranks, merges, library, other, clashing):
    """Different words with one hash in a block keep their own ids, in every operator that encodes."""
    a, b = clashing
    texts = [f"x {a} y", f"x {b} y", f"{b} {a}", a, b, b]
    encoded = bpe.encode(make(list(enumerate(texts))).coalesce(1), merges)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: other.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    block = token_counts.encoded(ranks, texts)
    for k, t in enumerate(texts):
        assert block.ids[block.offsets[k]:block.offsets[k + 1]].tolist() == library.encode_ordinary(t)


def test_encode_and_decode(make, awkward, merges, other):
    encoded = bpe.encode(make(awkward), merges)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {i: other.encode(t or "", add_special_tokens=False).ids for i, t in awkward}
    assert {r.doc_id: bytes(r.text).decode() for r in bpe.decode_texts(encoded, merges).collect()} == {i: t or "" for i, t in awkward}


def test_every_token_is_its_own_merge(ranks, library):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab cd's t're 'll  \n\t 'é1²٣!?… 日本x́''") for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    b = token_counts.encoded(ranks, texts)
    for k, t in enumerate(texts):
        assert b.ids[b.offsets[k]:b.offsets[k + 1]].tolist() == library.encode_ordinary(t)


@pytest.mark.parametrize("leaf", [1, 3, 32])
def test_edits(ranks, library, monkeypatch, leaf):
    monkeypatch.setattr(token_counts, "LEAF", leaf)
    monkeypatch.setattr(token_counts, "FULL", 4 * leaf)
    rnd, letters = random.Random(leaf), "ab cd's t've 'll  \n\n\t 'é1!?… 日本x"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 300))) for _ in range(300)]
    b, docs, after = token_counts.encoded(ranks, texts), [], []
    for k, t in enumerate(texts):
        s, e = b.word_offsets[k], b.word_offsets[k + 1]
        edits, now = [], t
        for _ in range(rnd.randint(0, 6)):
            p, q = rnd.randint(-2, len(now) + 2), rnd.randint(-2, len(now) + 2)
            q = rnd.choice([q, p, p + 1])
            new = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 3, 200])))
            edits.append({"start": p, "end": q, "replacement": new})
            a = min(max(p, 0), len(now))
            now = now[:a] + new + now[min(max(q, a), len(now)):]
        docs.append(token_counts.Edited(t, token_counts.Tree(*token_counts.leaves_of(b.word_chars[s:e], b.word_counts[s:e], leaf)), edits))
        after.append(now)
    token_counts.refresh(ranks, docs)
    for d, now in zip(docs, after):
        assert "".join(d.leaves) == now and d.tree.sums[1, 1] == len(library.encode_ordinary(now)) and d.tree.sums[0, 1] == len(now)


def test_edit_query_rows(spark, make, awkward, ranks, library):
    rows = awkward + [(100, "a###   b %%%%%c"), (101, "!!!!")]
    trees = token_counts.build_trees(make(rows), ranks).withColumn("edits", queries.clean_up_edits("text"))
    for r in token_counts.apply_edits(trees, ranks).collect():
        before = dict(rows)[r.doc_id] or ""
        assert r.text == queries.CLEAN_UP.sub(lambda m: "" if m[1] else " ", before)
        assert (r.n_before, r.n_tokens) == (len(library.encode_ordinary(before)), len(library.encode_ordinary(r.text)))
        assert sum(r.leaf_tokens) == r.n_tokens and (r.n_edits or not r.n_chars_encoded)


def test_build_and_edit_is_one_python_step(spark, make, awkward, ranks):
    docs = make(awkward + [(100, "a###   b %%%%%c"), (101, "!!!!")])
    one = token_counts.build_and_edit(docs, ranks, queries.edits_of)
    trees = token_counts.build_trees(docs, ranks).withColumn("edits", queries.clean_up_edits("text"))
    assert sorted(one.collect()) == sorted(token_counts.apply_edits(trees, ranks).collect())
    plan = queries.op1_token_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def check_pieces(rows, ids, length):
    by, of = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        of[r.sequence_id].append(r)
    assert set(by) == set(ids)
    for d, parts in by.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            own = ids[d][r.start:r.start + r.length]
            assert r.start == at and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own)) and r.doc_tokens == len(ids[d])
            at += r.length
        assert at == len(ids[d])
    for s, parts in of.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or s == max(of)
    assert sorted(of) == list(range(len(of)))


@pytest.mark.parametrize("length", [7, 2048])
def test_packing(make, awkward, merges, other, length):
    ids = {i: other.encode(t or "", add_special_tokens=False).ids + [1] for i, t in awkward}
    check_pieces(packing.pack(make(awkward).repartition(5), merges, length).collect(), ids, length)


def test_token_output(spark, make, awkward, merges, other, tmp_path):
    path, length, per = str(tmp_path / "shards"), 64, 8
    token_output.write_shards(make(awkward).repartition(3), merges, path, length=length, per_shard=per)
    rows = token_output.read_shards(spark, path, 0, per).collect()
    total = sum(len(other.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in awkward)
    n = -(-total // length)
    assert sorted(r.slot for r in rows) == sorted(r.sequence_id for r in rows) == list(range(n))
    keys = feistel.round_keys(token_output.KEY)
    assert all(r.shard == r.slot // per and len(r.payload) == 2 * length and int(feistel.permute([r.sequence_id], n, keys)[0]) == r.slot for r in rows)
    assert sum(r.n_tokens for r in rows) == total
    stream = np.concatenate([np.frombuffer(r.payload, "<u2")[:r.n_tokens] for r in sorted(rows, key=lambda r: r.sequence_id)])
    def cut(ids):
        return [" ".join(map(str, x)) for x in np.split(ids, np.flatnonzero(ids == 1) + 1) if len(x)]

    documents = sorted(cut(stream))
    expected = sorted(x for _, t in awkward for x in cut(np.array(other.encode(t or "", add_special_tokens=False).ids + [1])))
    assert documents == expected
    resumed = token_output.read_shards(spark, path, n // 2, per).collect()
    assert sorted(r.slot for r in resumed) == list(range(n // 2, n))


def test_empty_tables(spark, make, ranks, merges, tmp_path):
    none = make([])
    assert bpe.round_trip(none, ranks).count() == bpe.encode(none, ranks).count() == packing.pack(none, merges).count() == 0
    assert token_counts.build_trees(none, ranks).count() == 0
    assert token_output.materialise(none, merges).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_feistel(n):
    keys = feistel.round_keys(b"k")
    out = feistel.permute(np.arange(n), n, keys)
    assert sorted(out.tolist()) == list(range(n)) and feistel.permute(out, n, keys, back=True).tolist() == list(range(n))
    ints = [int(k) for k in keys]
    assert [feistel.permute_one(i, n, ints) for i in range(n)] == out.tolist()
    if n > 1:
        moved = [feistel.displaced(i, n, ints) for i in range(n)]
        assert sorted(moved) == list(range(n)) and all(i != m for i, m in enumerate(moved))
