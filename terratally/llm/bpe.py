"""Byte-level BPE by corpus-level merge replay, and decoding.

A task's documents form the corpus that is replayed. Their pre-tokens are split and collapsed to distinct words;
the words' bytes lie in one flat token array, linked to their neighbours. An inverted index leads from token pair
(kept in rank order, in buckets of neighbouring ranks) to the word positions where the pair stands. Merges are
replayed in rank order: at each step the lowest pair of every word that has one in the current bucket is merged,
for all words at once, and only the two pairs that touch the new token are looked up again and re-indexed. The ids
of a document are then those of its words in order. Nothing is shuffled, and memory is bounded by the block.

Defined results: a null or empty text has no ids. Any string is ordinary text; there are no special tokens.
"""
from __future__ import annotations

import base64
import hashlib
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from terratally.llm import pretokens
from terratally.llm.common import blocks, documents, ragged, ship_package, text_bytes

NONE = np.int32(2**31 - 1)
BUCKET = 512


class Vocabulary:
    """Token bytes and mergeable pairs as arrays (its size is the vocabulary's, not the corpus's)."""

    def __init__(self, tokens: list[bytes], pairs: dict[tuple[int, int], tuple[int, int]]):
        """tokens: bytes by id; pairs: (left id, right id) to (rank, merged id)."""
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in pairs.values()], np.int32)[order]
        self.merged = np.zeros(max((r for r, _ in pairs.values()), default=0) + 1, np.int32)
        for r, m in pairs.values():
            self.merged[r] = m
        by_byte = {t: i for i, t in enumerate(tokens) if len(t) == 1}
        self.byte_ids = np.array([by_byte[bytes([b])] for b in range(256)], np.int32)
        one, two = np.meshgrid(self.byte_ids, self.byte_ids, indexing="ij")
        self.byte_ranks = self.look_up(one.ravel(), two.ravel())
        digits = [f"{i} ".encode() for i in range(len(tokens))]
        self.decimal = np.zeros((len(tokens), max(map(len, digits))), np.uint8)
        for i, d in enumerate(digits):
            self.decimal[i, :len(d)] = np.frombuffer(d, np.uint8)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NONE."""
        if not len(self.keys):
            return np.full(len(a), NONE, np.int32)
        k = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, k)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == k, self.ranks[at], NONE)


def rank_vocabulary(path: str) -> Vocabulary:
    """From a file of base64 tokens and ranks: two tokens merge if their bytes joined are a token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    tokens = [b""] * (max(ranks.values()) + 1)
    pairs = {}
    for t, r in ranks.items():
        tokens[r] = t
        for cut in range(1, len(t)):
            a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
            if a is not None and b is not None:
                pairs[a, b] = (r, r)
    return Vocabulary(tokens, pairs)


def merges_vocabulary(path: str) -> Vocabulary:
    """From a tokenizer's JSON file with a byte-level alphabet and a list of merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # the printable stand-ins of the byte-level alphabet: printable Latin-1 stays, the rest follows from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = model["vocab"]
    tokens = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        tokens[i] = bytes(stand[c] for c in t) if all(c in stand for c in t) else t.encode()
    pairs = {}
    for rank, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    return Vocabulary(tokens, pairs)


#: Words whose positions are indexed together.
TOGETHER = 50_000


def encode_words(v: Vocabulary, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words that lie at ``starts`` in ``flat`` (bytes), and the number of ids of each word."""
    cuts = [*range(0, len(starts), TOGETHER), len(starts)]
    ends = np.append(starts, len(flat))
    parts = [replay(v, flat[ends[a]:ends[b]], starts[a:b] - ends[a]) for a, b in zip(cuts[:-1], cuts[1:])]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def replay(v: Vocabulary, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge replay over one index."""
    n = len(flat)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
    tok = v.byte_ids[flat]
    lengths = np.diff(np.append(starts, n))
    word = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)
    last = starts + lengths - 1
    nxt = np.arange(1, n + 1, dtype=np.int32)
    nxt[last] = -1
    prv = np.arange(-1, n - 1, dtype=np.int32)
    prv[starts] = -1
    rank = np.full(n, NONE, np.int32)
    inner = np.flatnonzero(nxt >= 0)
    rank[inner] = v.byte_ranks[(flat[inner].astype(np.int32) << 8) | flat[inner + 1]]
    alive = np.ones(n, bool)
    buckets: list[list[np.ndarray]] = [[] for _ in range(len(v.merged) // BUCKET + 1)]

    def index(at: np.ndarray) -> None:
        """Enter positions under the bucket of their pair's rank."""
        b = rank[at] // BUCKET
        order = np.argsort(b, kind="stable")
        at, b = at[order], b[order]
        cuts = np.flatnonzero(np.diff(b)) + 1
        for part, k in zip(np.split(at, cuts), b[np.append(0, cuts)] if len(b) else []):
            buckets[k].append(part)

    index(inner[rank[inner] < NONE].astype(np.int32))
    for k, entries in enumerate(buckets):
        work = np.concatenate(entries) if entries else np.zeros(0, np.int32)
        buckets[k] = []
        top = (k + 1) * BUCKET
        while len(work):
            work = work[rank[work] < top]
            if not len(work):
                break
            # the lowest pair of each word, the leftmost first
            w = word[work].astype(np.int64)
            order = np.argsort((w << 42) | (rank[work].astype(np.int64) << 24) | np.minimum(work - starts[w], (1 << 24) - 1), kind="stable")
            work, w = work[order], w[order]
            lead = np.ones(len(work), bool)
            lead[1:] = w[1:] != w[:-1]
            a = work[lead]
            gone = nxt[a]
            tok[a] = v.merged[rank[a]]
            alive[gone] = False
            rank[gone] = NONE
            after = nxt[gone]
            nxt[a] = after
            more = after >= 0
            prv[after[more]] = a[more]
            rank[a] = NONE
            rank[a[more]] = v.look_up(tok[a[more]], tok[after[more]])
            before = prv[a]
            has = before >= 0
            rank[before[has]] = v.look_up(tok[before[has]], tok[a[has]])
            touched = np.concatenate([a[more], before[has]])
            r = rank[touched]
            now = r < top
            index(touched[(r < NONE) & ~now])
            work = np.concatenate([work[~lead], touched[now]])
    ids = tok[alive]
    return ids, np.add.reduceat(alive, starts).astype(np.int64)


def pieces(offsets: np.ndarray, limit: int = 1 << 19):
    """Ranges of documents of about ``limit`` bytes; a longer document is a range of its own."""
    first = 0
    while first < len(offsets) - 1:
        to = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, to
        first = to


def told_apart(utf8: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seen: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``at`` with a place for each word that only shares another word's hash; ``seen`` then names that place.

    Every occurrence is compared with the first word of its hash, byte by byte.
    """
    first = at[seen]
    odd = lengths != lengths[first]
    again = np.flatnonzero(~odd & (first != np.arange(len(seen))))
    for a in range(0, len(again), TOGETHER):
        own = again[a:a + TOGETHER]
        n = lengths[own]
        differs = utf8[ragged(starts[own], n)] != utf8[ragged(starts[first[own]], n)]
        if differs.any():
            odd[own] = np.logical_or.reduceat(differs, np.cumsum(n) - n)
    places: dict[bytes, int] = {}
    more = []
    for i in np.flatnonzero(odd):
        word = utf8[starts[i]:starts[i] + lengths[i]].tobytes()
        if word not in places:
            places[word] = len(at) + len(more)
            more.append(i)
        seen[i] = places[word]
    return np.append(at, np.array(more, np.int64))


class BlockIds:
    """The ids of a block of documents: ``ids`` all in a row, ``offsets`` of the documents in it."""

    def __init__(self, v: Vocabulary, utf8: np.ndarray, offsets: np.ndarray):
        word_at, hashes, chars, self.word_offsets = [], [], [], np.zeros(len(offsets), np.int64)
        for first, to in pieces(offsets):  # in pieces that fit the caches
            part = utf8[offsets[first]:offsets[to]]
            codes = pretokens.code_points(part)
            ends = np.zeros(len(codes) + 1, np.int64)
            np.cumsum(pretokens.char_bytes(codes), out=ends[1:])
            begin = np.searchsorted(ends, offsets[first:to + 1] - offsets[first])
            starts = pretokens.word_starts(codes, begin[:-1][np.diff(begin) > 0])
            self.word_offsets[first + 1:to + 1] = self.word_offsets[first] + np.searchsorted(starts, begin[1:])
            word_at.append(ends[starts] + offsets[first])
            hashes.append(pretokens.word_hashes(codes, starts))
            chars.append(np.diff(np.append(starts, len(codes))))
        byte_starts = np.concatenate(word_at)
        seen, distinct = pd.factorize(np.concatenate(hashes))
        del word_at, hashes
        at = np.zeros(len(distinct), np.int64)
        at[seen[::-1]] = np.arange(len(seen))[::-1]  # where each distinct word stands first
        lengths = np.diff(np.append(byte_starts, len(utf8)))
        at = told_apart(utf8, byte_starts, lengths, seen, at)
        n = lengths[at]
        words = utf8[ragged(byte_starts[at], n)]
        tokens, counts = encode_words(v, words, np.cumsum(n) - n)
        of = np.cumsum(counts) - counts
        per_word = counts[seen]
        upto = np.zeros(len(seen) + 1, np.int64)
        np.cumsum(per_word, out=upto[1:])
        self.ids = np.empty(upto[-1], tokens.dtype)
        for a in range(0, len(seen), TOGETHER):
            b = min(a + TOGETHER, len(seen))
            self.ids[upto[a]:upto[b]] = tokens[ragged(of[seen[a:b]], per_word[a:b])]
        self.offsets = upto[self.word_offsets]
        self.word_chars, self.word_counts = np.concatenate(chars), per_word


def decode(v: Vocabulary, ids: np.ndarray) -> bytes:
    return v.flat[ragged(v.starts[ids], v.lengths[ids])].tobytes()


def decimal_text(v: Vocabulary, ids: np.ndarray) -> bytes:
    """Decimal ids joined by one space."""
    cells = v.decimal[ids].ravel()
    return cells[cells != 0][:-1].tobytes()


def vocabulary_on_executors(docs: DataFrame, v: Vocabulary):
    ship_package(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(v)  # a few MB, whatever the corpus


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id, ids (array of int) of every document."""
    shared = vocabulary_on_executors(docs, v)

    def run(batches):
        for block in blocks(batches):
            b = BlockIds(shared.value, *text_bytes(block.column("text")))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.ListArray.from_arrays(pa.array(b.offsets.astype(np.int32)), pa.array(b.ids.astype(np.int32)))], ["doc_id", "ids"])

    source = documents(docs)
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_texts(encoded: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id and the text (binary) of the ids."""
    shared = vocabulary_on_executors(encoded, v)

    def run(batches):
        for b in batches:
            texts = [decode(shared.value, np.asarray(i, np.int64)) if i is not None else b"" for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])

    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("text", T.BinaryType())]))


def round_trip(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document, made in one pass over the text."""
    shared = vocabulary_on_executors(docs, v)

    def run(batches):
        for block in blocks(batches):
            v = shared.value
            b = BlockIds(v, *text_bytes(block.column("text")))
            n, ids_sha, text_sha = [], [], []
            for s, e in zip(b.offsets[:-1], b.offsets[1:]):
                ids = b.ids[s:e]
                n.append(e - s)
                ids_sha.append(hashlib.sha256(decimal_text(v, ids)).hexdigest())
                text_sha.append(hashlib.sha256(decode(v, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = documents(docs)
    return source.mapInArrow(run, T.StructType([
        source.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
