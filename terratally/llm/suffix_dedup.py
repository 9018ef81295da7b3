"""Suffix-array deduplication: bytes covered by a string of LENGTH bytes that also starts earlier are removed.

Induced sorting, bounded to the LENGTH bytes that matter and carried out over Spark's exchanges:

1. Sample suffixes. In every window of LENGTH bytes the sample is the suffix that starts at the least KEY-byte hash
   (the leftmost of equals). The choice depends on the window's bytes alone, so equal windows have equal samples at
   equal offsets, and every other suffix is induced from the sample after it.
2. Sample tuples (key name, context name, document, position) are exchanged by key name. Tuples with the same context
   stand for the same windows: the earliest keeps them, the others are repeats as a whole. A tuple meets others on its
   key alone only at the edges of repeats; only there the bytes are needed.
3. These tuples fetch their bytes and are exchanged by key again. Each task sorts its suffixes, computes the common
   prefix of neighbours, and induces the windows that start before the samples: step by step to the left, a window's
   class is that of its left bytes so far, refined by the next byte, together with the class of its suffix among those
   with a common prefix of the bytes that remain. The first of a class keeps its bytes.
4. Removed windows go to their documents and are merged into runs.

Sorted runs that are larger than memory are spilled to disk and merged by the exchanges. Comparison ends after LENGTH
bytes, so the induction is one level deep and no recursion on names is needed. Repeats are collapsed in each block
before the first exchange, so a text that fills a third of all rows is at most one tuple a block. Buckets of keys that
still stand out are split by context, and their windows are exchanged one by one, under 128-bit names, instead of
being gathered by key; that is exact as well. Tuples travel in packed arrays.

Documents are ordered by doc_id (null: last), and count as bytes of UTF-8; matches never cross documents. Defined
results: null or empty: 0 bytes, nothing removed; rows that repeat both doc_id and text get the same result and are
no earlier copies of each other; rows that share a doc_id but not the text are ordered by a hash of the text; an empty
table gives no rows. Names are 96 bits and more; equal names count as equal bytes, except at the edges of repeats,
where bytes are compared.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratally.llm.bpe import pieces
from terratally.llm.common import blocks, documents, mixed, parts_for, ragged, ship_package, text_bytes, written

LENGTH, KEY = 100, 32
SPAN = LENGTH - KEY + 1
CONTEXT = LENGTH + SPAN - 1
POSITION = np.uint64((1 << 28) - 1)
LAST = 2**63 - 1
BLOCK, BUCKET_BYTES, DOC_BUCKET_BYTES = 8 << 20, 32 << 20, 16 << 20
#: A bucket with so many times the mean is split.
HOT = 8
BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
LOW48 = np.uint64((1 << 48) - 1)

TUPLE = ("<i8", "<u8", "<u4", "u1", "u1", "<u4", "<u2", "<u4", "<u2")  # doc, text, start, span, least, key (two parts), context (two parts)
MARK = ("<i8", "<u8", "<u4", "<u4")  # doc, text, start, end
REQUEST = ("<i8", "<u8", "<u4", "u1", "u1", "<u8", "u1")  # doc, text, start, span, least, key, hot
EDGE = ("<i8", "<u8", "<u4", "u1", "u1", "<u8")
WINDOW = ("<u8", "<u8", "<i8", "<u8", "<u4")  # name (two parts), doc, text, start


def packed(arrays, kinds, extra: bytes = b"") -> bytes:
    n = len(arrays[0])
    return zstandard.ZstdCompressor(1).compress(np.int64(n).tobytes() + b"".join(np.ascontiguousarray(a, k).tobytes() for a, k in zip(arrays, kinds)) + extra)


def unpacked(raw: bytes, kinds):
    data = zstandard.ZstdDecompressor().decompress(raw)
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out, np.frombuffer(data, np.uint8, offset=at)


def gathered(raws, kinds):
    parts = [unpacked(r, kinds)[0] for r in raws]
    return [np.concatenate(c) if parts else np.zeros(0, k) for c, k in zip(zip(*parts) if parts else [()] * len(kinds), kinds)]


def by_bucket(kind: int, bucket: np.ndarray, arrays, kinds):
    """(kind, bucket, packed rows) for every bucket."""
    order = np.argsort(bucket, kind="stable")
    arrays, bucket = [a[order] for a in arrays], bucket[order]
    cut = np.append(0, np.flatnonzero(np.diff(bucket)) + 1) if len(bucket) else np.zeros(0, np.int64)
    for s, e in zip(cut, np.append(cut[1:], len(bucket))):
        yield kind, int(bucket[s]), int(e - s), packed([a[s:e] for a in arrays], kinds)


def two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the concatenation of two hashed strings."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x


def row_names(doc: np.ndarray, text: np.ndarray) -> np.ndarray:
    return two(mixed(doc.astype(np.int64).view(np.uint64)), text.astype(np.uint64))


def doc_bucket(doc: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Rows that share a doc_id but not the text (all null ids, for one) are dealt to different buckets."""
    return (mixed(row_names(doc, text)) % np.uint64(n)).astype(np.int64)


def rows_of(block, utf8, offsets):
    """doc (null: LAST) and a 64-bit hash of the text of each row."""
    doc = block.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
    raw = memoryview(np.ascontiguousarray(utf8))
    text = np.array([int.from_bytes(hashlib.blake2b(raw[s:e], digest_size=8).digest(), "little") for s, e in zip(offsets[:-1], offsets[1:])], np.uint64)
    return doc, text


def samples(utf8: np.ndarray, offsets: np.ndarray):
    """(row, start, span, least, key, context) of every sample: the windows from start to start + span have it as theirs,
    at the offset least + span in the first and least in the last."""
    sizes = np.diff(offsets)
    long = sizes >= LENGTH
    i = ragged(offsets[:-1][long], sizes[long] - LENGTH + 1)
    if not len(i):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    h = BYTES[utf8]
    h4 = None
    for level in (1, 2, 4, 8, 16):
        h = two(h[:-level], h[level:])
        if level == 2:
            h4 = h
    low = (h & ~POSITION) | (np.arange(len(h), dtype=np.uint64) & POSITION)
    for step in (1, 2, 4, 8, 16, 32):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[:-(SPAN - 64)], low[SPAN - 64:])
    p = i + ((low[i] - i.astype(np.uint64)) & POSITION).astype(np.int64)
    new = np.ones(len(i), bool)
    new[1:] = (p[1:] != p[:-1]) | (i[1:] != i[:-1] + 1)
    at = np.flatnonzero(new)
    first, last, p = i[at], i[np.append(at[1:], len(i)) - 1], p[at]

    def window(j):
        return two(two(h[j], h[j + 32]), two(h[j + 64], h4[j + 96]))

    span, least = last - first, p - last
    row = np.searchsorted(offsets, first, side="right") - 1
    context = mixed(two(window(first), window(last)) + (span << 8 | least).astype(np.uint64))
    return [row, first - offsets[row], span, least, mixed(h[p]), context]


def sample_table(docs: DataFrame, buckets: int, doc_buckets: int) -> DataFrame:
    """Written table (kind, bucket, size, rows): kind 0 sample tuples by key bucket, kind 1 marks by document bucket."""
    def run(batches):
        for block in blocks(batches, BLOCK):
            utf8, offsets = text_bytes(block.column("text"))
            doc, text = rows_of(block, utf8, offsets)
            parts = [samples(utf8[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) + [a] for a, b in pieces(offsets)]
            row = np.concatenate([p[0] + p[-1] for p in parts])
            start, span, least, key, context = (np.concatenate([p[k] for p in parts]) for k in range(1, 6))
            keep, out = np.ones(len(row), bool), []
            name = two(key, context)
            again = np.flatnonzero(pd.Series(name).duplicated(keep=False).to_numpy())
            if len(again):
                order = again[np.lexsort((start[again], text[row[again]], doc[row[again]], name[again]))]
                d, t, s, n = doc[row[order]], text[row[order]], start[order], name[order]
                same = np.append(False, n[1:] == n[:-1])
                lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                keep[order[same]] = False
                later = same & ((d != d[lead]) | (t != t[lead]) | (s != s[lead]))
                o = order[later]
                out += by_bucket(1, doc_bucket(d[later], t[later], doc_buckets), [d[later], t[later], start[o], start[o] + span[o] + LENGTH], MARK)
            k = np.flatnonzero(keep)
            key, context = key[k], context[k]
            bucket = (mixed(key) % np.uint64(buckets)).astype(np.int64)
            arrays = [doc[row[k]], text[row[k]], start[k], span[k], least[k], key & np.uint64(0xFFFFFFFF), (key & LOW48) >> np.uint64(32), context & np.uint64(0xFFFFFFFF), (context & LOW48) >> np.uint64(32)]
            out += by_bucket(0, bucket, arrays, TUPLE)
            yield batch_of(out)

    return written(documents(docs).mapInArrow(run, ROWS), "samples")


ROWS = "kind int, bucket long, size long, rows binary"


def batch_of(out) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["kind", "bucket", "size", "rows"])


def table_of(out) -> pa.Table:
    return pa.Table.from_batches([batch_of(out)])


def elect(doc_buckets: int):
    """By key bucket: the earliest tuple of each context keeps its windows; those that share their key with another context ask for bytes."""
    def run(table: pa.Table) -> pa.Table:
        hot = bool(table.column("hot")[0].as_py())
        doc, text, start, span, least, k_low, k_high, c_low, c_high = gathered(table.column("rows").to_pylist(), TUPLE)
        key = k_low.astype(np.uint64) | k_high.astype(np.uint64) << np.uint64(32)
        context = c_low.astype(np.uint64) | c_high.astype(np.uint64) << np.uint64(32)
        among = np.arange(len(key)) if hot else np.flatnonzero(pd.Series(key).duplicated(keep=False).to_numpy())
        order = among[np.lexsort((start[among], text[among], doc[among], context[among], key[among]))]
        key, context, doc, text, start, span, least = (a[order] for a in (key, context, doc, text, start, span, least))
        same = np.append(False, (key[1:] == key[:-1]) & (context[1:] == context[:-1])) if len(key) else np.zeros(0, bool)
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(key)))) if len(key) else np.zeros(0, np.int64)
        later = same & ((doc != doc[lead]) | (text != text[lead]) | (start != start[lead]))
        d, t = doc[later], text[later]
        out = list(by_bucket(1, doc_bucket(d, t, doc_buckets), [d, t, start[later], start[later].astype(np.int64) + span[later] + LENGTH], MARK))
        ask = ~same
        if not hot:
            _, group = np.unique(key[ask], return_inverse=True)
            ask[np.flatnonzero(ask)[np.bincount(group)[group] < 2]] = False
        d, t = doc[ask], text[ask]
        out += by_bucket(2, doc_bucket(d, t, doc_buckets), [d, t, start[ask], span[ask], least[ask], key[ask], np.full(len(d), hot)], REQUEST)
        return table_of(out)

    return run


def split_hot(tuples: DataFrame) -> DataFrame:
    """Rows (bucket, salt, hot, rows): buckets far above the mean are dealt to salts by context."""
    loads = tuples.groupBy("bucket").agg(F.sum("size").alias("load"))
    n, mean = loads.agg(F.count(F.lit(1)), F.avg("load")).first()
    if not n:
        return tuples.select("bucket", F.lit(0).alias("salt"), F.lit(False).alias("hot"), "rows")
    # one row per bucket, of 32 MB of text each
    salts = F.broadcast(loads.select("bucket", F.when(F.col("load") > HOT * mean, F.ceil(F.col("load") / mean)).otherwise(1).cast("int").alias("salts")))
    dealt = tuples.join(salts, "bucket")

    def run(batches):
        for b in batches:
            for bucket, salts, raw in zip(*(b.column(c).to_pylist() for c in ("bucket", "salts", "rows"))):
                arrays = unpacked(raw, TUPLE)[0]
                out = list(by_bucket(0, (mixed(arrays[7].astype(np.uint64)) % np.uint64(salts)).astype(np.int64), arrays, TUPLE))
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(out), pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([True] * len(out)), pa.array([o[3] for o in out], pa.binary())], ["bucket", "salt", "hot", "rows"])

    plain = dealt.where("salts = 1").select("bucket", F.lit(0).alias("salt"), F.lit(False).alias("hot"), "rows")
    return plain.unionByName(dealt.where("salts > 1").select("bucket", "salts", "rows").mapInArrow(run, "bucket long, salt int, hot boolean, rows binary"))


def packed_docs(docs: DataFrame, doc_buckets: int) -> DataFrame:
    """Documents by document bucket: doc, text hash, null flag, size and all bytes in one compressed value."""
    def run(batches):
        for block in blocks(batches, BLOCK):
            utf8, offsets = text_bytes(block.column("text"))
            doc, text = rows_of(block, utf8, offsets)
            void = block.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            bucket = doc_bucket(doc, text, doc_buckets)
            sizes, out = np.diff(offsets), []
            for b in np.unique(bucket):
                at = np.flatnonzero(bucket == b)
                out.append((3, int(b), len(at), packed([doc[at], text[at], void[at], sizes[at]], DOCS, utf8[ragged(offsets[at], sizes[at])].tobytes())))
            yield batch_of(out)

    return documents(docs).mapInArrow(run, ROWS)


DOCS = ("<i8", "<u8", "u1", "<i8")


def bucket_docs(raws):
    parts = [unpacked(r, DOCS) for r in raws]
    doc, text, void, size = (np.concatenate([p[0][k] for p in parts]) if parts else np.zeros(0, DOCS[k]) for k in range(4))
    data = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint8)
    return doc, text, void.astype(bool), size, np.cumsum(size) - size, data


def fetch(edge_buckets: int):
    """By document bucket: the bytes that were asked for, by key (kind 4), or as named windows if the key is hot (kind 5)."""
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows and asked.num_rows:
            doc, text, _, size, at, data = bucket_docs(docs.column("rows").to_pylist())
            names = row_names(doc, text)
            order = np.argsort(names)
            d, t, start, span, least, key, hot = gathered(asked.column("rows").to_pylist(), REQUEST)
            row = order[np.searchsorted(names[order], row_names(d, t))]
            from_ = at[row] + start
            hot = hot.astype(bool)
            for some in np.array_split(np.flatnonzero(~hot), 1 + len(d) // 50_000):
                cells = data[np.minimum(from_[some][:, None] + np.arange(CONTEXT), len(data) - 1)]
                b = (mixed(key[some] + np.uint64(7)) % np.uint64(edge_buckets)).astype(np.int64)
                for g in np.unique(b):
                    k = some[b == g]
                    out.append((4, int(g), len(k), packed([d[k], t[k], start[k], span[k], least[k], key[k]], EDGE, cells[b == g].tobytes())))
            for some in np.array_split(np.flatnonzero(hot), 1 + len(d) // 5_000):
                n = span[some].astype(np.int64) + 1
                j = ragged(from_[some], n)
                if not len(j):
                    continue
                cells = data[j[:, None] + np.arange(LENGTH)].astype(np.uint64) + np.uint64(1)
                a, b = (mixed((cells * mixed(np.arange(1, LENGTH + 1, dtype=np.uint64) * np.uint64(s))).sum(axis=1, dtype=np.uint64)) for s in (3, 5))
                w = np.repeat(some, n)
                out += by_bucket(5, (b % np.uint64(edge_buckets)).astype(np.int64), [a, b, d[w], t[w], j - at[row[w]]], WINDOW)
        return table_of(out)

    return run


def induced(key, doc, text, start, span, least, cells):
    """(row, window start) of all windows that stand earlier in another tuple of the same key. cells: the bytes from start on."""
    n = len(key)
    most = least.astype(np.int64) + span
    p = start.astype(np.int64) + most
    order = np.lexsort((p, text, doc))
    key, most, least, p, cells = key[order], most[order], least[order].astype(np.int64), p[order], cells[order]
    # sort the sample suffixes, and the common prefix of neighbours
    right = np.minimum(most[:, None] + np.arange(LENGTH), CONTEXT - 1)
    right = np.where(np.arange(LENGTH) < LENGTH - least[:, None], np.take_along_axis(cells, right, 1), 0).astype(np.uint8)
    wide = np.zeros((n, -(-LENGTH // 8) * 8), np.uint8)
    wide[:, :LENGTH] = right
    ranked = np.lexsort((*wide.view(">u8").T[::-1], key))
    prefix = np.full(n, -1, np.int64)
    a, b = right[ranked[1:]], right[ranked[:-1]]
    differ = a != b
    prefix[1:] = np.where(key[ranked[1:]] != key[ranked[:-1]], -1, np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH))
    # induce the windows to the left, a byte at a time
    _, left = np.unique(key, return_inverse=True)
    rows, starts = [], []
    reach = np.arange(n)
    for d in range(SPAN):
        if d:
            reach = reach[most[reach] >= d]
            left[reach] = pd.factorize(left[reach] * 256 + cells[reach, most[reach] - d])[0]
        here = reach[least[reach] <= d]
        if len(here) < 2:
            continue
        suffix = np.zeros(n, np.int64)
        suffix[ranked] = np.cumsum(prefix < LENGTH - d)
        later = here[pd.Series(suffix[here] * n + left[here]).duplicated().to_numpy()]
        rows.append(order[later])
        starts.append(p[later] - d)
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, starts))


def window_marks(doc, text, start, doc_buckets: int):
    """Marks of removed windows, neighbours joined."""
    order = np.lexsort((start, text, doc))
    doc, text, start = doc[order], text[order], start[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    end = start[np.append(at[1:], len(doc)) - 1] + LENGTH if len(at) else start[:0]
    return by_bucket(1, doc_bucket(doc[at], text[at], doc_buckets), [doc[at], text[at], start[at], end], MARK)


def resolve(doc_buckets: int):
    """By key or window bucket: marks of the windows that repeat an earlier one."""
    def run(table: pa.Table) -> pa.Table:
        kinds, raws = table.column("kind").to_pylist(), table.column("rows").to_pylist()
        out = []
        edges = [unpacked(r, EDGE) for k, r in zip(kinds, raws) if k == 4]
        if edges:
            doc, text, start, span, least, key = (np.concatenate([e[0][c] for e in edges]) for c in range(6))
            cells = np.concatenate([e[1].reshape(-1, CONTEXT) for e in edges])
            rows, starts = induced(key, doc, text, start, span, least, cells)
            out += window_marks(doc[rows], text[rows], starts, doc_buckets)
        windows = [r for k, r in zip(kinds, raws) if k == 5]
        if windows:
            a, b, doc, text, start = gathered(windows, WINDOW)
            order = np.lexsort((start, text, doc, b, a))
            again = order[1:][(a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])]
            out += window_marks(doc[again], text[again], start[again], doc_buckets)
        return table_of(out)

    return run


def strip(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """By document bucket: what is left of each document, and the removed runs."""
    doc, text, void, size, at, data = bucket_docs(docs.column("rows").to_pylist())
    gone = np.zeros(len(data) + 1, np.int32)
    if marks.num_rows and len(doc):
        d, t, start, end = gathered(marks.column("rows").to_pylist(), MARK)
        names, wanted = row_names(doc, text), row_names(d, t)
        order = np.argsort(names, kind="stable")
        # a row that is there several times takes its marks each time
        lo, hi = np.searchsorted(names[order], wanted), np.searchsorted(names[order], wanted, side="right")
        row, m = order[ragged(lo, hi - lo)], np.repeat(np.arange(len(d)), hi - lo)
        np.add.at(gone, at[row] + start[m], 1)
        np.add.at(gone, at[row] + end[m], -1)
    removed = np.cumsum(gone[:-1]) > 0
    first = np.zeros(len(data), bool)
    first[at[size > 0]] = True
    begin = removed.copy()
    begin[1:] &= ~removed[:-1] | first[1:]
    last = removed.copy()
    last[:-1] &= ~removed[1:] | first[1:]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    of = np.append(np.searchsorted(begins, at), len(begins)) if len(doc) else np.zeros(1, np.int64)
    row = np.repeat(np.arange(len(doc)), np.diff(of))
    kept = [data[s:s + n][~removed[s:s + n]].tobytes() for s, n in zip(at, size)]
    lists = [pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(x - at[row])) for x in (begins, ends)]
    return pa.table({"doc_id": pa.array(doc, pa.int64(), mask=void), "n_bytes": pa.array(size, pa.int64()), "starts": lists[0], "ends": lists[1], "kept": pa.array(kept, pa.binary())})


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, starts and ends of the removed runs, and kept, the bytes that are left, of every row."""
    ship_package(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = docs.sparkSession.sparkContext.defaultParallelism
    buckets, doc_buckets = parts_for(size, BUCKET_BYTES, least), parts_for(size, DOC_BUCKET_BYTES, least)
    table = sample_table(docs, buckets, doc_buckets)
    elected = written(split_hot(table.where("kind = 0")).groupBy("bucket", "salt").applyInArrow(elect(doc_buckets), ROWS), "elected")
    asked = elected.where("kind = 2")
    by_doc = packed_docs(docs, doc_buckets).groupBy("bucket")
    edges = written(by_doc.cogroup(asked.groupBy("bucket")).applyInArrow(fetch(buckets), ROWS), "edges")
    resolved = written(edges.groupBy("bucket").applyInArrow(resolve(doc_buckets), ROWS), "resolved")
    marks = table.where("kind = 1").unionByName(elected.where("kind = 1")).unionByName(resolved.where("kind = 1"))
    return by_doc.cogroup(marks.groupBy("bucket")).applyInArrow(
        strip, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")
