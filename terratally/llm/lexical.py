"""Ranked lexical search by Block-Max MaxScore.

1. Documents are cut into terms; those that may belong to an item go on, with their counts, as one row per document.
   "May" is a bitmap of term hashes of at most 2 MB; what it lets through wrongly has no item and falls out below.
2. Documents are dealt to shards of bounded size. A shard's index has, per term, its postings in blocks of 128: last
   document and largest impact of each block in the open, documents and counts compressed.
3. Items and shards meet as (item group, shard) pairs. For each item, the terms' bounds (weight times the largest impact
   in the shard) split its lists: the weakest ones, which cannot reach the threshold together, are non-essential. Only
   essential lists bring candidates, range by range; block maxima of the non-essential lists reject candidates before
   their blocks are unpacked, and what is left is completed list by list, from the strongest on, with a new test after
   each. The heaps of the shards are merged per item by a ranked window.

The threshold starts at what k documents reach with one term alone (from the k-th largest block maximum of a term over
all shards; blocks hold different documents) and follows the shard's own heap from there.

A term is a maximal run of digits, Latin letters (A-Z lower-cased) and signs beyond ASCII. Null texts have no terms. Rows
are documents of their own, also where ids repeat; equal scores go by ascending doc_id, null last. Items that share an
id are one item with the terms of all; items without id or terms give no rows. Empty tables give none.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terratally.llm.common import blocks, parts_for, renewed, ship_package, text_bytes, written

#: Documents and postings of a shard, postings of a block, documents of a range, items of a group, hashes in the bitmap.
SHARD_DOCS, SHARD_POSTINGS, BLOCK, RANGE, GROUP, HASHES = 32768, 4_000_000, 128, 4096, 1024, 1 << 24
#: Bytes of one text that are cut into terms at a time.
PIECE = 1 << 20
K1, B = 1000, 20
KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
LOWER = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in KEPT else 0x20 for b in range(256))


def terms_of(text: bytes) -> Counter:
    """Counts of the terms of a text whose bytes have gone through LOWER."""
    found, at = Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        found.update(text[at:end].split())
        at = end + 1
    return found


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[Counter]]]:
    """Blocks of rows with the term counts of their ``text``."""
    for block in blocks(batches):
        flat, offsets = text_bytes(block.column(block.schema.get_field_index("text")))
        lower = flat.tobytes().translate(LOWER)
        yield block, [terms_of(lower[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term, once each."""
    def split(batches):
        for block, counts in counted(batches):
            reps = np.array([len(c) for c in counts], np.int64)
            ids = block.column(0).take(pa.array(np.repeat(np.arange(len(counts)), reps)))
            yield pa.RecordBatch.from_arrays([ids, pa.array([t for c in counts for t in c], pa.binary())], ["item_id", "term"])

    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).where("item_id IS NOT NULL")
    return rows.mapInArrow(split, "item_id long, term binary").distinct()


def bitmap_of(terms: DataFrame) -> bytes:
    """One bit per hash; at most HASHES / 8 bytes."""
    x = F.crc32("term") % HASHES + 1
    rows = terms.select(F.bitmap_bucket_number(x).alias("b"), F.bitmap_bit_position(x).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = bytearray(HASHES // 8)
    for r in rows.collect():  # 512 rows of 4 KB at most
        out[(r.b - 1) * 4096:r.b * 4096] = r.bits
    return bytes(out)


def document_terms(docs: DataFrame, bitmap: bytes) -> DataFrame:
    """doc_id, n (all terms with repeats), and the terms that the bitmap lets through, with their counts."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap)

    def cut(batches):
        flags, crc, last = bits.value, zlib.crc32, HASHES - 1
        for block, counts in counted(batches):
            terms, tfs, ends = [], [], [0]
            for c in counts:
                for t, tf in c.items():
                    h = crc(t) & last
                    if flags[h >> 3] >> (h & 7) & 1:
                        terms.append(t)
                        tfs.append(tf)
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array([c.total() for c in counts], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary())),
                 pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, n long, terms array<binary>, tfs array<long>").withColumn("uid", F.monotonically_increasing_id())


INDEX = "shard long, term binary, n long, last array<int>, most array<long>, packed array<binary>, doc_ids array<long>, lengths array<long>"
INDEX_SCHEMA = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("last", pa.list_(pa.int32())), ("most", pa.list_(pa.int64())),
                          ("packed", pa.list_(pa.binary())), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (10**9 * tf) // (K1 * tf + B * m)


def pack(docs: np.ndarray, tf: np.ndarray) -> bytes:
    """Steps between documents and counts, in the fewest bytes, compressed."""
    head, body = b"", b""
    for x in (np.diff(docs, prepend=0), tf):
        width = 1 if x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4 if x.max() < 1 << 32 else 8
        head, body = head + bytes([width]), body + x.astype(f"<u{width}").tobytes()
    return head + zlib.compress(body, 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, b = data[0], data[1]
    body = zlib.decompress(data[2:])
    n = len(body) // (a + b)
    return np.cumsum(np.frombuffer(body, f"<u{a}", n).astype(np.int64)), np.frombuffer(body, f"<u{b}", n, n * a).astype(np.int64)


def shard_index(mean: tuple[int, int], block: int):
    """Function from the rows of a shard to its index: one row per term, and one (term null) with its documents."""
    total_docs, total_terms = mean

    def build(rows: pa.Table) -> pa.Table:
        doc = rows.column("doc_id").combine_chunks()
        gone = np.asarray(doc.is_null())
        ids = doc.fill_null(0).to_numpy()
        order = np.lexsort((rows.column("uid").to_numpy(), ids, gone))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        m = 50 + 50 * rows.column("n").to_numpy()[order].astype(np.int64) * total_docs // max(total_terms, 1)
        terms = rows.column("terms").combine_chunks()
        at = np.repeat(place, np.asarray(terms.value_lengths()))
        coded = terms.flatten().dictionary_encode()
        code, tf = coded.indices.to_numpy(), np.asarray(rows.column("tfs").combine_chunks().flatten())
        by = np.lexsort((at, code))
        code, at, tf = code[by], at[by], tf[by]
        impact = impacts(tf, m[at])
        shard = rows.column("shard")[0].as_py()
        out = {f.name: [] for f in INDEX_SCHEMA}
        cuts = np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code))
        for a, b in zip(cuts[:-1], cuts[1:]):
            starts = range(a, b, block)
            out["term"].append(coded.dictionary[int(code[a])].as_py())
            out["n"].append(int(b - a))
            out["last"].append([int(at[min(i + block, b) - 1]) for i in starts])
            out["most"].append([int(impact[i:min(i + block, b)].max()) for i in starts])
            out["packed"].append([pack(at[i:min(i + block, b)], tf[i:min(i + block, b)]) for i in starts])
            out["doc_ids"].append(None)
            out["lengths"].append(None)
        for k, v in (("term", None), ("n", len(ids)), ("last", None), ("most", None), ("packed", None)):
            out[k].append(v)
        out["doc_ids"].append(doc.take(pa.array(order)).to_pylist())
        out["lengths"].append(m.tolist())
        out["shard"] = [shard] * len(out["term"])
        return pa.table(out, schema=INDEX_SCHEMA)

    return build


class Postings:
    """A term's list in a shard; unpacked blocks are kept until there are too many."""

    def __init__(self, last, most, packed, m):
        self.last, self.most, self.packed, self.m, self.seen = np.asarray(last, np.int64), np.asarray(most, np.int64), packed, m, {}
        self.top = int(self.most.max())

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if b not in self.seen:
            if len(self.seen) >= 64:
                self.seen.clear()
            docs, tf = unpack(self.packed[b])
            self.seen[b] = docs, impacts(tf, self.m[docs])
        return self.seen[b]


def search(lists: list[tuple[int, Postings]], n_docs: int, k: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best documents of a shard with a score of at least ``start`` and above 0."""
    lists = sorted(((w * p.top, w, p) for w, p in lists if w > 0), key=lambda x: x[0])
    bounds = np.cumsum([x[0] for x in lists])
    top_d, top_s = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for low in range(0, n_docs, RANGE):
        high = min(low + RANGE, n_docs)
        least = max(start, int(top_s[k - 1]) if len(top_s) == k else 0, 1)
        weak = int(np.searchsorted(bounds, least, side="left"))  # these together stay below
        if weak == len(lists):
            break
        total = np.zeros(high - low, np.int64)
        for _, w, p in lists[weak:]:
            for b in range(int(np.searchsorted(p.last, low)), len(p.last)):
                docs, impact = p.block(b)
                a, z = np.searchsorted(docs, (low, high))
                total[docs[a:z] - low] += w * impact[a:z]
                if p.last[b] >= high - 1:
                    break
        cand = np.flatnonzero(total)
        score, cand = total[cand], cand + low
        if weak and len(cand):
            at = [np.searchsorted(p.last, cand) for _, _, p in lists[:weak]]
            most = np.stack([w * np.append(p.most, 0)[x] for (_, w, p), x in zip(lists[:weak], at)])
            rest = most.sum(axis=0)
            for i in range(weak - 1, -1, -1):
                stay = score + rest >= least
                if not stay.all():
                    cand, score, rest, most, at = cand[stay], score[stay], rest[stay], most[:, stay], [x[stay] for x in at[:i + 1]]
                if not len(cand):
                    break
                _, w, p = lists[i]
                for b in np.unique(at[i]):
                    if b < len(p.last):
                        here = np.flatnonzero(at[i] == b)
                        docs, impact = p.block(int(b))
                        x = np.minimum(np.searchsorted(docs, cand[here]), len(docs) - 1)
                        score[here] += np.where(docs[x] == cand[here], w * impact[x], 0)
                rest = rest - most[i]
        stay = score >= least
        d, s = np.concatenate([top_d, cand[stay]]), np.concatenate([top_s, score[stay]])
        best = np.lexsort((d, -s))[:k]
        top_d, top_s = d[best], s[best]
    return top_d, top_s


FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def searcher(k: int):
    def run(index: pa.Table, items: pa.Table) -> pa.Table:
        if not index.num_rows or not items.num_rows:
            return FOUND.empty_table()
        lists, docs, m = {}, None, None
        rows = index.select(["term", "last", "most", "packed", "doc_ids", "lengths"])
        whole = rows.filter(rows.column("term").is_null())
        docs = whole.column("doc_ids").combine_chunks().flatten()
        m = np.asarray(whole.column("lengths").combine_chunks().flatten())
        rows = rows.filter(rows.column("term").is_valid())
        columns = [rows.column(c) for c in ("last", "most", "packed")]
        for i, t in enumerate(rows.column("term").to_pylist()):
            lists[t] = Postings(*[c[i].as_py() for c in columns], m)
        ids, found, scores = [], [], []
        for item, terms, weights, start in zip(*[items.column(c).to_pylist() for c in ("item_id", "terms", "weights", "start")]):
            d, s = search([(w, lists[t]) for t, w in zip(terms, weights) if t in lists], len(m), k, start)
            ids.append(np.full(len(d), item, np.int64))
            found.append(d)
            scores.append(s)
        return pa.table([np.concatenate(ids), docs.take(pa.array(np.concatenate(found))), np.concatenate(scores)], schema=FOUND)

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, block: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    ship_package(spark)
    asked = written(item_terms(items), "item-terms")
    n_items = asked.agg(F.countDistinct("item_id")).first()[0]
    groups = parts_for(n_items, GROUP)
    hits = written(document_terms(docs, bitmap_of(asked.select("term").distinct())), "document-terms")
    total_docs, total_terms, postings = hits.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    shards = max(parts_for(total_docs, SHARD_DOCS), parts_for(postings, SHARD_POSTINGS))
    dealt = hits.where(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
    index = written(dealt.groupBy("shard").applyInArrow(shard_index((total_docs, total_terms), block), INDEX), "index")

    lists = index.where("term IS NOT NULL")
    weight = F.floor(1000 * F.log((2.0 * total_docs + 2.0) / (2.0 * F.sum("n") + 1.0)))
    weights = lists.groupBy("term").agg(weight.alias("weight"))
    order = Window.partitionBy("term").orderBy(F.desc("top"))
    kth = (lists.select("term", F.explode("most").alias("top")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
           .groupBy("term").agg(F.when(F.count(F.lit(1)) == k, F.min("top")).otherwise(0).alias("kth")))
    grp = F.pmod(F.xxhash64("item_id"), F.lit(groups)).alias("grp")
    weighed = written(asked.join(weights.join(kth, "term"), "term").select("item_id", grp, "term", "weight", (F.col("weight") * F.col("kth")).alias("start")), "weights")
    one = weighed.groupBy("grp", "item_id").agg(F.collect_list(F.struct("term", "weight")).alias("t"), F.max("start").alias("start"))
    one = one.select("grp", "item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"), "start")
    one = one.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    used = lists.join(renewed(weighed.select("term", "grp").distinct()), "term")
    docs_row = index.where("term IS NULL").withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    keys = ["shard", "grp"]
    found = used.unionByName(docs_row).groupBy(*keys).cogroup(one.groupBy(*keys)).applyInArrow(searcher(k), "item_id long, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
