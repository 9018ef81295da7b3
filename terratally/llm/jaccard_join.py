"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct shingles of five words (A-Z lower-cased; words are runs of anything but ASCII
white space); with fewer words the whole sequence is the one shingle. Two documents link when
100 * |A and B| >= 80 * |A or B|. The result is one row per document with the smallest doc_id it is linked to over any
number of links.

* Sets of the same shingles are one node, so exact copies never multiply. Nodes have numbers of their own, so texts that
  share a doc_id stay different nodes.
* Size bands: linked sets differ in size by at most a quarter, so a set of band b meets bands b and b - 1 only. In
  join band b the symmetric difference of linked sets is at most D(b) = 2 * (largest size) / 9.
* Parity sketch: the range of shingle hashes is cut into P(b) > D(b) pieces, and a piece's sketch is the XOR of its
  shingles' hashes. One differing shingle touches one piece, so linked sets agree in at least P(b) - D(b) pieces
  (pigeonhole). Sets meet on equal pieces that are not empty. A set can miss all its partners that way only if it
  has at most D(b) pieces that are not empty; such sets also meet on the pieces of a second, independent cut, and if
  they are that sparse there too, on the band itself.
* A second sketch flips one bit per shingle. The Hamming distance of two such sketches is a lower bound of the
  symmetric difference; candidates above the bound of their sizes go.
* Verification compares the whole sets.

Groups of equal pieces are never expanded into all pairs. A set leaves those of more than SMALL members if it is in
fewer of them than it must have keys in common with a linked set: a passage that many texts hold brings nobody together. Small ones (up to SMALL) give their few pairs. Of a larger
one, each member is verified against the group's first member and its neighbour in order. Members that this has not
made one class are compared by sketches inside the task that holds the group (or, for more than TILE members, the
pair of tiles), where pairs inside a class are skipped; groups that share members are compared as one where that is
less work; first a spanning forest of the surviving pairs is verified,
then whatever still lies between classes. No link between different sets is lost.

Pieces travel as packed arrays, one row for each block of documents and bucket. Their 32-bit keys only propose
candidates, so a clash costs a comparison and no error. Identity of sets rests on two 64-bit sums, and that of shingles
on 64 bits mixed from the names of their words: words of up to 7 bytes are their own name, longer ones go by BLAKE2b.

Groups and clusters can hold a third of all sets, so rows meet the one row of their group or cluster in parts (SPLIT).

Defined results: no words or null: size 0, its own class. A null doc_id stays without class; a repeated doc_id has a row
for each of its rows, with the class of that row's text; an empty table gives no rows.
"""
from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terratally.llm.bpe import pieces as cache_pieces
from terratally.llm.common import blocks, components, documents, done_with, drop_written, mixed, noted, parts_for, ship_package, text_bytes, text_digest, without, written
from terratally.llm.pretokens import BASE

WORDS = 5
#: Bytes of a word that its name holds as they are.
PACKED = 7
NUMERATOR, DENOMINATOR = 80, 100
SMALL, TILE = 8, 1024
#: Members of a group that meet its row in one part, and parts of every cluster.
SPLIT, CLUSTER_PARTS = 4096, 16
#: Groups of up to FEW members share calls, with about PER_DEAL rows in each.
FEW, PER_DEAL = 256, 4096
BUCKET_BYTES = 4 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(1)
def bands() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size of each band, its largest symmetric difference, and its number of pieces."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * DENOMINATOR // NUMERATOR)))
    first = np.array(edges, np.int64)
    largest = np.append(first[1:], first[-1] * 2) - 1
    most = 2 * largest * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
    pieces = most + 1 + np.where(most > 0, np.ceil(0.08 * most) + np.ceil(2.5 * np.sqrt(most)), 0).astype(np.int64)
    return first, most, pieces


def sketch_words(size: int) -> int:
    """64-bit words of the bit sketch of a set: about one bit per shingle, a power of two."""
    return 1 << max(0, (max(size, 1) - 1).bit_length() - 6)


def block_sets(utf8: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all documents of a block, distinct and sorted in each document, and the documents' offsets."""
    parts = [piece_sets(utf8[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in cache_pieces(offsets)]
    sizes = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64), np.append(0, np.cumsum(sizes))


def word_names(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit name of each word: up to PACKED bytes as they are with their number, longer words by a cryptographic digest."""
    lengths = ends - starts
    padded = np.append(text, np.zeros(PACKED, np.uint8))
    names = np.minimum(lengths, PACKED + 1).astype(np.uint64) << np.uint64(8 * PACKED)
    for k in range(PACKED):
        names |= np.where(lengths > k, padded[starts + k], 0).astype(np.uint64) << np.uint64(8 * k)
    long = np.flatnonzero(lengths > PACKED)
    raw = text.tobytes()
    words = [raw[s:e] for s, e in zip(starts[long].tolist(), ends[long].tolist())]
    digests = {w: int.from_bytes(blake2b(w, digest_size=8).digest(), "little") for w in set(words)}
    names = mixed(names)
    names[long] = np.array([digests[w] for w in words], np.uint64)
    return names


def piece_sets(utf8: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a few documents, and the sizes of their sets."""
    n = len(utf8)
    text = LOWER[utf8]
    word = ~WHITE[text]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | first[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    h = word_names(text, starts, ends)
    of = np.searchsorted(starts, offsets)
    chain = h.copy()
    for k in range(1, WORDS):
        nxt = np.zeros_like(h)
        nxt[:len(h) - k] = h[k:] if len(h) > k else 0
        chain = mixed(chain * BASE + nxt)
    out, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(of[:-1], of[1:])):
        if b - a >= WORDS:
            s = np.sort(chain[a:b - WORDS + 1])
            s = s[np.append(True, s[1:] != s[:-1])]
        elif b > a:
            whole = h[a:a + 1]
            for k in range(a + 1, b):
                whole = mixed(whole * BASE + h[k:k + 1])
            s = mixed(whole + np.uint64(b - a))
        else:
            continue
        out.append(s)
        sizes[i] = len(s)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), sizes


def salted(k: int) -> np.uint64:
    return np.uint64(k * int(BASE) & ((1 << 64) - 1))


def identities(shingles: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit identities of each set."""
    out = []
    for salt in (1, 2):
        total = np.zeros(len(shingles) + 1, np.uint64)
        np.cumsum(mixed(shingles + salted(salt)), out=total[1:])
        out.append(mixed(total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def bit_sketch(shingles: np.ndarray) -> bytes:
    words = sketch_words(len(shingles))
    bits = np.bincount((shingles & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def pieces_of(shingles: np.ndarray, doc: np.ndarray, band: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of every piece that is not empty; shingles are sorted in each document."""
    _, _, count = bands()
    h = shingles if not salt else mixed(shingles + salted(salt))
    if salt:
        order = np.lexsort((h, doc))
        h, doc, band = h[order], doc[order], band[order]
    piece = ((h >> np.uint64(32)) * count[band].astype(np.uint64)) >> np.uint64(32)
    new = np.ones(len(h), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return doc[:0], h[:0]
    parity = np.bitwise_xor.reduceat(mixed(h), at)
    return doc[at], mixed(parity + mixed((band[at].astype(np.uint64) << np.uint64(33)) + (piece[at] << np.uint64(1)) + np.uint64(salt)))


def block_keys(shingles: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of all sets in the two join bands of each."""
    return spared_keys(shingles, offsets)[:2]


def spared_keys(shingles: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key) of all sets in the two join bands of each; and of each document, the keys it can do without.

    A set has at least (pieces that are not empty) - D(b) keys in common with a linked one. It meets it still if it
    leaves any fewer keys out.
    """
    first, most, _ = bands()
    sizes = np.diff(offsets)
    own = np.searchsorted(first, sizes, side="right") - 1
    doc = np.repeat(np.arange(len(sizes)), sizes)
    docs, keys, spare = [], [], np.full(len(sizes), np.iinfo(np.int64).max)
    for up in (0, 1):
        d, k = pieces_of(shingles, doc, (own + up)[doc], 0)
        docs.append(d)
        keys.append(k)
        filled = np.bincount(d, minlength=len(sizes))
        spare = np.minimum(spare, filled - most[own + up] - 1)
        sparse = (filled <= most[own + up]) & (sizes > 0)
        if sparse.any():
            among = sparse[doc]
            d, k = pieces_of(shingles[among], doc[among], (own + up)[doc[among]], 1)
            filled = np.bincount(d, minlength=len(sizes))
            still = np.flatnonzero(sparse & (filled <= most[own + up]))
            docs += [d, still]
            keys += [k, mixed((own[still] + up).astype(np.uint64) + salted(3))]
    return np.concatenate(docs), np.concatenate(keys), spare


def sketched(docs: DataFrame, buckets: int) -> DataFrame:
    """Written table with a row per document (kind 0: doc_id, digest, n, a, b, sketch, spare) and packed pieces (kind 1: bucket, sets, counts, keys)."""
    ship_package(docs.sparkSession)
    source = documents(docs, text_digest().alias("digest"))
    schema = T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()),
        T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("sketch", T.BinaryType()),
        T.StructField("bucket", T.LongType()), T.StructField("sets", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("keys", T.BinaryType()), T.StructField("spare", T.LongType())])
    types = [pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 3, pa.binary(), pa.int64(), *[pa.binary()] * 3, pa.int64()]
    names = [f.name for f in schema]

    def rows(*columns):
        size = max(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, types)], names)

    def run(batches):
        for block in blocks(batches):
            shingles, offsets = block_sets(*text_bytes(block.column("text")))
            sizes = np.diff(offsets)
            a, b = identities(shingles, offsets)
            sketches = [bit_sketch(shingles[s:e]) for s, e in zip(offsets[:-1], offsets[1:])]
            _, one, of = np.unique(a, return_index=True, return_inverse=True)  # a set is sent once a block
            lone = np.zeros(len(sizes), bool)
            lone[one] = True
            keep = np.repeat(lone, sizes)
            doc, key, spare = spared_keys(shingles[keep], np.append(0, np.cumsum(np.where(lone, sizes, 0))))
            bucket, short = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), key.astype(np.uint32)
            order = np.lexsort((short, doc, bucket))
            doc, key, bucket = doc[order], short[order], bucket[order]
            # keys of a set that fall together count once
            same = np.flatnonzero((key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (bucket[1:] == bucket[:-1]))
            spare = spare - np.bincount(doc[same], minlength=len(sizes))
            yield rows(np.zeros(len(sizes), np.int32), block.column("doc_id").cast(pa.int64()), block.column("digest").cast(pa.binary()), sizes, a, b, sketches, None, None, None, None, spare[one][of])
            cut = np.flatnonzero(np.diff(bucket)) + 1
            which, sets, counts, keys = [], [], [], []
            for d, k, g in zip(np.split(doc, cut), np.split(key, cut), bucket[np.append(0, cut)] if len(bucket) else []):
                new = np.append(0, np.flatnonzero(np.diff(d)) + 1)
                which.append(int(g))
                sets.append(a[d[new]].tobytes())
                counts.append(np.diff(np.append(new, len(d))).astype("<i4").tobytes())
                keys.append(k.astype("<u4").tobytes())
            if which:
                yield rows(np.ones(len(which), np.int32), None, None, None, None, None, None, which, sets, counts, keys, None)

    return written(source.mapInArrow(run, schema), "sketches")


def bucket_groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of sets with an equal key, from small groups, and the members of larger ones (v null) under a group id with the group's size and number of keys."""
    sets = [np.frombuffer(x, "<i8") for x in pdf["sets"]]
    counts = [np.frombuffer(x, "<i4") for x in pdf["counts"]]
    key = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["keys"]])
    member = np.repeat(np.concatenate(sets), np.concatenate(counts))
    order = np.lexsort((member, key))
    key, member = key[order], member[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (member[1:] != member[:-1])
    key, member = key[new], member[new]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(at, len(key)))
    us, vs = [], []
    for m in range(2, SMALL + 1):
        s = at[size == m]
        for i in range(m):
            for j in range(i + 1, m):
                us.append(member[s + i])
                vs.append(member[s + j])
    bucket = int(pdf["bucket"].iloc[0])
    seen, gs, ms, sizes, times = {}, [], [], [], []
    for s, m in zip(at[size > SMALL], size[size > SMALL]):
        own = member[s:s + m]
        mark = hash(own.tobytes())
        if mark in seen:
            times[seen[mark]] += 1  # the same members meet on another key
            continue
        seen[mark] = len(times)
        times.append(1)
        gs.append(np.full(m, (bucket << 32) + int(key[s])))
        ms.append(own)
        sizes.append(np.full(m, m))
        us += [np.full(m - 1, own[0]), own[1:-1]]
        vs += [own[1:], own[2:]]
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    pairs = pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)}).drop_duplicates()
    times = [np.full(len(x), n) for x, n in zip(ms, times)]
    g, m, size, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (gs, ms, sizes, times))
    none = pd.array([None] * len(pairs), "Int64")
    return pd.concat([pd.DataFrame({"grp": none, "u": pairs["u"].to_numpy(), "v": pd.array(pairs["v"].to_numpy(), "Int64"), "size": none, "times": none}),
                      pd.DataFrame({"grp": pd.array(g, "Int64"), "u": m, "v": pd.array([None] * len(g), "Int64"), "size": pd.array(size, "Int64"), "times": pd.array(times, "Int64")})])


def bound(na, nb):
    """Largest symmetric difference of linked sets of these sizes, or -1 if their sizes rule a link out."""
    fits = np.minimum(na, nb) * DENOMINATOR >= np.maximum(na, nb) * NUMERATOR
    return np.where(fits, (na + nb) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR), -1)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch cut down to fewer words: parities add up."""
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def cross_pairs_of(forest: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return cross_pairs(pdf, forest)

    return run


def cross_pairs(pdf: pd.DataFrame, forest: bool) -> pd.DataFrame:
    """Pairs of members in different classes that sizes and sketches let through; of these a spanning forest on demand."""
    pdf = pdf.sort_values(["grp", "n"], kind="stable")
    n, node, tile, root, grp = (pdf[c].to_numpy() for c in ("n", "node", "tile", "root", "grp"))
    raw = [np.frombuffer(x, "<u8") for x in pdf["sketch"]]
    cuts = np.flatnonzero(grp[1:] != grp[:-1]) + 1
    us, vs = [node[:0]], [node[:0]]
    for a, b in zip([0, *cuts], [*cuts, len(grp)]):
        pairs_of_group(n[a:b], node[a:b], tile[a:b], root[a:b], raw[a:b], forest, us, vs)
    u, v = np.concatenate(us), np.concatenate(vs)
    return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})


def pairs_of_group(n, node, tile, root, raw, forest: bool, us: list, vs: list) -> None:
    """Add the pairs of one group, whose members come in order of size, to ``us`` and ``vs``."""
    _, group = np.unique(root, return_inverse=True)
    across = tile.min() != tile.max()
    # partners are at least as large, up to a quarter more, so their sketch is as wide or twice as wide
    most = np.searchsorted(n, n * DENOMINATOR // NUMERATOR, side="right")
    words = np.array([len(x) for x in raw])
    for w in np.unique(words):
        own = np.flatnonzero(words == w)
        first, last = own[0], most[own].max()
        sketches = np.stack([folded(x, w) for x in raw[first:last]])
        for i in own:
            j = np.arange(i + 1, most[i])
            j = j[group[j] != group[i]]
            if across:
                j = j[tile[j] != tile[i]]
            d = hamming(sketches[j - first], sketches[i - first])
            ok = d <= bound(n[i], n[j])
            j, d = j[ok], d[ok]
            while len(j):
                take = j[[np.argmin(d)]] if forest else j
                us.append(np.full(len(take), node[i]))
                vs.append(node[take])
                if not forest:
                    break
                group[group == group[take[0]]] = group[i]
                ok = group[j] != group[i]
                j, d = j[ok], d[ok]


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            out.append(DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    a = sets.select(F.col("node").alias("u"), F.col("set").alias("set_u"))
    b = sets.select(F.col("node").alias("v"), F.col("set").alias("set_v"))
    return pairs.join(a, "u").join(b, "v").where(similar("set_u", "set_v")).select("u", "v")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    return classes(docs).drop("digest")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, n_shingles and component_id of every row of ``docs``."""
    spark = docs.sparkSession
    mark = len(noted(spark))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = parts_for(size, BUCKET_BYTES, 2 * spark.sparkContext.defaultParallelism)
    table = sketched(docs, buckets)
    info = table.where("kind = 0").select("doc_id", "digest", "n", "a", "b", "sketch", "spare")
    ids = written(info.drop("sketch", "spare"), "set-ids", keep=True)
    # one node per set, numbered, with the row of its smallest doc_id
    nodes = info.where("n > 0 AND doc_id IS NOT NULL").groupBy("a", "b").agg(F.min(F.struct("doc_id", "digest")).alias("row"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("spare").alias("spare"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "a", "b", "row.doc_id", "row.digest", "n", "sketch", "spare"), "nodes")
    found = written(table.where("kind = 1").select("bucket", "sets", "counts", "keys").groupBy("bucket").applyInPandas(bucket_groups, "grp long, u long, v long, size long, times long"), "groups")
    done_with(table)
    id_of = nodes.select("a", "node", "n", "sketch")

    def known(df: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            df = df.join(id_of.select(F.col("a").alias(c), F.col("node").alias(f"{c}_node"), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch")), c)
        return df

    @F.pandas_udf("boolean")
    def possible(na: pd.Series, nb: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y, limit in zip(a, b, bound(na.to_numpy(), nb.to_numpy())):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            words = min(len(x), len(y))
            out.append(limit >= 0 and hamming(folded(x, words), folded(y, words)) <= limit)
        return pd.Series(out, dtype=bool)

    pairs = known(found.where("grp IS NULL").select("u", "v").distinct(), "u", "v").where("u_node <> v_node")
    pairs = written(pairs.where(possible("u_n", "v_n", "u_sketch", "v_sketch")).select(F.col("u_node").alias("u"), F.col("v_node").alias("v")), "pairs")
    # whole sets of the nodes that can have a link
    all_members = written(found.where("grp IS NOT NULL").select("grp", "size", "times", F.col("u").alias("a")).join(nodes.select("a", "node", "spare"), "a").select("grp", "size", "node", "times", "spare"), "members-all")
    members = written(relieved(all_members), "members")
    done_with(found, all_members)
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).union(members.select("node")).distinct()
    sets = written(whole_sets(docs, nodes.select("node", "doc_id", "digest").join(wanted, "node")), "sets")
    links = written(linked(pairs, sets), "links")
    done_with(pairs)
    roots = components(links)
    all_members, members = members, regrouped(members, roots)
    done_with(all_members)
    spread = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    deals = parts_for(members.count(), PER_DEAL, spread)
    for forest in (True, True, False):
        open_ = written(unresolved(members, roots, nodes, deals), "open")
        if open_.isEmpty():
            break
        # few bytes but many comparisons: spread over more tasks than the bytes alone would give
        more = open_.repartition(spread, "deal").groupBy("deal").applyInPandas(cross_pairs_of(forest), "u long, v long").distinct()
        before, links = links, written(links.unionByName(linked(more, sets)), "links")
        done_with(before, open_)
        roots = components(links)
    rooted = written(nodes.join(roots, "node", "left").select("a", "b", "doc_id", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    class_of = written(rooted.join(least, "root").select("a", "b", "component_id"), "classes", keep=True)
    drop_written(spark, mark)
    out = ids.join(class_of, ["a", "b"], "left")
    alone = (F.col("n") == 0) | F.col("component_id").isNull()
    return out.select("doc_id", "digest", F.col("n").alias("n_shingles"),
                      F.when(F.col("doc_id").isNotNull(), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))).alias("component_id"))


def relieved(members: DataFrame) -> DataFrame:
    """grp, size and node of the members (with times, the keys of the group, and spare) without those that can leave all their groups.

    A passage that some texts hold makes groups of texts that have little else in common. A set with no more keys in groups of more than
    SMALL members than it can do without meets each linked set on a key of a small group, whatever the other one does.
    """
    leaving = members.groupBy("node").agg(F.sum("times").alias("keys"), F.min("spare").alias("spare")).where("keys <= spare").select("node")
    left = written(members.select("grp", "size", "node").join(leaving, "node", "left_anti").select("grp", "size", "node"), "members-left")
    now = left.groupBy("grp").agg(F.count(F.lit(1)).alias("now")).where("now > 1")
    return of_groups(left, now).select("grp", F.col("now").alias("size"), "node")


def regrouped(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Groups that are not one class yet, joined to one group where that means fewer comparisons.

    Copies of one text meet on hundreds of keys, and comparing them key by key repeats the same pairs. All groups that
    are linked by common members form a cluster; it takes the place of its groups if its size squared is below the sum
    of theirs. Either way every pair of members that shares a key is compared.
    """
    m = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = m.groupBy("grp", "size").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("first"))
    groups = written(groups.where("low < high").select("grp", "first", "size"), "groups-open")
    rows = written(of_groups(members, groups.drop("size")), "members-open")
    clusters = components(rows.select(F.col("node").alias("u"), F.col("first").alias("v")).distinct())
    # clusters decide once; the decision is attached to their groups, and from there to the rows
    groups = groups.join(clusters.select(F.col("node").alias("first"), F.col("root").alias("cluster")), "first", "left")
    groups = written(groups.withColumn("cluster", F.coalesce("cluster", "first")), "groups-clustered")
    cluster_of = rows.select("node").distinct().join(clusters, "node", "left").select(F.coalesce("root", "node").alias("cluster"))
    apart = groups.groupBy("cluster").agg(F.sum(F.col("size") * F.col("size")).alias("apart"))
    whole = cluster_of.groupBy("cluster").agg(F.count(F.lit(1)).alias("m")).join(apart, "cluster").where("m * m < apart").select("cluster", "m")
    whole = whole.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(CLUSTER_PARTS - 1))))
    decided = groups.withColumn("part", F.pmod(F.xxhash64("grp"), F.lit(CLUSTER_PARTS)).cast("int")).join(whole, ["cluster", "part"], "left")
    decided = written(decided.select("grp", "cluster", "m"), "groups-decided")
    rows = of_groups(rows, decided)
    name = F.when(F.col("m").isNull(), F.col("grp").cast("string")).otherwise(F.concat(F.lit("c"), F.col("cluster").cast("string")))
    return written(rows.select(name.alias("grp"), F.coalesce("m", "size").alias("size"), "node").distinct(), "members-regrouped")


def of_groups(members: DataFrame, groups: DataFrame) -> DataFrame:
    """``members`` (with grp, size, node) of the given groups, with the columns of their group's row; a large group's members meet it in parts."""
    parts = F.ceil(F.col("size") / SPLIT).cast("int")
    sized = groups.join(members.where(f"size > {SPLIT}").groupBy("grp").agg(F.max(parts).alias("parts")), "grp", "left")
    split = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return members.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).join(split, ["grp", "part"]).drop("part")


def unresolved(members: DataFrame, roots: DataFrame, nodes: DataFrame, deals: int) -> DataFrame:
    """Members of the groups that are not one class yet, with their class, dealt to calls: several small groups, or a pair of tiles of a large one."""
    m = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stats = m.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("grp")
    m = of_groups(m, stats).withColumn("t", F.ceil(F.col("size") / TILE).cast("int"))
    tile = F.pmod(F.xxhash64("node"), F.col("t")).cast("int")
    # a tile meets itself and every other tile
    other = F.explode(F.sequence(F.lit(0), F.col("t") - 1))
    m = m.join(nodes.select("node", "n", "sketch"), "node").withColumn("tile", tile).withColumn("other", other)
    tiles = F.concat_ws("-", "grp", F.least("tile", "other"), F.greatest("tile", "other"))
    deal = F.when(F.col("size") <= FEW, F.concat(F.lit("d"), F.pmod(F.xxhash64("grp"), F.lit(deals)).cast("string"))).otherwise(tiles)
    return m.select("grp", "node", "n", "sketch", "root", "tile", deal.alias("deal"))


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and the sorted shingle hashes of its text. wanted: node, and doc_id and digest of a row with its set."""
    # documents repeat doc_id and text at times; one row of each is read
    asked = wanted.select("node", F.col("doc_id").alias("asked_id"), F.col("digest").alias("asked_digest"))
    rows = docs.select("doc_id", "text").join(asked, (F.col("doc_id") == F.col("asked_id")) & (text_digest() == F.col("asked_digest")))
    rows = rows.dropDuplicates(["asked_id", "asked_digest"])

    def run(batches):
        for block in blocks(batches):
            shingles, offsets = block_sets(*text_bytes(block.column("text")))
            yield pa.RecordBatch.from_arrays([block.column("node"), pa.array([shingles[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:])], pa.binary())], ["node", "set"])

    return documents(rows, "node").mapInArrow(run, "node long, set binary")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their text's class, with their columns. Rows without doc_id stay."""
    gone = classes(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    return without(docs, gone)
