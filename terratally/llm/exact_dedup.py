"""Exact deduplication by a minimal perfect hash over the distinct digests of a history.

``winners`` groups the digests of a history (map-side first, so a text that fills a third of all rows is a few rows);
``build_index`` deals the distinct ones to shards. A shard is one row: the bits of a level-wise minimal perfect hash, and
slots with the full digest, the winner's doc_id and the number of copies. ``look_up`` sends the digests of documents
to the shards, hashes them to slots and compares all bytes of the digest there: members get the slot's winner,
nonmembers get nulls. Shards with many lookups are replicated and their lookups split over the replicas.

``deduplicate`` looks documents up in a history: an earlier one (digest, winner, copies), or else the distinct digests of
one half of the rows, against which the other half is looked up. Members add to the group of their slot, whose winner is
the larger doc_id; nonmembers are grouped among themselves. Every row then reads the answer of its repeated group from a
second hash. Group sizes count the rows of the history as well, and the row that stays may be one of them.

Texts are equal when they are identical; null counts as empty. Of equal texts the row with the largest doc_id stays.
Defined results: rows with a null doc_id stay only if all their copies have null ids; rows that repeat the winner's
doc_id are kept together; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratally.llm.common import drop_written, mixed, noted, parts_for, ship_package, text_digest, without, written

#: Digests of a shard, on average, and bits of a level per key that is still unplaced.
PER_SHARD, GAMMA = 20_000, 2
DIGEST = 32


def digest_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_digest().alias("digest"))


def words_of(digests) -> np.ndarray:
    """Digests as rows of four unsigned 64-bit numbers."""
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, DIGEST // 8)


def level_hash(words: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = mixed(np.array([level + 1], np.uint64))[0]
    return (mixed(words[:, 0] ^ seed) + mixed(words[:, 1] + seed)) % np.uint64(size)


def build_levels(words: np.ndarray) -> list[np.ndarray]:
    """Level by level, keys that are alone on their bit are placed there; the others go on to the next."""
    levels, rest = [], words
    while len(rest):
        size = max(8, GAMMA * len(rest))
        at = level_hash(rest, len(levels), size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        levels.append(alone)
        rest = rest[~alone[at]]
    return levels


def slots_of(words: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Slot of each key: the rank of its bit among all set bits; -1 if no level has it."""
    slot, rest, before = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for k, bits in enumerate(levels):
        at = level_hash(words[rest], k, len(bits))
        hit = bits[at]
        ranks = np.cumsum(bits) - 1
        slot[rest[hit]] = before + ranks[at[hit]]
        before += int(bits.sum())
        rest = rest[~hit]
    return slot


def pack_levels(levels: list[np.ndarray]) -> tuple[bytes, list[int]]:
    return b"".join(np.packbits(x).tobytes() for x in levels), [len(x) for x in levels]


def unpack_levels(raw: bytes, sizes) -> list[np.ndarray]:
    out, at = [], 0
    for n in sizes:
        b = -(-int(n) // 8)
        out.append(np.unpackbits(np.frombuffer(raw, np.uint8, b, at), count=int(n)).astype(bool))
        at += b
    return out


def shard_of(n: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n))


def winners(history: DataFrame) -> DataFrame:
    """Distinct digests with the largest doc_id and the number of rows, combined before the shuffle."""
    return history.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("copies"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard: shard, bits, sizes, digests (in slot order), winners, copies.

    ``history``: distinct digests with their winner and copies, as ``winners`` gives them.
    """
    ship_package(history.sparkSession)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        words = words_of(pdf["digest"])
        levels = build_levels(words)
        order = np.argsort(slots_of(words, levels))
        bits, sizes = pack_levels(levels)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "bits": [bits], "sizes": [sizes], "digests": [b"".join(pdf["digest"].iloc[order])],
                             "winners": [[None if pd.isna(x) else int(x) for x in pdf["winner"].iloc[order]]], "copies": [pdf["copies"].iloc[order].tolist()]})

    return history.withColumn("shard", shard_of(shards)).groupBy("shard").applyInPandas(
        build, "shard long, bits binary, sizes array<long>, digests binary, winners array<long>, copies array<long>")


def look_up(lookups: DataFrame, index: DataFrame, shards: int, n: int) -> DataFrame:
    """``lookups`` (doc_id, digest; n rows) with winner and copies; both null for nonmembers."""
    ship_package(lookups.sparkSession)
    asked = lookups.withColumn("shard", shard_of(shards))
    # one row per shard: its lookups against the mean give the number of replicas
    loads = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) * shards / max(n, 1)).cast("int").alias("replicas"))
    loads = F.broadcast(loads)  # as many rows as shards, at some 20 bytes for every 20,000 digests
    asked = asked.join(loads, "shard").withColumn("replica", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.col("replicas")))
    index = index.join(loads, "shard").withColumn("replica", F.explode(F.sequence(F.lit(0).cast("long"), F.col("replicas").cast("long") - 1))).drop("replicas")

    def match(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        winner, copies = pd.array([None] * len(asked), "Int64"), pd.array([None] * len(asked), "Int64")
        if len(asked) and len(index):
            row = index.iloc[0]
            words, held = words_of(asked["digest"]), np.frombuffer(row["digests"], "<u8").reshape(-1, DIGEST // 8)
            slot = slots_of(words, unpack_levels(row["bits"], row["sizes"]))
            known = slot >= 0
            known[known] = (held[slot[known]] == words[known]).all(axis=1)  # every byte
            winner[known] = pd.array(row["winners"], "Int64")[slot[known]]
            copies[known] = pd.array(row["copies"], "Int64")[slot[known]]
        return pd.DataFrame({"doc_id": asked["doc_id"].astype("Int64"), "digest": asked["digest"], "winner": winner, "copies": copies})

    return asked.drop("replicas").groupBy("shard", "replica").cogroup(index.groupBy("shard", "replica")).applyInPandas(
        match, "doc_id long, digest binary, winner long, copies long")


def deduplicate(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    ``history``: distinct digests of earlier documents with their winner and copies, as ``winners`` gives them. An empty
    one is allowed.
    """
    rows = written(digest_rows(docs), "digests")
    n, least = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    batch, own = rows, history is None
    if own:
        early = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(2)) == 0
        history, batch = winners(rows.where(early)), rows.where(~early)
    history = written(history.select("digest", "winner", "copies"), "history")
    shards = parts_for(history.count(), PER_SHARD, least)
    probed = written(look_up(batch, build_index(history, shards), shards, n), "probed")
    member = F.col("copies").isNotNull()
    members = probed.where(member).groupBy("digest").agg(F.max(F.greatest("doc_id", "winner")).alias("winner"), (F.max("copies") + F.count(F.lit(1))).alias("copies"))
    groups = members.unionByName(winners(probed.where(~member).select("doc_id", "digest")))
    if own:  # groups of the first half that the second did not touch
        groups = groups.unionByName(history.where("copies > 1").join(members.select("digest"), "digest", "left_anti").select("digest", "winner", "copies"))
    repeated = written(groups.where("copies > 1"), "repeated")
    shards = parts_for(n, PER_SHARD, least)
    found = look_up(rows, build_index(repeated, shards), shards, n)
    alone = F.col("copies").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("winner"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
                        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_last(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. Rows are dropped by doc_id (null included) and text."""
    mark = len(noted(docs.sparkSession))
    dropped = deduplicate(docs).where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.unhex("text_sha256").alias("gone_digest"))
    gone = written(dropped.distinct(), "repeats", keep=True)
    drop_written(docs.sparkSession, mark)
    return without(docs, gone)
