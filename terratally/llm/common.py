"""Helpers shared by the operators: text blocks inside tasks, written tables, the package on executors."""
from __future__ import annotations

import math
import threading
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terratally.session import new_dir, ship_package  # noqa: F401

#: Bytes of text that a task works on at a time.
BLOCK_BYTES = 4 << 20


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: later passes read it, and lost executors cost no replay.

    Tables that are not to be kept are noted, so that ``drop_written`` can remove them once nothing reads them.
    """
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._terratally_path = path
    if not keep:
        noted(spark).append(path)
    return out


def noted(spark: SparkSession) -> list[str]:
    """Paths noted by this thread, so that operators in other threads keep theirs."""
    sc = spark.sparkContext
    if not hasattr(sc, "_terratally_written"):
        sc._terratally_written = threading.local()
    if not hasattr(sc._terratally_written, "paths"):
        sc._terratally_written.paths = []
    return sc._terratally_written.paths


def drop_written(spark: SparkSession, since: int = 0) -> None:
    """Remove the noted tables of this thread from position ``since`` on. Their frames must not be read any more."""
    paths = noted(spark)
    for p in paths[since:]:
        remove(spark, p)
    del paths[since:]


def done_with(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made, as soon as nothing reads them any more."""
    for t in tables:
        remove(t.sparkSession, t._terratally_path)
        paths = noted(t.sparkSession)
        if t._terratally_path in paths:
            paths.remove(t._terratally_path)


def remove(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_digest() -> Column:
    """SHA-256 of the text (null: empty)."""
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


def unused(name: str, df: DataFrame) -> str:
    """``name``, lengthened until ``df`` has no column of that name in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id (null included) and text are not in ``gone`` (gone_id, gone_digest), with their columns."""
    gone_id, gone_digest = unused("gone_id", docs), unused("gone_digest", docs)
    gone = gone.select(F.col("gone_id").alias(gone_id), F.col("gone_digest").alias(gone_digest))
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (text_digest() == F.col(gone_digest))
    return docs.join(gone, same, "left_anti")


def documents(docs: DataFrame, *extra) -> DataFrame:
    """doc_id, the text (null: empty) and the named or given columns; other columns go."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def renewed(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own, for meeting a table that it was made from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def parts_for(bytes_: int, target: int, least: int = 1) -> int:
    return max(least, math.ceil(bytes_ / target))


def blocks(batches: Iterable[pa.RecordBatch], limit: int = BLOCK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Record batches joined or cut so that each holds about ``limit`` bytes of text, or a single longer row."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(column)
        col = batch.column(i)
        offsets = np.frombuffer(col.buffers()[1], "<i8" if pa.types.is_large_string(col.type) else "<i4")
        ends = offsets[col.offset:col.offset + len(col) + 1].astype(np.int64)
        at = 0
        while at < len(col):
            room = limit - size
            to = int(np.searchsorted(ends, ends[at] + max(room, 0), side="right")) - 1
            if to <= at:
                if held:
                    yield join(held)
                    held, size = [], 0
                    continue
                to = at + 1
            held.append(batch.slice(at, to - at))
            size += int(ends[to] - ends[at])
            at = to
            if size >= limit:
                yield join(held)
                held, size = [], 0
    if held:
        yield join(held)


def join(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and the n + 1 offsets of its rows. No nulls are expected."""
    offsets = np.frombuffer(col.buffers()[1], "<i8" if pa.types.is_large_string(col.type) else "<i4")
    offsets = offsets[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated runs start, start + 1, ... of the given lengths."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node linked with it, for every node of ``links`` (u, v) that is not a root itself.

    Alternating large-star and small-star steps; every round is a written table, and count and hash sum of the links
    show when nothing moves any more.
    """
    def step(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = written(df.where("u <> v").distinct(), "links")
        return df, tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e, mark = step(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while mark[0]:
        before = e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new, moved = step(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))))
        e, same = new, moved == mark
        done_with(before)  # the new round is written
        mark = moved
        if same:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
