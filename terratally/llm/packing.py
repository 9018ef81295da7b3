"""Packing: concatenate all documents and cut at fixed windows.

First pass: each task encodes its documents, appends the end id, and writes the ids as a table together with the
task's number and the running token total inside the task. Second pass: prefix sums over the tasks' totals (one row
per task) turn these into global offsets, and every document is cut where a window ends. The order of documents is
that of the written table, so a lost executor cannot change it between the passes. A document's ids may run over
any number of windows; each cut is a boundary record. No text and no ids are shuffled.

Defined results: a null or empty text has the end id alone; repeated rows and repeated or null doc_ids are packed
each by itself; an empty table gives no pieces.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terratally.llm.bpe import BlockIds, Vocabulary, vocabulary_on_executors
from terratally.llm.common import blocks, documents, text_bytes, written

END_ID = 1
LENGTH = 2048
#: Ids are stored as unsigned little-endian numbers of two bytes if the vocabulary allows it.
TWO_BYTES = 1 << 16


def id_type(v: Vocabulary, end_id: int = END_ID) -> str:
    return "<u2" if max(len(v.lengths) - 1, end_id) < TWO_BYTES else "<u4"


def token_table(docs: DataFrame, v: Vocabulary, end_id: int = END_ID) -> DataFrame:
    """Written table of doc_id, task, before (ids of the task's earlier documents), n and ids (bytes)."""
    shared, kind = vocabulary_on_executors(docs, v), id_type(v, end_id)

    def run(batches):
        task, before = TaskContext.get().partitionId(), 0
        for block in blocks(batches):
            b = BlockIds(shared.value, *text_bytes(block.column("text")))
            n = np.diff(b.offsets) + 1
            ids = np.full(len(b.ids) + len(n), end_id, kind)
            kept = np.ones(len(ids), bool)
            kept[np.cumsum(n) - 1] = False
            ids[kept] = b.ids
            ends = np.cumsum(n)
            wide = np.dtype(kind).itemsize
            binary = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(0, ends).astype("<i8") * wide), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(np.full(len(n), task, np.int64)), pa.array(before + ends - n), pa.array(n), binary.cast(pa.binary())],
                ["doc_id", "task", "before", "n", "ids"])
            before += int(ends[-1])

    source = documents(docs)
    schema = T.StructType([source.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("task", "before", "n")), T.StructField("ids", T.BinaryType())])
    return written(source.mapInArrow(run, schema), "token-ids")


def task_offsets(tokens: DataFrame) -> DataFrame:
    """Tokens before each task: one row per task that had documents."""
    totals = tokens.groupBy("task").agg(F.sum("n").alias("total"))
    return totals.select("task", (F.sum("total").over(Window.orderBy("task")) - F.col("total")).alias("offset"))


def placed(tokens: DataFrame) -> DataFrame:
    """The token table with ``at``, the global offset of each document."""
    # one row per task, whatever the tasks hold: small enough to send to all
    return tokens.join(F.broadcast(task_offsets(tokens)), "task").select("doc_id", "n", "ids", (F.col("offset") + F.col("before")).alias("at"))


def cuts(at: int, n: int, length: int):
    """(start, length, sequence, offset) of the pieces of a document of n ids at a global offset."""
    start = 0
    while start < n:
        sequence, offset = divmod(at + start, length)
        size = min(length - offset, n - start)
        yield start, size, sequence, offset
        start += size


def piece_rows(tokens: DataFrame, kind: str, length: int = LENGTH, payload: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ids on demand."""

    def run(batches):
        for b in batches:
            ids, ats, ns = b.column("ids"), b.column("at").to_pylist(), b.column("n").to_pylist()
            rows, which, raw = [], [], []
            for i, (at, n) in enumerate(zip(ats, ns)):
                own = np.frombuffer(ids[i].as_buffer(), kind)
                wide = memoryview(own.astype("<u4")).cast("B")
                for start, size, sequence, offset in cuts(at, n, length):
                    which.append(i)
                    rows.append((start, size, zlib.crc32(wide[4 * start:4 * (start + size)]), n, sequence, offset))
                    if payload:
                        raw.append(own[start:start + size].tobytes())
            if rows:
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(which)), *columns, *([pa.array(raw, pa.binary())] if payload else [])], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * payload
    source = placed(tokens)
    fields = [source.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in names[1:7])]
    return source.mapInArrow(run, T.StructType(fields + [T.StructField("ids", T.BinaryType())] * payload))


def pack(docs: DataFrame, v: Vocabulary, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents, in sequences of ``length`` ids; only the last sequence can be shorter."""
    return piece_rows(token_table(docs, v, end_id), id_type(v, end_id), length)
