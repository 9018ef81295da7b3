"""Training-order materialisation: packed sequences as fixed-stride shards in a keyed random order.

Every packed sequence gets a global slot by a keyed Feistel permutation of the sequence numbers (cycle walking keeps
it inside their range), so no order is stored or sorted for. Slots are dealt to shards by range, ``per_shard`` slots
each; a shard is one folder ``shard=K`` whose rows lie in slot order, each with a payload of the same number of
bytes. Slot s is row s mod per_shard of shard s div per_shard: a reader goes through the shards in order and resumes
at any slot, and a shard can be written again by itself.

Defined results: the last sequence is padded with ``pad_id``; an empty table gives no shards; null texts are empty
documents, as in packing.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terratally.llm.bpe import Vocabulary
from terratally.llm.feistel import permute, round_keys
from terratally.llm.packing import END_ID, LENGTH, id_type, piece_rows, token_table
from terratally.session import new_dir

KEY = b"training-order-1"
PER_SHARD = 512


def slot_pieces(docs: DataFrame, v: Vocabulary, key: bytes, length: int, end_id: int) -> tuple[DataFrame, int]:
    """Pieces with ids and the slot of their sequence, and the number of sequences."""
    tokens = token_table(docs, v, end_id)
    total = tokens.agg(F.sum("n")).first()[0] or 0
    n = -(-total // length)
    keys = round_keys(key)

    @F.pandas_udf("long")
    def slot(sequence: pd.Series) -> pd.Series:
        return pd.Series(permute(sequence.to_numpy(), max(n, 1), keys).astype(np.int64))

    pieces = piece_rows(tokens, id_type(v, end_id), length, payload=True)
    return pieces.select("sequence_id", "offset", "length", "ids", slot("sequence_id").alias("slot")), n


def write_shards(docs: DataFrame, v: Vocabulary, path: str, key: bytes = KEY, length: int = LENGTH,
                 per_shard: int = PER_SHARD, end_id: int = END_ID, pad_id: int = END_ID) -> None:
    """Shards of rows (slot, sequence_id, n_tokens, payload) under ``path``."""
    kind = id_type(v, max(end_id, pad_id))
    wide = np.dtype(kind).itemsize
    pad = np.array([pad_id], kind).tobytes()
    pieces, _ = slot_pieces(docs, v, key, length, end_id)

    def assemble(batches):
        """Pieces come in order of slot and offset; a sequence may run over batches."""
        held = None
        for pdf in batches:
            out = []
            for slot, sequence, size, ids, shard in zip(pdf["slot"], pdf["sequence_id"], pdf["length"], pdf["ids"], pdf["shard"]):
                if held and held[0] != slot:
                    out.append(held)
                    held = None
                if held is None:
                    held = [slot, sequence, 0, [], shard]
                held[2] += size
                held[3].append(ids)
            if out:
                yield finish(out)
        if held:
            yield finish([held])

    def finish(rows):
        return pd.DataFrame({"slot": [r[0] for r in rows], "sequence_id": [r[1] for r in rows], "n_tokens": [r[2] for r in rows],
                             "payload": [b"".join(r[3]).ljust(length * wide, b"\0") if pad == b"\0" * wide else b"".join(r[3]) + pad * (length - r[2]) for r in rows],
                             "shard": [r[4] for r in rows]})

    dealt = pieces.withColumn("shard", F.expr(f"slot div {per_shard}")).repartition("shard").sortWithinPartitions("shard", "slot", "offset")
    dealt.mapInPandas(assemble, "slot long, sequence_id long, n_tokens long, payload binary, shard long").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, from_slot: int = 0, per_shard: int = PER_SHARD) -> DataFrame:
    """Rows from a slot on, as a resumed run reads them; only the shards from there are opened."""
    rows = spark.read.schema("slot long, sequence_id long, n_tokens long, payload binary, shard long").parquet(path)
    return rows.where((F.col("shard") >= from_slot // per_shard) & (F.col("slot") >= from_slot))


def materialise(docs: DataFrame, v: Vocabulary, key: bytes = KEY, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Write the shards to the shared folder and read them back."""
    spark = docs.sparkSession
    path = new_dir(spark, "token-shards")
    write_shards(docs, v, path, key, length, per_shard)
    return read_shards(spark, path, 0, per_shard)
