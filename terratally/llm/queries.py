"""The registered queries of this subpackage. Each applies its operator to its whole table."""
from __future__ import annotations

import re

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terratally.llm import (bpe, exact_dedup, hard_negatives, jaccard_join, lexical, nearest, packing, pii, quality, suffix_dedup, token_counts,
                            token_output, topk)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Clean-up edits of a text: runs of three or more equal signs go, and of several spaces one stays.
CLEAN_UP = re.compile(r"([#$%&*!|])\1{2,}| {2,}")


def edits_of(text: str | None) -> list[dict]:
    """The clean-up edits of a text from the last to the first, so that positions hold."""
    found = [{"start": m.start(), "end": m.end(), "replacement": "" if m[1] else " "} for m in CLEAN_UP.finditer(text or "")]
    return found[::-1]


@F.pandas_udf(token_counts.EDITS)
def clean_up_edits(texts: pd.Series) -> pd.Series:
    return texts.map(edits_of)


def op1_token_counts(spark, sf_dir):
    v = bpe.rank_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    edited = token_counts.build_and_edit(table(spark, sf_dir, "documents"), v, edits_of)
    return edited.select("doc_id", "n_before", "n_tokens", "n_edits", "n_chars_encoded", F.size("leaf_tokens").alias("n_leaves"))


def op2_bpe(spark, sf_dir):
    v = bpe.rank_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(table(spark, sf_dir, "documents"), v)


def op3_pii(spark, sf_dir):
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_suffix_dedup(spark, sf_dir):
    rows = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                       F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark, sf_dir):
    v = bpe.merges_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), v)


def op8_token_output(spark, sf_dir):
    v = bpe.merges_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    rows = token_output.materialise(table(spark, sf_dir, "documents"), v)
    row = F.col("slot") % token_output.PER_SHARD
    return rows.select("slot", "sequence_id", "n_tokens", "shard", (row * F.length("payload")).alias("byte_offset"),
                       F.crc32("payload").alias("payload_crc32"))


def op9_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op11_nearest(spark, sf_dir):
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op12_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_lexical(spark, sf_dir):
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_bpe, op3_pii, op4_suffix_dedup, op5_jaccard_join, op6_quality, op7_packing, op8_token_output, op9_topk, op10_exact_dedup,
                                op11_nearest, op12_hard_negatives, op13_lexical)}

SQL = {
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
            FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
    "op13_lexical": r"""
        WITH t AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
        m AS (SELECT doc_id, 100 - 50 + ((50 * n * (SELECT count(*) FROM d)) // (SELECT sum(n)::BIGINT FROM d)) AS m FROM d),
        w AS (SELECT term, floor(1000 * ln((2 * (SELECT count(*) FROM d) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf GROUP BY term),
        q AS (
            SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')),
                                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark),
        s AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
            FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 50""",
}
