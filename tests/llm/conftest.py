import random

import pytest

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with those of the operators."""
    def docs(rows, clash=True):
        df = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], DOCS)
        if clash:
            for c in ("n", "bucket", "kind", "task", "ids", "digest", "node", "root", "score", "x", "rows", "sketch"):
                df = df.selectExpr("*", f"'clash' AS {c}")
        return df
    return docs


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and very long texts, repeated texts, odd characters."""
    rnd = random.Random(7)
    words = ["alpha", "Beta", "gamma's", "δέλτα", "日本", "x1", "…", "  ", "\n\n", "\t", "'ll", "42", "é", "🎉", "\x1c"]
    some = ["".join(rnd.choice(words) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    long = " ".join(rnd.choice(words) for _ in range(40_000))
    texts = ["", None, " ", "a", "a", "a b c", "A B C", long, long, long + " end", *some, some[0], some[1], "one two three four five six"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def clashing():
    """Two words of 1024 letters that a polynomial hash modulo 2**64 cannot tell apart, whatever its base."""
    parity = [k.bit_count() % 2 for k in range(1024)]
    return "".join("ab"[p] for p in parity), "".join("ba"[p] for p in parity)
