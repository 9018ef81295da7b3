"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass reads every text and keeps a few statistics per document, transformed (logarithms and log odds) so that they
are nearer to normal. Class sums and cross products of the labelled training rows are added up by Spark; the driver
sees one row per class and entry of these small matrices. Class covariances are shrunk towards the pooled covariance
and its diagonal. The Cholesky factor of each is computed once, and a document's score is the logistic of the
difference of the two log densities (from Mahalanobis distances by triangular solves) plus log priors.

Only the text is an input of a score. Rows held out of training are those whose crc32 of the doc_id as text leaves 1
when divided by 3. Defined results: null and empty texts have the statistics of an empty text; labels other than 0
and 1 are ignored; without labels of both classes the score is the smoothed share of label 1; a null doc_id is
scored, never trained on, and not held out.
"""
from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratally.llm.common import drop_written, noted, ship_package, written

FOLDS, HELD_OUT = 3, 1
#: Weights of the pooled covariance and of its diagonal in each class covariance; least variance of a statistic.
TO_POOLED, TO_DIAGONAL, FLOOR = 0.1, 0.05, 1e-3
SIGNS = re.compile(r"[^\w\s.,;:'\"!?()-]|_")
MARKS = re.compile(r"[!?]")
NAMES = ("size", "words", "word_length", "capitals", "signs", "marks", "distinct", "repeats", "lines", "line_repeats", "top_word", "top_pair", "stops")


def odds(part: float, whole: float) -> float:
    return math.log((part + 0.5) / (whole - part + 0.5))


def share(part: float, whole: float) -> float:
    """A share that needs no rows to settle: short texts stay near 0."""
    return math.log1p(10.0 * max(part, 0) / (whole + 10.0))


def statistics(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    counts, pairs = Counter(words), Counter(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    capitals, letters = sum(map(str.isupper, words)), n
    return [
        math.log1p(len(text)), math.log1p(n), math.log1p(sum(map(len, words)) / max(n, 1)),
        share(capitals, letters), share(len(SIGNS.findall(text)), n), share(len(MARKS.findall(text)), n),
        math.log((len(counts) + 1) / (n + 1)), share(sum(a == b for a, b in zip(words, words[1:])), n),
        math.log1p(len(lines)), share(len(lines) - len(set(lines)), len(lines)),
        share(max(counts.values(), default=0) - 1, n), share(max(pairs.values(), default=0) - 1, n), odds(sum(w[-1] == "." for w in words), n + 1),
    ]


def features(docs: DataFrame) -> DataFrame:
    """Written table of doc_id and x, the statistics of every document."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return docs.select("doc_id", run(F.coalesce("text", F.lit(""))).alias("x"))


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


class Model:
    def __init__(self, counts: dict[int, int], sums: dict[int, np.ndarray], products: dict[int, np.ndarray]):
        n = sum(counts.values())
        self.prior = (counts.get(1, 0) + 1) / (n + 2)
        self.classes = None
        if min(counts.get(0, 0), counts.get(1, 0)) == 0:
            return
        means = {c: sums[c] / counts[c] for c in (0, 1)}
        spread = {c: products[c] / counts[c] - np.outer(means[c], means[c]) for c in (0, 1)}
        pooled = sum(spread[c] * counts[c] for c in (0, 1)) / n
        self.classes = {}
        for c in (0, 1):
            cov = (1 - TO_POOLED - TO_DIAGONAL) * spread[c] + TO_POOLED * pooled + TO_DIAGONAL * np.diag(np.diag(pooled)) + FLOOR * np.eye(len(pooled))
            factor = np.linalg.cholesky(cov)
            self.classes[c] = (means[c], np.linalg.inv(factor), -np.log(np.diag(factor)).sum())

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.prior)
        log = {}
        for c, (mean, inverse, norm) in self.classes.items():
            z = (x - mean) @ inverse.T
            log[c] = norm - 0.5 * (z * z).sum(axis=1)
        d = log[1] - log[0] + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(d, -500, 500)))


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """``rows``: doc_id, x. Every labelled row outside the held-out third is trained on."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(~held_out())
    train = rows.join(known, "doc_id").select("y", "x")

    def partial(batches):
        total: dict = {}
        for pdf in batches:
            for y, part in pdf.groupby("y"):
                x = np.stack(part["x"])
                add = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                total[y] = total.get(y, 0) + add
        yield pd.DataFrame([(y, i, v) for y, t in total.items() for i, v in enumerate(t)], columns=["y", "i", "v"])

    entries = train.mapInPandas(partial, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    d, counts, sums, products = len(NAMES), {}, {}, {}
    for y in (0, 1):
        t = np.zeros(1 + d + d * d)
        for r in entries:
            if r["y"] == y:
                t[r["i"]] = r["v"]
        counts[y], sums[y], products[y] = int(t[0]), t[1:1 + d], t[1 + d:].reshape(d, d)
    return Model(counts, sums, products)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = written(features(docs), "statistics")
    score = scorer(fit(rows, labels))
    return rows.select("doc_id", held_out().alias("held_out"), score("x").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def scorer(model: Model):
    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(x))) if len(x) else pd.Series([], dtype="float64")

    return score


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, with their columns."""
    mark = len(noted(docs.sparkSession))
    score = scorer(fit(written(features(docs), "statistics"), labels))
    drop_written(docs.sparkSession, mark)
    ship_package(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return docs.where(score(run(F.coalesce("text", F.lit("")))) >= 0.5)
