"""A table of the latest row per key, written by micro-batches and compacted bucket by bucket.

Layout under the table's path::

    batches/<batch>/bucket=<b>/...   rows of a micro-batch, dealt to buckets by a hash of the key
    base/<version>/bucket=<b>/...    rows merged up to a version
    manifest/<version>               the current file set: folder of every bucket, open batches, last merged batch

A batch is written under its own number, so a repeated batch overwrites itself, and is skipped once it has been merged.
Compaction merges the open batches with the buckets that they touch; the other buckets keep their folders. A new manifest
is written beside its name and renamed, so readers see either the old file set or the new one. Files that no manifest but
the last two name are removed, so frames read before the last compaction stay readable.
"""
from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


class Folder:
    """Files of one folder through the file system that its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path
        self.fs = self._p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        p = self._p(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self._p(f"{self.path}/{name}"), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._p(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a new file that appears whole or not at all."""
        part, whole = (self._p(f"{self.path}/{name}{end}") for end in (".part", ""))
        if self.fs.exists(whole):
            raise OSError(f"{whole} exists already: two writers on one table")
        out = self.fs.create(part, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self.fs.rename(part, whole):
            raise OSError(f"{whole} cannot be written")


class UpsertTable:
    """``keys`` name a row; of several rows, the one with the largest ``prefer`` columns stays, then the one of the later
    batch, then the largest ``order`` columns, then the largest remaining columns. All columns must be orderable."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str] = (), prefer: list[str] = (),
                 buckets: int = 64, compact_after: int = 8):
        self.spark, self.path, self.keys, self.order, self.prefer = spark, path, list(keys), list(order), list(prefer)
        self.schema, self.compact_after = schema, compact_after
        self.stored = T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])
        self.folder = Folder(spark, path)
        self.buckets = self.manifest().get("n", buckets)

    def manifest(self) -> dict:
        versions = sorted(n for n in self.folder.names("manifest") if n.isdigit())
        if not versions:
            return {"version": 0, "merged": -1, "buckets": {}, "open": []}
        return json.loads(self.folder.read(f"manifest/{versions[-1]}"))

    def publish(self, m: dict) -> None:
        m = {**m, "version": m["version"] + 1, "n": self.buckets}
        self.folder.put(f"manifest/{m['version']:012d}", json.dumps(m))

    def bucketed(self, rows: DataFrame) -> DataFrame:
        """Rows dealt out by bucket, so that a batch writes one file for each.

        Inside a micro-batch Spark plans without adaptive execution and leaves out hints to rebalance.
        """
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).repartition(self.buckets, "bucket")

    def winners(self, rows: DataFrame, *by: str) -> DataFrame:
        """One row per key, with its batch."""
        rest = [c for c in self.schema.names if c not in self.keys]
        rank = [*self.prefer, "_batch", *self.order, *[c for c in rest if c not in [*self.prefer, *self.order]]]
        best = rows.groupBy(*by, *self.keys).agg(F.max(F.struct(*rank)).alias("m"))
        return best.select(*by, *self.keys, *[F.col("m")[c].alias(c) for c in [*rest, "_batch"]])

    def add(self, rows: DataFrame, batch: int) -> None:
        """Take in a micro-batch."""
        m = self.manifest()
        if batch <= m["merged"]:
            return
        one = self.winners(self.bucketed(rows.select(*self.schema.names).withColumn("_batch", F.lit(batch).cast("long"))), "bucket")
        one.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batches/{batch}")
        if batch not in m["open"]:
            m["open"] = [*m["open"], batch]
            self.publish(m)
        if len(m["open"]) >= self.compact_after:
            self.compact()

    def rows_of(self, folders: list[str]) -> DataFrame:
        one = [self.spark.read.schema(T.StructType([*self.stored.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/{f}") for f in folders]
        return reduce(DataFrame.unionByName, one)

    def bucket_rows(self, m: dict, touched: set[str]) -> list[DataFrame]:
        """The stored rows of some buckets: one scan per version that still holds any of them."""
        by_version = {}
        for b, version in m["buckets"].items():
            if b in touched:
                by_version.setdefault(version, []).append(int(b))
        return [self.rows_of([f"base/{v}"]).where(F.col("bucket").isin(bs)) for v, bs in by_version.items()]

    def compact(self) -> None:
        """Merge the open batches into the buckets that they touch."""
        m = self.manifest()
        if not m["open"]:
            return
        touched = {n.split("=")[1] for batch in m["open"] for n in self.folder.names(f"batches/{batch}") if n.startswith("bucket=")}
        version = f"{m['version'] + 1:012d}"
        new = dict(m["buckets"])
        if touched:
            every = reduce(DataFrame.unionByName, [*self.bucket_rows(m, touched), self.rows_of([f"batches/{b}" for b in m["open"]])])
            self.winners(every.repartition(self.buckets, "bucket"), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/{version}")
            new.update({b: version for b in touched})
        self.publish({**m, "buckets": new, "open": [], "merged": max(m["open"])})
        self.clean()

    def clean(self) -> None:
        """Remove manifests before the last two, and what those two do not name."""
        versions = sorted(n for n in self.folder.names("manifest") if n.isdigit())
        kept = [json.loads(self.folder.read(f"manifest/{v}")) for v in versions[-2:]]
        for v in versions[:-2]:
            self.folder.remove(f"manifest/{v}")
        used = {(v, b) for m in kept for b, v in m["buckets"].items()}
        batches = {b for m in kept for b in m["open"]}
        for b in self.folder.names("batches"):
            if int(b) not in batches:
                self.folder.remove(f"batches/{b}")
        for v in self.folder.names("base"):
            for name in self.folder.names(f"base/{v}"):
                if name.startswith("bucket=") and (v, name.split("=")[1]) not in used:
                    self.folder.remove(f"base/{v}/{name}")

    def read(self) -> DataFrame:
        """The table. Only where several batches meet are rows merged while reading: a batch holds a key once."""
        m = self.manifest()
        parts = self.bucket_rows(m, set(m["buckets"]))
        if not parts and len(m["open"]) == 1:
            parts = [self.rows_of([f"batches/{m['open'][0]}"])]
        elif m["open"]:
            parts = [self.winners(reduce(DataFrame.unionByName, [*parts, self.rows_of([f"batches/{b}" for b in m["open"]])]), "bucket")]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return reduce(DataFrame.unionByName, parts).select(*self.schema.names)
