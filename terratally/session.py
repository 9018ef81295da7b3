"""Session helpers: where intermediate tables may be written."""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once a session, so that workers can import it from any folder."""
    sc = spark.sparkContext
    if getattr(sc, "_terratally_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "terratally_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._terratally_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so that lost executors cost no replay of earlier rounds."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def by_key(df: DataFrame) -> DataFrame:
    """The side of a join whose rows grow with the input: it meets the other one in shuffled parts.

    Spark guesses the size of a table behind ``explode``, ``inline`` or a Python function from the file below it,
    which can be thousands of times too small, and would send it whole through the driver.
    """
    return df.hint("merge")


def settled(df: DataFrame) -> DataFrame:
    """The same rows, whose columns later steps read as they are.

    Spark moves a filter below the selects that make its columns, and makes them there once more for the condition.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def spread(scan: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows of a file scan over at least as many partitions as there are cores.

    Small files are read by one task, however much work their rows bring; they are dealt out first. A scan that has
    enough partitions stays as it is. ``rows``: at most about so many of them in a partition.
    """
    parts = scan.sparkSession.sparkContext.defaultParallelism
    if rows:
        parts = max(parts, -(-scan.count() // rows))
    return scan.repartition(parts) if scan.rdd.getNumPartitions() < parts else scan


#: Rows of a wide table that a task sorts or gathers.
TASK_ROWS = 400_000


def parts_for(spark: SparkSession, rows: int) -> int | None:
    """Partitions for a shuffle of ``rows`` rows, or None where the session's own number is enough.

    With a fixed number a task sorts more rows the larger the input is.
    """
    parts = -(-rows // TASK_ROWS)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` to ``parts`` partitions; as they are without a number."""
    return df.repartition(parts, *keys) if parts else df
