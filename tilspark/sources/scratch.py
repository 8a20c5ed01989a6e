"""A folder that driver and executors share, for tables that are used more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, removed when the driver ends; where that is unset (one
    machine, tests) a temporary folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tables-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{own}/data"


def spread(df: DataFrame, least_rows: int = 256) -> DataFrame:
    """``df`` over as many tasks as there are cores, where its files make fewer (one row group is one
    task).  Files of a large table make more tasks than that, and nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores and len(df.head(least_rows)) == least_rows else df


#: bytes of files that a task's share of a large table is to hold: of text, n-grams take some fifty times that
PIECE = 8 << 20


def pieces(df: DataFrame) -> int:
    """How many pieces of ``PIECE`` bytes the files behind ``df`` make (what has no size counts nothing)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return -(-sum(x for x in sizes if x < 1 << 50) // PIECE)


def grouped(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df`` before an aggregation by ``keys``: dealt by them to ``n`` tasks where the session's number is
    smaller, so that a task's groups don't grow with the table."""
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
