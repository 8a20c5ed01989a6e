"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset (one machine, tests) a temporary folder is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: its lineage ends here, and any executor can read it.
    The folder goes when the driver ends."""
    spark = df.sparkSession
    own = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    df.write.option("compression", "snappy").parquet(f"{own}/data")
    return spark.read.schema(df.schema).parquet(f"{own}/data")


def free_name(docs: DataFrame, name: str) -> str:
    """The name, or the first longer one that is no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
