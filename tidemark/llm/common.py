"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, and only where that is unset
    and everything runs on one machine (tests) a folder of our own. A cluster must name one."""
    global _OWN_DIR
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")
    return _OWN_DIR


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches of texts by bytes instead of by rows alone, since a text may be long: a
    batch is held by the JVM and by the Python worker at once. A setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multipliers) over uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
