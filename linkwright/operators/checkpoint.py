"""Cutting lineage through files that all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def saved(df: DataFrame, what: str = "step") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, any executor may be lost.

    Files go when the application ends.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    # what was shuffled for it is garbage now; Spark frees those files once the driver has collected it
    gc.collect()
    jvm.System.gc()
    return spark.read.schema(df.schema).parquet(at)
