"""Cutting lineage after expensive or non-repeatable work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that model calls are not repeated when an executor is lost. Uses the shared
    folder named by ``spark.checkpoint.dir``. Where none is named, a local session (tests) gets a temporary one;
    on a cluster the executors could not read it, so that is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, made up for local sessions only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="recapflow-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read back. For loops: a checkpoint hands on the estimated size of its
    plan, and estimates multiply with every join of a loop, while a table has its own size. Tables stay until the
    folder is cleared, so they are packed tightly."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
