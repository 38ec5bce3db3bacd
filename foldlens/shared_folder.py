"""The folder that driver and executors share, and cuts of lineage in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder that the context has been given.

    A session on one machine (master local) without either gets a temporary folder; on a
    cluster executors couldn't see that, so there it is an error.
    """
    context = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = context.getCheckpointDir()
    if named is None and held.isDefined():
        return held.get()
    if named is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="foldlens-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
