"""Cutting lineage through the reliable checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Local sessions (tests) without a checkpoint folder get a temporary one; a cluster must name one that its machines share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = context.getConf().get("spark.checkpoint.dir")
        if where is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="placeloom-ck-"))
    return df.checkpoint()
