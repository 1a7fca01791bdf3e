"""Spark-native company intelligence: fuse points of interest with registers, mine pages, score, check and report."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path


def scratch_dir(spark, label: str) -> str:
    """A new folder that driver and executors share and that goes when the driver's JVM ends."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="placeloom-")
    where = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return where


def ship(spark) -> None:
    """Let Python workers import this package from where the driver has it, whatever their working folder.

    On clusters without a shared file system the package is passed to spark-submit like any other dependency."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
