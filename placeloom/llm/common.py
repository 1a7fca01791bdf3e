"""Shared folder, scratch tables and small readers used by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from placeloom import ship

_LOCAL: dict[str, str] = {}


# Arrow batches go by bytes as well as by rows, since ten thousand texts may be any size; shuffle files go when the execution that
# wrote them ends, since operators run several after one another
DEFAULTS = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def session_defaults(spark: SparkSession) -> None:
    """Set ``DEFAULTS`` once; what the application has set itself stays."""
    if not spark.conf.get("placeloom.defaults", None):
        spark.conf.set("placeloom.defaults", "set")
        for key, value in DEFAULTS.items():
            if spark.sparkContext.getConf().get(key) is None:
                spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a purely local session (tests) may fall back to a temporary folder.
    """
    ship(spark)
    session_defaults(spark)
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="placeloom-")
    return _LOCAL["dir"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    session_defaults(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def temporary_dir(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder that goes when the driver's JVM ends."""
    where = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    fs, p = filesystem(spark, where)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return where


class Scratch:
    """Parquet tables in the shared folder; a written table cuts lineage and survives lost executors.

    An operator drops all of its tables but those that its lazy result reads (``keep``); these go with the application."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = temporary_dir(spark, label)
        self._n = 0
        self._live: list[str] = []

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{name}"

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        where = self.path(name)
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch_path = where
        self._live.append(where)
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this scratch area that no pending plan reads any more."""
        delete_path(self.spark, df._scratch_path)
        self._live.remove(df._scratch_path)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        kept = {t._scratch_path for t in tables}
        for where in [w for w in self._live if w not in kept]:
            delete_path(self.spark, where)
        self._live = sorted(kept)


def filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)
