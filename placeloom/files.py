"""Small files on whatever file system a path names, through the session's Hadoop configuration."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """Content of a file, None if there is none."""
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, content: str) -> None:
    """Write a file whole beside its predecessor and put it in its place; readers see the old or the new one."""
    fs, target = filesystem(spark, path)
    _, draft = filesystem(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(content.encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context.rename(draft, target, options)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder."""
    fs, p = filesystem(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def unzip_member(spark: SparkSession, archive: str, folder: str, suffix: str = ".csv") -> str:
    """Unpack the first member with the suffix into a folder, which may be remote: zip is no codec of Spark. One stream on the
    driver, whatever the size."""
    jvm = spark._jvm
    fs, p = filesystem(spark, archive)
    source = jvm.java.util.zip.ZipInputStream(fs.open(p))
    try:
        while (entry := source.getNextEntry()) is not None:
            name = entry.getName()
            if name.lower().endswith(suffix):
                where = f"{folder.rstrip('/')}/{name.rsplit('/', 1)[-1]}"
                target_fs, target = filesystem(spark, where)
                out = target_fs.create(target, True)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                out.close()
                return where
    finally:
        source.close()
    raise FileNotFoundError(f"no member {suffix} in {archive}")
