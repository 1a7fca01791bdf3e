"""CSV members of zip archives as a Spark data source: one partition a member, read where the task runs."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from placeloom import ship

ROWS = 4096  # rows of one Arrow batch


def locate(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path within it; a path without a scheme is local."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def archives(path: str) -> list[str]:
    """The archive, or all archives of a folder, in the order of their names."""
    system, inner = locate(path)
    info = system.get_file_info(inner)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == arrow_fs.FileType.File:
        return [path]
    found = system.get_file_info(arrow_fs.FileSelector(inner))
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in found if f.is_file and f.base_name.lower().endswith(".zip"))


def _open(archive: str) -> zipfile.ZipFile:
    system, inner = locate(archive)
    return zipfile.ZipFile(pa.PythonFile(system.open_input_file(inner), mode="r"))


def _rows(stream, sep: str) -> Iterator[list[str]]:
    csv.field_size_limit(1 << 30)
    for row in csv.reader(io.TextIOWrapper(stream, encoding="utf-8-sig", newline=""), delimiter=sep):
        if any(cell.strip() for cell in row):
            yield [cell.strip() for cell in row]


class Member(InputPartition):
    def __init__(self, archive: str, member: str):
        self.archive, self.member = archive, member


class MemberReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.suffix, self.sep = options["path"], options.get("suffix", ".csv").lower(), options.get("sep", ",")
        self.names = [f.name for f in schema.fields]

    def partitions(self) -> list[Member]:
        """From the central directories alone; no member is opened."""
        out = []
        for archive in archives(self.path):
            with _open(archive) as z:
                out += [Member(archive, i.filename) for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith(self.suffix)]
        return out

    def read(self, part: Member) -> Iterator[pa.RecordBatch]:
        with _open(part.archive) as z, z.open(part.member) as stream:
            rows = _rows(stream, self.sep)
            at = {name: k for k, name in reversed(list(enumerate(next(rows, []))))}
            batch: list[list[str]] = []
            for row in rows:
                batch.append([row[at[n]] if n in at and at[n] < len(row) else "" for n in self.names])
                if len(batch) == ROWS:
                    yield self._arrow(batch)
                    batch = []
            if batch:
                yield self._arrow(batch)

    def _arrow(self, rows: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=self.names)


class ZipCsv(DataSource):
    """``spark.read.format("zip_csv")`` with the options ``suffix`` and ``sep``; without a schema the header of the first member tells it."""

    @classmethod
    def name(cls) -> str:
        return "zip_csv"

    def schema(self) -> StructType:
        reader = MemberReader(dict(self.options), StructType())
        parts = reader.partitions()
        if not parts:
            raise FileNotFoundError(f"no member {reader.suffix} in {reader.path}")
        with _open(parts[0].archive) as z, z.open(parts[0].member) as stream:
            return StructType([StructField(n, StringType()) for n in dict.fromkeys(next(_rows(stream, reader.sep), [])) if n])

    def reader(self, schema: StructType) -> DataSourceReader:
        return MemberReader(dict(self.options), schema)


def read_zip_csv(spark: SparkSession, path: str, suffix: str = ".csv", sep: str = ",", schema: str | None = None) -> DataFrame:
    """RFC 4180 rows of all members with the suffix of an archive, or of all archives of a folder. Stored and deflated members, ZIP64 too; each is
    read by one task, as deflate has no split points, in bounded batches. Members may order their columns differently; a column that a
    member lacks is empty, as are missing cells; blank lines are skipped, names and values trimmed. Executors must reach the path; a damaged
    member fails the job."""
    ship(spark)
    spark.dataSource.register(ZipCsv)
    reader = spark.read.format("zip_csv").option("suffix", suffix).option("sep", sep)
    return (reader.schema(schema) if schema else reader).load(path)
