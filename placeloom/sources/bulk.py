"""Bulk snapshots: readers, ingest into keyed Parquet, lookups by locality and identifier, freshness."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom import files
from placeloom.functions import text

LAYOUT = 4


def read_csv(spark: SparkSession, path: str, sep: str = ",", lines_in_fields: bool = True) -> DataFrame:
    """RFC 4180 rows: quotes, doubled quotes, line ends inside fields, BOM; names and values trimmed, missing cells empty.

    A file whose fields may hold line ends is read by one task, since only its start tells quotes apart; exports known to
    have none are read in splits with ``lines_in_fields=False``."""
    raw = spark.read.csv(
        path, header=True, sep=sep, quote='"', escape='"', multiLine=lines_in_fields, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", nullValue=None, emptyValue=""
    )
    return raw.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit(" \t\r\n")).alias(c.strip().lstrip("﻿")) for c in raw.columns])


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One text line per row in ``payload``; Spark reads .bz2 and .gz lines itself, bz2 in splits."""
    return spark.read.text(path).select(F.col("value").alias("payload")).where("trim(payload) <> ''")


def record_date(own: Column, vintage: str | None, modified: str | None, dated: bool = True) -> Column:
    """The row's date, else the snapshot's, else the file's; none for sources whose rows are not dated by it."""
    rest = [F.lit(x) for x in (vintage, modified) if x] if dated else []
    return F.coalesce(own, *rest)


class Snapshot:
    """A register snapshot as three bucketed, sorted Parquet tables: ``records`` by locality, narrow ``ids`` that point to records, and ``mapped`` by
    record.

    A batch look-up shuffles what is asked for to the snapshot's buckets; the snapshot itself is read where it lies, without an exchange.
    A single look-up reads one bucket, and in it the row groups whose statistics and Bloom filter may hold the key. A key
    with more than ``block`` rows, a capital for instance, is cut into slots that lie in different buckets; ``slots`` names such keys, and what asks for one
    asks for each of its slots. The tables are external; their entries in the session's catalog come and go with it.
    """

    def __init__(self, spark: SparkSession, folder: str, block: int = 1_000_000):
        self.spark, self.folder, self.block = spark, folder, block

    def ingest(self, records: DataFrame, total: int | None = None, vintage: str | None = None, modified: str | None = None, dated: bool = True, parts: int | None = None) -> dict:
        """Replace the snapshot by mapped records with ``localities`` and ``ids``; ``modified`` is the date of the export file.
        The new one is written beside the old and becomes current by one rename, so look-ups always read a whole one.
        ``parts`` buckets a table, by default one for every ``block`` rows, eight at least. No record is an error; more rejected than mapped rows a warning."""
        r = records.withColumn("as_of", record_date(F.col("as_of"), vintage, modified, dated)).withColumn("rec_key", F.concat_ws(":", "connector", F.coalesce("establishment_id", "id")))
        where = f"{self.folder}/{uuid.uuid4().hex}"
        r.write.parquet(f"{where}/read")
        r = self.spark.read.parquet(f"{where}/read")
        n = r.count()
        if n == 0:
            raise ValueError("no row of the export could be mapped")
        keys = F.array_distinct(F.filter(F.transform("localities", text.slug), lambda k: k != ""))
        ids = F.array_distinct(F.transform("ids", text.slug))
        parts = parts or max(8, -(-n // self.block))
        self._bucketed(r.withColumn("locality_key", F.explode(keys)), "records", "locality_key", parts, where)
        self._bucketed(r.select("rec_key", F.explode(ids).alias("id_key")).where("id_key <> ''").distinct(), "ids", "id_key", parts, where)
        self._bucketed(r, "mapped", "rec_key", parts, where)
        files.delete(self.spark, f"{where}/read")
        files.replace_text(self.spark, f"{self.folder}/CURRENT", f"{where} {parts}")
        skipped = None if total is None else total - n
        return {"rows": n, "skipped": skipped, "layout": LAYOUT, "warning": bool(skipped and skipped > n)}

    def _bucketed(self, df: DataFrame, name: str, key: str, parts: int, where: str) -> None:
        counts = df.groupBy(key).agg(F.ceil(F.count("*") / self.block).cast("int").alias("slots")).where("slots > 1")
        counts.write.parquet(f"{where}/{name}-slots")
        slots = self.spark.read.parquet(f"{where}/{name}-slots")
        slot = F.when(F.col("slots").isNull(), F.col(key)).otherwise(self._slot(key, F.pmod(F.xxhash64(*[c for c in ("rec_key", "id") if c in df.columns]), F.col("slots"))))
        keyed = df.join(slots, key, "left").withColumn("slot", slot).drop("slots")
        laid = keyed.repartition(parts, "slot").sortWithinPartitions("slot").write.option("path", f"{where}/{name}")
        # about as many different keys as rows in a bucket, at most
        laid = laid.option("parquet.bloom.filter.enabled#slot", "true").option("parquet.bloom.filter.expected.ndv#slot", str(min(self.block, 1_000_000)))
        laid.bucketBy(parts, "slot").sortBy("slot").saveAsTable(self._name(where, name))

    @staticmethod
    def _slot(key: str, k: Column) -> Column:
        return F.concat(F.col(key), F.lit("\x01"), k.cast("string"))  # keys are slugs or record keys, which hold no control characters

    @staticmethod
    def _name(where: str, name: str) -> str:
        return f"snapshot_{where.rstrip('/').rsplit('/', 1)[-1]}_{name}"

    def _where(self) -> tuple[str, int]:
        current = files.read_text(self.spark, f"{self.folder}/CURRENT")
        if current is None:
            raise FileNotFoundError(f"no snapshot in {self.folder}")
        where, _, parts = current.rpartition(" ")
        return where, int(parts)

    def current(self) -> str:
        """Folder of the snapshot that look-ups read."""
        return self._where()[0]

    def _read(self, name: str) -> DataFrame:
        where, parts = self._where()
        table = self._name(where, name)
        if not self.spark.catalog.tableExists(table):  # another session wrote it
            shape = self.spark.read.parquet(f"{where}/{name}").schema.toDDL()
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({shape}) USING parquet CLUSTERED BY (slot) SORTED BY (slot) INTO {parts} BUCKETS LOCATION '{where}/{name}'")
        return self.spark.table(table)

    def _asked(self, wanted: DataFrame, name: str, key: str) -> DataFrame:
        """What is asked for, once for each slot of its key."""
        slots = self.spark.read.parquet(f"{self.current()}/{name}-slots")
        each = wanted.join(slots, key, "left").withColumn("__k", F.explode(F.when(F.col("slots").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("slots") - 1))))
        return each.withColumn("slot", F.when(F.col("slots").isNull(), F.col(key)).otherwise(self._slot(key, F.col("__k")))).drop("slots", "__k")

    def localities(self, wanted: DataFrame, column: str = "locality") -> DataFrame:
        """Records of each of many wanted localities: one join on the key, an empty key finds nothing."""
        keyed = self._asked(wanted.withColumn("locality_key", text.slug(F.col(column))).where("locality_key <> ''"), "records", "locality_key")
        return keyed.drop("locality_key").join(self._read("records").drop("locality_key"), "slot").drop("slot")

    def identifiers(self, wanted: DataFrame, column: str = "wanted_id") -> DataFrame:
        """Records that carry each of many wanted identifiers, whole keys compared."""
        keyed = self._asked(wanted.withColumn("id_key", text.slug(F.col(column))).where("id_key <> ''"), "ids", "id_key")
        hits = keyed.drop("id_key").join(self._read("ids").select("slot", "rec_key"), "slot").drop("slot")
        return self._asked(hits, "mapped", "rec_key").drop("rec_key").join(self._read("mapped"), "slot").drop("slot")

    def _slots_of(self, name: str, key: str, value: str) -> list[str]:
        found = self.spark.read.parquet(f"{self.current()}/{name}-slots").where(F.col(key) == value).head(1)
        return [f"{value}\x01{k}" for k in range(found[0]["slots"])] if found else [value]

    def by_locality(self, locality: str, extra: Column | None = None, limit: int | None = None) -> DataFrame:
        """Records of exactly this locality, none if its key is empty; no limit unless asked for."""
        key = self._key(locality)
        out = self._read("records").where(F.col("slot").isin(self._slots_of("records", "locality_key", key)) & F.lit(key != "")).drop("slot")
        if extra is not None:
            out = out.where(extra)
        return out if limit is None else out.limit(limit)

    def by_id(self, value: str) -> DataFrame:
        key = self._key(value)
        hit = self._read("ids").where(F.col("slot").isin(self._slots_of("ids", "id_key", key)) & F.lit(key != "")).select("rec_key").distinct()
        return self._asked(hit, "mapped", "rec_key").select("slot").join(self._read("mapped"), "slot").drop("slot")

    def _key(self, value: str) -> str:
        return self.spark.range(1).select(text.slug(F.lit(value)).alias("k")).first()["k"]


def freshness(cached: DataFrame, upstream: DataFrame, tool: str) -> DataFrame:
    """``cached(source, modified, tool, layout)`` against ``upstream(source, modified)``: stale, outdated layout or fresh."""
    j = cached.join(upstream.withColumnRenamed("modified", "upstream"), "source", "left")
    state = F.when(F.col("layout") != LAYOUT, "unreadable").when(F.col("upstream") > F.col("modified"), "stale").when(F.col("tool") != tool, "other tool").otherwise("fresh")
    return j.select("source", state.alias("state"))


def client_filter(status: Column, band: Column, ceased: bool = False, bands: list[str] | None = None, around_point: bool = False) -> Column:
    """What a register's answer is filtered by afterwards: status always, headcount bands only where the endpoint for points
    could not filter them itself."""
    out = F.lit(True) if ceased else F.coalesce(status != "ceased", F.lit(True))
    return out & F.coalesce(band.isin(bands), F.lit(False)) if bands and around_point else out


def passes(status: Column, section: Column, code: Column, ceased: bool = False, sections: list[str] | None = None, prefixes: list[str] | None = None) -> Column:
    """Register filters: ceased rows only on demand, section one of, activity code begins with one of."""
    out = F.lit(True) if ceased else (status != "ceased")
    if sections:
        out = out & F.coalesce(section.isin(sections), F.lit(False))
    if prefixes:
        out = out & F.coalesce(F.exists(F.array(*map(F.lit, prefixes)), lambda p: code.startswith(p)), F.lit(False))
    return out
