"""Size-tiered compaction of immutable Parquet shards under a versioned manifest, DataFrame functions only.

``append`` writes arrivals as small immutable shards without a shuffle. ``compact`` sorts shards below the
target size into tiers by the logarithm of their size; a tier with at least ``fan_in`` runs is merged into
target-sized files, again without a shuffle, until no tier is full. Each change is one new manifest version that says
which shards it adds and removes; every ``SNAPSHOT`` versions the whole list is written beside it, so a commit costs what
it changes and a reader replays a few versions. A version becomes current by a rename that fails if it exists
already, so readers always see whole versions and two writers cannot both commit; the file system must offer such a
rename (HDFS and POSIX folders do, plain object stores do not). Row data never pass the driver, only one manifest line
per shard does.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.llm.common import delete_path, filesystem

SNAPSHOT = 16


class CommitConflict(RuntimeError):
    """Another writer committed this manifest version first."""


class SchemaConflict(ValueError):
    """Arrivals have other columns or types than the store."""


def _bare(schema: T.StructType) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in schema}


class ShardStore:
    """A folder of shards; ``target_bytes`` is the wanted file size, ``fan_in`` the runs that fill a tier.

    The first append sets the columns and types. Nulls in any column, empty and long texts and repeated rows are kept as
    they come.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan_in: int = 4):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in

    # manifest -----------------------------------------------------------------------------------------------
    def _names(self, letter: str) -> list[int]:
        fs, p = filesystem(self.spark, f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:-5]) for n in names if n.startswith(letter) and n.endswith(".json"))

    def versions(self) -> list[int]:
        """Versions that can be read."""
        logs, snapshots = self._names("v"), self._names("s")
        least = min(logs + snapshots, default=0)
        return sorted({v for v in logs if v >= least} | set(snapshots))

    def _load(self, letter: str, version: int) -> dict:
        fs, p = filesystem(self.spark, f"{self.root}/manifest/{letter}{version:08d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> dict:
        """State at a version: the last snapshot up to it and the changes since. An empty store has version 0."""
        have = self.versions()
        version = (have[-1] if have else 0) if version is None else version
        if version and version not in have:
            raise KeyError(f"version {version} is not kept")
        base = max((s for s in self._names("s") if s <= version), default=0)
        state = self._load("s", base) if base else {"version": 0, "shards": [], "schema": None}
        for v in range(base + 1, version + 1):
            log = self._load("v", v)
            gone = set(log["remove"])
            state = {"version": v, "shards": [s for s in state["shards"] if s["path"] not in gone] + log["add"], "schema": log["schema"]}
        return state

    def _publish(self, name: str, content: dict) -> None:
        jvm = self.spark._jvm
        fs, final = filesystem(self.spark, f"{self.root}/manifest/{name}")
        _, draft = filesystem(self.spark, f"{self.root}/manifest/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, options)  # fails if the target exists
        except Exception as e:
            fs.delete(draft, False)
            raise CommitConflict(f"{name} exists") from e

    def _commit(self, base: dict, add: list[dict], remove: list[str], schema: str) -> dict:
        version = base["version"] + 1
        self._publish(f"v{version:08d}.json", {"version": version, "add": sorted(add, key=lambda s: s["path"]), "remove": sorted(remove), "schema": schema})
        gone = set(remove)
        new = {"version": version, "shards": [s for s in base["shards"] if s["path"] not in gone] + add, "schema": schema}
        if version % SNAPSHOT == 0:
            self._publish(f"s{version:08d}.json", new)
        return new

    def _written(self, where: str) -> list[dict]:
        fs, p = filesystem(self.spark, where)
        return [
            {"path": f"{where}/{s.getPath().getName()}", "bytes": s.getLen()}
            for s in fs.listStatus(p)
            if s.getPath().getName().endswith(".parquet")
        ]

    # operations ---------------------------------------------------------------------------------------------
    def append(self, rows: DataFrame) -> dict:
        """Add arrivals: every task of ``rows`` writes one shard. An empty arrival commits a version with no new rows.
        Columns may come in any order; another set of columns or another type raises ``SchemaConflict`` before anything
        is written."""
        base = self.manifest()
        schema = base["schema"] or rows.schema.json()
        held = T.StructType.fromJson(json.loads(schema))
        if _bare(held) != _bare(rows.schema):
            raise SchemaConflict(f"the store has {held.simpleString()}, arrivals have {rows.schema.simpleString()}")
        where = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.select(*[F.col(f"`{f.name}`") for f in held]).write.parquet(where)
        return self._commit(base, self._written(where), [], schema)

    def tier(self, size: int) -> int:
        """Tier 0 holds shards of at least the target; tier k those up to fan_in^k times smaller."""
        return 0 if size >= self.target // 2 else math.ceil(math.log(self.target / max(size, 1), self.fan_in) - 0.5)

    def compact(self) -> dict:
        """Merge full tiers until none is left; superseded shards stay until ``vacuum``. An empty store stays as it is."""
        while True:
            base = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for shard in base["shards"]:
                tiers.setdefault(self.tier(shard["bytes"]), []).append(shard)
            full = [k for k, runs in tiers.items() if k > 0 and len(runs) >= self.fan_in]
            merged: list[dict] = []
            for k in sorted(full, reverse=True):
                runs = tiers[k]
                files = max(1, round(sum(s["bytes"] for s in runs) / self.target))
                where = f"{self.root}/data/{uuid.uuid4().hex}"
                self._frame([s["path"] for s in runs], base["schema"]).coalesce(files).write.parquet(where)
                merged += self._written(where)
            gone = [s["path"] for k in full for s in tiers[k]]
            if len(merged) >= len(gone):
                return base
            self._commit(base, merged, gone, base["schema"])

    def vacuum(self, orphan_age_s: float = 86_400.0) -> None:
        """Delete shards that a version before the current one has removed, and the versions before the current one.
        Folders that no version ever named belong to a writer that is still at work, or failed: they go only when older
        than ``orphan_age_s``. A store without versions is left alone."""
        now = self.manifest()
        if not now["version"]:
            return
        live = {s["path"].rsplit("/", 1)[0] for s in now["shards"]}
        logs = self._names("v")
        if now["version"] not in self._names("s"):
            self._publish(f"s{now['version']:08d}.json", now)
        removed = {p.rsplit("/", 1)[0] for v in logs if v <= now["version"] for p in self._load("v", v)["remove"]}
        fs, p = filesystem(self.spark, f"{self.root}/data")
        for s in fs.listStatus(p):
            where = f"{self.root}/data/{s.getPath().getName()}"
            old = time.time() - s.getModificationTime() / 1000 > orphan_age_s
            if where not in live and (where in removed or old):
                delete_path(self.spark, where)
        for letter, names in (("v", logs), ("s", self._names("s"))):
            for v in names:
                if v < now["version"]:
                    delete_path(self.spark, f"{self.root}/manifest/{letter}{v:08d}.json")

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version. A store without versions has no columns and no rows."""
        m = self.manifest(version)
        return self._frame([s["path"] for s in m["shards"]], m["schema"])

    def _frame(self, paths: list[str], schema: str | None) -> DataFrame:
        typed = T.StructType.fromJson(json.loads(schema)) if schema else T.StructType([])
        if not paths:
            return self.spark.createDataFrame([], typed)
        return self.spark.read.schema(typed).parquet(*paths)


def shard_documents(
    spark: SparkSession, docs: DataFrame, root: str, arrivals: int = 3, target_bytes: int = 128 << 20, fan_in: int = 4
) -> ShardStore:
    """Append all rows in ``arrivals`` batches (by a hash of doc_id, null ids in batch 0), compacting after each."""
    store = ShardStore(spark, root, target_bytes, fan_in)
    batch = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)), F.lit(0))
    for k in range(arrivals):
        store.append(docs.where(batch == k))
        store.compact()
        store.vacuum()
    return store
