"""Streaming extras: run-to-run deltas of arriving records and snapshots, and windowed tallies of job events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom import files
from placeloom.operators.diff import changes, diff_runs

#: Run r is second r + 1 of event time and the watermark is half a second behind, so rows of one run are never late for each other; a row of
#: run r + 1 takes the watermark past the end of run r, a quarter of a second after it. Milliseconds.
SECOND, BEHIND, CLOSING = 1000, 500, 250
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_deltas(rows: DataFrame, first: int = 0, late: int = 0) -> DataFrame:
    """Stream of ``rows(run long, key, ord, ...)``, the columns of ``diff_runs`` and the number of the run that a row belongs to -> ``(run, delta_kind, key,
    detail)``: what each run after the ``first`` changed against the one before, as ``diff_runs`` has it, however rows fall into micro-batches.

    Two windowed aggregations: the last row of a key in a run, and of these the pairs of a run and the run before, in windows that are two runs
    long. Rows of a batch are combined before they meet their state. A run is closed by
    the first row of the run ``late`` + 1 after it; rows that come later are dropped by the watermark. A row without a key is a heartbeat that only
    closes runs. Needs the RocksDB state store, which is set here for the session."""
    spark = rows.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    columns = [f for f in rows.schema.fields if f.name not in ("run", "key")]
    timed = rows.withColumn("at", F.timestamp_seconds(F.col("run") + 1)).withWatermark("at", f"{late * SECOND + BEHIND} milliseconds")
    timed = timed.where(F.when(F.col("at").isNotNull(), F.col("key")).isNotNull())  # one that names the time stays above the watermark, which heartbeats must reach
    others = [f.name for f in columns if f.name != "ord"]
    ends = lambda: (F.unix_millis("w.end") - CLOSING) / SECOND - 1
    one, two, start = f"{SECOND} milliseconds", f"{2 * SECOND} milliseconds", f"{CLOSING} milliseconds"
    last = timed.groupBy(F.window("at", one, one, start).alias("w"), "key").agg(F.max(F.struct(F.col("ord").cast("long").alias("ord"), F.struct(*others).alias("row"))).alias("x"))
    last = last.select("w", "key", ends().cast("long").alias("own"), "x")
    pairs = last.groupBy(F.window("w", two, one, start).alias("w"), "key").agg(F.max(F.struct("own", "x")).alias("late"), F.min(F.struct("own", "x")).alias("early"))
    pairs = pairs.withColumn("run", ends().cast("long"))
    side = lambda p: [F.when(F.col(p).isNotNull(), F.col("key")).alias(f"{p}_key"), F.col(f"{p}.ord").alias(f"{p}_ord"), *[F.col(f"{p}.row.{c}").alias(f"{p}_{c}") for c in others]]
    both = pairs.where(F.col("run") > first).select(
        "run", "key", F.when(F.col("early.own") < F.col("run"), F.col("early.x")).alias("b"), F.when(F.col("late.own") == F.col("run"), F.col("late.x")).alias("a")
    )
    return changes(both.select("run", *side("b"), *side("a")), ["run"])


def windowed_tally(events: DataFrame, ts: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per key and tumbling window, closed by a watermark; works on streams and on tables."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


class DeltaFeed:
    """``foreachBatch`` sink: each micro-batch is a run; writes what changed since the batch before it.

    State is the last run as Parquet under ``folder``; a replayed batch rewrites its own output, so the result is the same
    however often it is tried."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{self.folder}/run-{epoch}")
        now = spark.read.parquet(f"{self.folder}/run-{epoch}")
        held = [int(n[4:]) for n in files.names(spark, self.folder) if n.startswith("run-")]
        last = max((n for n in held if n < epoch), default=None)
        if last is None and epoch:
            raise FileNotFoundError(f"no run before {epoch} in {self.folder}: its changes cannot be told")
        before = now.limit(0) if last is None else spark.read.parquet(f"{self.folder}/run-{last}")
        diff_runs(before, now).write.mode("overwrite").parquet(f"{self.folder}/delta-{epoch}")
