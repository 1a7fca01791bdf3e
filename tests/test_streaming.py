import pytest
from pyspark.sql import functions as F

from placeloom import catalogue
from placeloom.operators.diff import diff_runs
from placeloom.streaming.deltas import DeltaFeed, run_deltas

SF = "/root/testdata/sf0.001"


def _stream(spark, folder, name):
    shape = spark.read.parquet(f"{folder}/in").schema
    rows = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = run_deltas(rows).writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/state-{name}")
    q.trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/{name}").select("run", "delta_kind", "key", "detail").collect())


@pytest.mark.parametrize("pieces", [1, 3])
def test_any_batching_gives_the_changes_of_whole_runs(spark, tmp_path, pieces):
    """Three runs, in one batch each or in several, and stopped in the middle; the third lacks what the first had."""
    first, second = catalogue._run(spark, SF, 0), catalogue._run(spark, SF, 1)
    runs = [first, second, first.where("ord % 4 > 0").withColumn("is_hiring", F.lit(True))]
    beat = first.limit(1).withColumn("key", F.lit(None).cast("string"))

    def arrive(rows, run):
        parts = rows.withColumn("run", F.lit(run).cast("long")).repartition(pieces, "ord") if rows is not beat else rows.withColumn("run", F.lit(run).cast("long")).coalesce(1)
        for k in range(parts.rdd.getNumPartitions()):
            parts.where(F.spark_partition_id() == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    arrive(runs[0], 0)
    arrive(runs[1], 1)
    before = _stream(spark, str(tmp_path), "out")
    assert before == []  # the second run is still open
    arrive(runs[2], 2)
    _stream(spark, str(tmp_path), "out")  # from the checkpoint
    arrive(beat, 3)
    got = _stream(spark, str(tmp_path), "out")
    want = sorted((k + 1, *r) for k in (0, 1) for r in map(tuple, diff_runs(runs[k], runs[k + 1]).collect()))
    assert got == want and {r[1] for r in got} >= {"appeared", "disappeared", "startedHiring", "newRoles"}


def test_feed_needs_its_last_run(spark, tmp_path):
    schema = "key string, ord int, status string, is_hiring boolean, titles array<string>, site_url string, site_confidence string, reachable boolean"
    row = spark.createDataFrame([("x", 1, "active", None, ["a"], None, None, True)], schema)
    feed = DeltaFeed(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        feed(row, 3)
    feed = DeltaFeed(str(tmp_path / "b"))
    feed(row, 0)
    feed(row.limit(0), 2)
    assert [r.delta_kind for r in spark.read.parquet(f"{tmp_path}/b/delta-2").collect()] == ["disappeared"]
