import random

import pytest
from pyspark.sql import functions as F

from placeloom.functions import arrays


@pytest.mark.parametrize("size", [1, 3, 512])
def test_running_values(spark, size):
    g = random.Random(size)
    rows = [(i, [g.randint(0, 9) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 4, 9, 10, 600])] + [(99, None)]
    df = spark.createDataFrame(rows, "k int, v array<long>")
    most = arrays.running(F.col("v"), F.lit(0).cast("long"), lambda a, x: F.greatest(a, x), size)
    for r in df.select("v", arrays.running_sums(F.col("v"), size).alias("s"), most.alias("m"), F.flatten(arrays.blocks(F.col("v"), size)).alias("b")).collect():
        if r.v is None:
            assert not r.s and not r.m
            continue
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v))] and r.m == [max([0, *r.v[:i]]) for i in range(len(r.v))] and r.b == r.v
