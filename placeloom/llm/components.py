"""Connected components over an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.common import Scratch


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(src long, dst long)`` -> ``(node, component)`` with component = smallest node reachable.

    Nodes without an edge to another node do not appear. Each round writes its edges to the shared
    folder, so lineage stays one round deep. The minimum per node is written before it is joined, which
    leaves both join sides plain exchanges that adaptive execution can split when a node is hot.
    Null ends and self loops are ignored; repeated edges count once; an empty table gives no rows.
    """
    e = (
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
        .distinct()
    )
    e = scratch.write(e, "edges")
    seen = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = scratch.write(
            both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large"
        )
        low2 = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = (
            large.join(low2, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .unionByName(low2.select("a", F.col("m").alias("b")))
            .distinct()
        )
        nxt = scratch.write(small, "edges")
        now = tuple(nxt.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.col("b").cast("decimal(20,0)"))).first())
        for old in (e, low, large, low2):
            scratch.drop(old)
        e = nxt
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
