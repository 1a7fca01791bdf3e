"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosine check, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.common import Scratch
from placeloom.llm.components import connected_components

BLOCK = 1024


def plan_tables(n: int, threshold: float, recall: float, per_bucket: int = 1024) -> tuple[int, int]:
    """(bits, tables): bits grow with log2 n so that buckets keep their size; tables follow from the recall
    that a pair exactly at the threshold must reach."""
    bits = max(4, math.ceil(math.log2(max(n, 2) / per_bucket)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def normalised(rows: list[np.ndarray]) -> np.ndarray:
    x = np.asarray(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _sign(bits: int, tables: int, seed: int):
    planes: dict[int, np.ndarray] = {}

    def signatures(x: np.ndarray) -> np.ndarray:
        dim = x.shape[1]
        if dim not in planes:
            planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))
        up = (x @ planes[dim] >= 0).reshape(len(x), tables, bits)
        return (up * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, part in frame.groupby(frame["embedding"].map(len), sort=False):
                x = normalised(part["embedding"].tolist())
                yield pd.DataFrame(
                    {
                        "rep": part["rep"].to_numpy(),
                        "mult": part["mult"].to_numpy(),
                        "label": part["label"].to_numpy(),
                        "dim": x.shape[1],
                        "vec": part["embedding"].tolist(),
                        "sig": list(signatures(x)),
                    }
                )

    return run


def groups_of(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole groups from key-sorted batches, also those that span batches."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        k = frame[key].to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(k)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = frame.iloc[a:b]
            if held and held[0][key].iloc[0] != part[key].iloc[0]:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def _verify(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in groups_of(frames, "pair_key"):
            if len(part) < 2:
                continue
            x, rep, mult = normalised(part["vec"].tolist()), part["rep"].to_numpy(), part["mult"].to_numpy()
            sig, t = np.asarray(part["sig"].tolist()), int(part["t"].iloc[0])
            first, other = part["mine"].to_numpy(), part["other"].to_numpy()
            low_block, high_block = min(first[0], other[0]), max(first[0], other[0])
            a = np.flatnonzero(first == low_block)
            b = a if low_block == high_block else np.flatnonzero(first == high_block)
            if not len(a) or not len(b):
                continue
            near = x[a] @ x[b].T >= threshold
            if b is a:
                np.fill_diagonal(near, False)
            for s in range(t):  # a pair counts in the first table that brings it together
                if not near.any():
                    break
                near &= sig[a, s][:, None] != sig[b, s][None, :]
            if not near.any():
                continue
            counts = np.zeros(len(part), dtype=np.int64)
            counts[a] += near @ mult[b]
            if b is not a:
                counts[b] += near.T @ mult[a]
            low = rep.copy()
            while True:
                before = low.copy()
                la, lb = low[a], low[b]
                big = np.iinfo(np.int64).max
                low[a] = np.minimum(la, np.where(near, lb[None, :], big).min(axis=1))
                low[b] = np.minimum(low[b], np.where(near, low[a][:, None], big).min(axis=0))
                if (low == before).all():
                    break
            hit = np.flatnonzero(counts)
            yield pd.DataFrame({"rep": rep[hit], "links": counts[hit], "low": low[hit]})

    return run


def near_duplicate_vectors(
    spark: SparkSession, vectors: DataFrame, threshold: float = 0.93, recall: float = 0.995, block: int = BLOCK, seed: int = 7
) -> DataFrame:
    """``vectors(vec_id, embedding, label, ...)`` -> ``(vec_id, n_links, component_id, kept)``, one row per input row.

    Vectors link when labels are equal and not null and the double-precision cosine is >= threshold. Null,
    zero, empty vectors and those with null or non-finite components link with nothing, nor do rows with a
    null id. Vectors of different dimension never link. Every row is a vector of its own: repeated rows link with each
    other, and different vectors under one vec_id have their own links and component. Equal vectors of a label collapse
    into one class with a multiplicity before hashing; classes go by a 64-bit hash of their SHA-256, so the result is exact up to its collisions. Buckets above ``block`` members are compared block against block; a
    pair is counted only in the first table whose signature it shares, so counts need no pair shuffle. At the
    threshold a pair is found with probability >= ``recall``; above it the odds only rise. Other columns are ignored; an
    empty table gives no rows.
    """
    scratch = Scratch(spark, "vectors")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), F.col("label"))
    finite = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    valid = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & finite
        & F.expr("exists(embedding, x -> x <> 0)")
    )
    key = F.when(valid, F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.col("embedding").cast("string")), 256))
    v = v.withColumn("key", F.when(key.isNotNull(), F.xxhash64(key)))
    classes = scratch.write(
        v.where("key is not null")
        .groupBy(F.col("key").alias("rep"))
        .agg(F.min("vec_id").alias("first_id"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("embedding").alias("embedding")),
        "classes",
    )
    bits, tables = plan_tables(classes.count(), threshold, recall)
    element = classes.schema["embedding"].dataType.elementType.simpleString()
    label = classes.schema["label"].dataType.simpleString()
    signed = scratch.write(
        classes.mapInPandas(
            _sign(bits, tables, seed), f"rep long, mult long, label {label}, dim int, vec array<{element}>, sig array<long>"
        ),
        "signed",
    )
    bucket = F.xxhash64("t", "label", "dim", "s")
    narrow = signed.select("rep", "label", "dim", F.posexplode("sig").alias("t", "s")).select("rep", "t", bucket.alias("key"))
    counts = scratch.write(narrow.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    many = signed.select("*", F.posexplode("sig").alias("t", "s")).withColumn("key", bucket)
    nb = F.ceil(F.col("n") / block)
    dealt = (
        many.join(counts, "key")
        .withColumn("mine", F.pmod(F.xxhash64("rep", F.lit("block")), nb))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), nb - 1)))
        .select("rep", "mult", "vec", "sig", "t", "mine", "other", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("pair_key"))
    )
    found = scratch.write(
        dealt.repartition("pair_key").sortWithinPartitions("pair_key").mapInPandas(_verify(threshold), "rep long, links long, low long"),
        "found",
    )
    groups = connected_components(spark, found.select(F.col("rep").alias("src"), F.col("low").alias("dst")), scratch)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    placed = scratch.write(
        classes.select("rep", "mult", "first_id")
        .join(links, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("rep", "first_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")),
        "placed",
    )
    first = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    per_class = scratch.write(placed.join(first, "component").select(F.col("rep").alias("key"), "n_links", "component_id"), "per_class")
    scratch.keep(per_class)
    out = v.select("vec_id", "key").join(per_class, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
