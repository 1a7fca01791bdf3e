"""Importance resampling towards a target distribution, over hashed word n-grams.

Every feature's bucket has a gain, the scaled log ratio of its share in the target and in the corpus; a document's weight is the
sum of its features' gains, looked up in one array. Weights get integer Gumbel noise, so the highest scores are a draw without
replacement. The draw is exact: a histogram of the integer scores is summed from the top, which gives every score its
rank offset and the cutoff; only rows above it are numbered, by doc_id within their score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.llm.common import Scratch

BUCKETS, LONGEST, STEP = 10_000, 3, 1000
#: Coarse cells of the score histogram; bounds what meets in one place whatever the scores are.
CELLS = 1 << 16

_SPACED = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Shift:
    """What ``count`` zero bytes do to CRC-32 values: crc(a + b) = shift(crc(a), len(b)) ^ crc(b), for whole arrays at once."""

    def __init__(self) -> None:
        # how a step changes the low byte's part; XOR with the value of b"\0" removes what CRC-32 adds before and after
        step = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], dtype=np.uint32)
        values = np.array([[v << (8 * k) for v in range(256)] for k in range(4)], dtype=np.uint32)
        short = [values]  # short[l][k][v]: the value v in byte k, after l zero bytes
        for _ in range(256):
            values = step[values & 0xFF] ^ (values >> 8)
            short.append(values)
        self.high = [short.pop()]  # 256, 512, 1024... zero bytes
        self.short = np.array(short).reshape(-1)

    @staticmethod
    def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
        return table[0, c & 0xFF] ^ table[1, (c >> 8) & 0xFF] ^ table[2, (c >> 16) & 0xFF] ^ table[3, c >> 24]

    def __call__(self, c: np.ndarray, count: np.ndarray) -> np.ndarray:
        at = (count & 0xFF) << 10
        t = self.short
        out = t[at + (c & 0xFF)] ^ t[at + 256 + ((c >> 8) & 0xFF)] ^ t[at + 512 + ((c >> 16) & 0xFF)] ^ t[at + 768 + (c >> 24)]
        rest, k = count >> 8, 0
        while rest.any():
            if k == len(self.high):
                self.high.append(self._apply(self.high[-1], self.high[-1]))
            odd = np.flatnonzero(rest & 1)
            out[odd] = self._apply(self.high[k], out[odd])
            rest, k = rest >> 1, k + 1
        return out


_shift: Shift | None = None


def feature_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features, document of each feature, words of each document), whole texts."""
    global _shift
    _shift = _shift or Shift()
    words = [(t or "").encode("utf-8", "surrogatepass").translate(_SPACED).split() for t in texts]
    many = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for doc in words for w in doc]
    crc = np.fromiter(map(zlib.crc32, flat), np.uint32, len(flat))
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    doc = np.repeat(np.arange(len(words)), many)
    spaced = _shift(np.full(len(flat), zlib.crc32(b" "), dtype=np.uint32), size) ^ crc  # of " " + word
    runs, owners = [crc], [doc]
    run = crc
    for length in range(1, LONGEST):
        run = _shift(run[:-1], size[length:] + 1) ^ spaced[length:]  # run[i] ends with word i + length
        inside = doc[length:] == doc[: len(doc) - length]
        runs.append(run[inside])
        owners.append(doc[length:][inside])
    return np.concatenate(runs).astype(np.int64) % BUCKETS, np.concatenate(owners), many


def bucket_counts(texts: DataFrame, text: str) -> DataFrame:
    """``(bucket, n)`` over all texts; every task counts its own before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            total += np.bincount(feature_buckets(b.column(0).to_pylist())[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": total[at]})

    return texts.select(F.col(text).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, text: str = "text") -> np.ndarray:
    """Gain of every bucket: floor(1000 ln of its smoothed share in the target over that in the documents). ``BUCKETS`` counts of either
    side are all that reaches the driver."""
    s, t = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for counts, rows in ((s, documents), (t, target)):
        for r in bucket_counts(rows, text).collect():
            counts[r["bucket"]] = r["n"]
    all_s, all_t = int(s.sum()), int(t.sum())
    ratio = [float((int(y) + 1) * (all_s + BUCKETS)) / float((int(x) + 1) * (all_t + BUCKETS)) for x, y in zip(s, t, strict=True)]
    return np.array([math.floor(STEP * math.log(r)) for r in ratio], dtype=np.int64)


def gumbel(doc_id: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256('seed:doc_id')."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-STEP * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored_documents(documents: DataFrame, gains: np.ndarray, carry: list[str], seed: int, text: str = "text") -> DataFrame:
    """``(doc_id, n_features, n_words, weight, score[, document])``; the gains array is the only thing that tasks are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buckets, owner, many = feature_buckets(b.column(1).to_pylist())
            weight = np.zeros(len(many), dtype=np.int64)
            np.add.at(weight, owner, gains[buckets])
            features = np.bincount(owner, minlength=len(many))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(features), pa.array(many), pa.array(weight)], ["doc_id", *b.schema.names[2:], "n_features", "n_words", "weight"])

    document = [F.struct(*carry).alias("document")] if carry else []
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *document)
    kept = rows.drop("text")
    shape = T.StructType([*kept.schema.fields, *(T.StructField(c, T.LongType()) for c in ("n_features", "n_words", "weight"))])
    return rows.mapInArrow(run, shape).withColumn("score", F.col("weight") + gumbel("doc_id", seed))


def rank_offsets(scored: DataFrame, drawn: int) -> tuple[DataFrame, int]:
    """Of rows with a score, ``(score, before)`` for every score down to the cutoff, the score of the row of rank ``drawn``.

    The scores' range is cut into at most ``CELLS`` equal cells. Their counts, summed from the top on the driver, tell the cell of the
    cutoff; inside a cell the exact integer scores are summed by a window over the cell's histogram, which has no more
    rows than the cell has scores."""
    histogram = scored.groupBy("score").agg(F.count("*").alias("n"))
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    width = (high - low) // CELLS + 1
    histogram = histogram.withColumn("cell", F.expr(f"(score - ({low}L)) div {width}L"))
    cells = sorted(((r["cell"], r["n"]) for r in histogram.groupBy("cell").agg(F.sum("n").alias("n")).collect()), reverse=True)
    ends = np.cumsum([n for _, n in cells])
    last = int(np.searchsorted(ends, drawn))
    above = scored.sparkSession.createDataFrame([(int(c), int(e - n)) for (c, n), e in zip(cells[: last + 1], ends, strict=False)], "cell long, above long")
    inside = Window.partitionBy("cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    upper = histogram.where(F.col("cell") >= cells[last][0]).withColumn("higher", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    offsets = upper.join(F.broadcast(above), "cell").select("score", (F.col("above") + F.col("higher")).alias("before"))  # CELLS rows at most
    cutoff = offsets.where(F.col("before") < drawn).agg(F.min("score")).first()[0]
    return offsets.where(F.col("score") >= cutoff), cutoff


def importance_resample(
    spark: SparkSession, documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, carry: list[str] | None = None
) -> DataFrame:
    """``documents(doc_id, text, ...)`` and ``target(text, ...)`` -> ``(doc_id, n_features, weight, score, rank)``, one row per document.

    Of the N documents with at least ``least_words`` words, floor(percent N / 100) are drawn and have a rank from 1, highest score first, ties to the
    smaller doc_id; all others have none. Null and empty texts are documents without words: no features, weight 0. Rows without
    a doc_id have no score and take no part in the draw, though their features count. Repeated rows are documents of their own,
    of consecutive ranks. ``carry`` names columns that come back in a struct ``document``, such as the text; no other
    column is read, so names cannot clash. An empty target only smooths; an empty table of documents gives no rows.
    """
    carry = carry or []
    scratch = Scratch(spark, "importance")
    scored = scratch.write(scored_documents(documents, bucket_gains(documents, target), carry, seed), "scored")
    numbers = ["doc_id", "n_features", "weight", "score"]
    rest = ["document"] if carry else []
    eligible = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    entrants = scored.where(eligible)
    drawn = percent * entrants.count() // 100
    if not drawn:
        scratch.keep(scored)
        return scored.select(*numbers, F.lit(None).cast("long").alias("rank"), *rest)
    offsets, cutoff = rank_offsets(entrants, drawn)
    survivor = eligible & (F.col("score") >= cutoff)
    # rows that are alike in everything collapse before the shuffle, and come apart again afterwards
    alike = scored.where(survivor).groupBy(*numbers, *rest).agg(F.count("*").alias("m"))
    order = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight", F.xxhash64(*rest) if rest else F.lit(0))
    alike = alike.withColumn("end", F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(offsets, "score")
    first = F.col("before") + F.col("end") - F.col("m") + 1
    ranked = alike.withColumn("rank", F.explode(F.sequence(first, first + F.col("m") - 1)))
    ranked = ranked.select(*numbers, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"), *rest)
    others = scored.where(~F.coalesce(survivor, F.lit(False))).select(*numbers, F.lit(None).cast("long").alias("rank"), *rest)
    scratch.keep(scored)
    return ranked.unionByName(others)
