"""Corpus pipeline: quality classifier, SimHash near-dedup, benchmark decontamination, secret scans, best-fit packing.

Every stage takes (spark, docs, sf_dir); docs has the columns of documents and is all that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm import decontaminate, packing, quality, secrets, simhash
from placeloom.llm.common import table, temporary_dir
from placeloom.llm.queries import PACK_TOKENIZER

THRESHOLD = 0.3
#: SQL cannot express the learned score, the near-duplicate sketches or the tokenizer; tests use brute force instead.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; rows of any other kind stay as they came, repeats too.
    Without labelled documents of both kinds there is no classifier, and all stay."""
    net = quality.fit_quality(spark, docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_udf(net)("text") >= THRESHOLD) if net.learned else docs


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the one under the smallest doc_id stays, once even if its row is repeated. Texts are
    judged by themselves: different texts under one doc_id may all stay. Rows without a doc_id stay. Null and empty texts are
    one group. Columns of any name come through; an empty table stays empty."""
    groups = simhash.similar_texts(spark, docs).where("component is not null").groupBy("component")
    keep = groups.agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = docs.where("doc_id is not null").select(whole, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    named = named.join(keep, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return named.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within the edit limit go, all rows of such a text. Null and empty texts hold none and stay; long texts are
    searched whole; rows without a doc_id are judged like any other, columns of any name come through."""
    return decontaminate.without_leaks(spark, docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's characters are replaced by its kind in brackets; documents stay, repeated rows, null texts and rows without a doc_id too. n_chars
    follows the text; all other columns, of any name, come through."""
    return secrets.redacted(spark, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens. A null or empty text is one piece, its end mark; longer
    texts than a sequence are cut; repeated rows are packed as often as they come. Other columns are left behind."""
    return packing.pack_documents(spark, docs, PACK_TOKENIZER)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written to the shared folder and read again."""
    where = temporary_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
    return docs
