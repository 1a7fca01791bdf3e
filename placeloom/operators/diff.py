"""Set operations over runs: deterministic dedupes and the run-to-run delta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_seen(rows: DataFrame, key: Column, order: Column) -> DataFrame:
    """One row per key, the first by order. Hash-aggregates with map-side combine instead of sorting whole keys."""
    return _pick(rows, key, order, F.min_by)


def last_wins(rows: DataFrame, key: Column, order: Column) -> DataFrame:
    """One row per key, the last by order: the union of record stores where a later record replaces an earlier."""
    return _pick(rows, key, order, F.max_by)


def _pick(rows: DataFrame, key: Column, order: Column, by) -> DataFrame:
    whole = F.struct(*rows.columns)
    return rows.groupBy(key.alias("__k")).agg(by(whole, order).alias("__r")).select("__r.*")


def union_records(stores: list[DataFrame], key: str) -> DataFrame:
    """Union of stores by name; for a key in several stores the last store wins, inside a store its last row."""
    tagged = None
    for i, s in enumerate(stores):
        part = s.withColumn("__store", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    order = F.struct("__store", *[c for c in ("ord",) if c in tagged.columns])
    return last_wins(tagged, F.col(key), order).drop("__store")


def identity(connector: Column, establishment: Column, record: Column, osm: Column, place: Column) -> Column:
    """Cross-run identity: the record key, else ``osm:`` id, else the place id."""
    return F.when(record.isNotNull(), F.concat_ws(":", connector, F.coalesce(establishment, record))).when(osm.isNotNull(), F.concat(F.lit("osm:"), osm)).otherwise(place)


KINDS = ("appeared", "disappeared", "closed", "startedHiring", "stoppedHiring", "newRoles", "gotWebsite", "siteChanged", "wentDark")


def diff_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(delta_kind, key, detail)`` between two runs of ``(key, ord, status, is_hiring, titles, site_url, site_confidence,
    reachable)``; of repeated keys in a run the last row counts.

    Unknown is never no: hiring stops only when yes becomes no, starts when anything else becomes yes; a site goes dark
    when reachable yes becomes no; a lost website is not reported. One full outer join serves all nine sets.
    """
    side = lambda df, p: last_wins(df, F.col("key"), F.col("ord")).select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    return changes(side(before, "b").join(side(after, "a"), F.col("b_key") == F.col("a_key"), "full_outer"))


def changes(j: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The change sets of rows that hold a key's state before (``b_`` columns) and after (``a_``); no key on a side means it is not there."""
    both = F.col("b_key").isNotNull() & F.col("a_key").isNotNull()
    site = lambda p: F.when(F.col(f"{p}_site_confidence") == "corroborated", F.col(f"{p}_site_url"))
    yes, no = (lambda c: F.col(c).eqNullSafe(True)), (lambda c: F.col(c).eqNullSafe(False))
    lower = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lower)
    fresh = F.array_join(F.array_sort(F.array_except(lower("a_titles"), lower("b_titles"))), "|")
    row = lambda kind, when, detail: F.when(when, F.struct(F.lit(kind).alias("delta_kind"), detail.alias("detail")))
    none = F.lit("")
    rows = F.array_compact(
        F.array(
            row("appeared", F.col("b_key").isNull(), none),
            row("disappeared", F.col("a_key").isNull(), none),
            row("closed", both & (F.col("b_status") == "active") & (F.col("a_status") == "ceased"), none),
            row("startedHiring", both & ~yes("b_is_hiring") & yes("a_is_hiring"), F.size("a_titles").cast("string")),
            row("stoppedHiring", both & yes("b_is_hiring") & no("a_is_hiring"), none),
            row("newRoles", both & yes("a_is_hiring") & (fresh != ""), fresh),
            row("gotWebsite", both & site("b").isNull() & site("a").isNotNull(), site("a")),
            row("siteChanged", both & (site("b") != site("a")), F.concat(site("b"), F.lit(" -> "), site("a"))),
            row("wentDark", both & yes("b_reachable") & no("a_reachable"), none),
        )
    )
    carry = carry or []
    return j.select(*carry, F.coalesce("a_key", "b_key").alias("key"), F.inline(rows)).select(*carry, "delta_kind", "key", "detail")


def truncated_top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First n rows and whether more exist, from n + 1 fetched."""
    top = rows.orderBy(*order).limit(n + 1)
    w = W.orderBy(*order)
    return top.withColumn("__rn", F.row_number().over(w)).withColumn("truncated", F.max("__rn").over(W.partitionBy()) > n).where(F.col("__rn") <= n).drop("__rn")


def batches(rows: DataFrame, order: list[Column], size: int, limit: int) -> DataFrame:
    """The first ``limit`` rows in batches of ``size``."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("batch", F.floor((F.row_number().over(W.orderBy(*order)) - 1) / size).cast("long"))


def reciprocal_rank_fusion(lists: DataFrame, key: str, list_id: str, rank: str, k: int = 60) -> DataFrame:
    """Sum over lists of 1 / (k + rank), ranks from 1; a key counts once per list at its best rank."""
    best = lists.groupBy(key, list_id).agg(F.min(rank).alias("r"))
    return best.groupBy(key).agg(F.sum(F.lit(1.0) / (k + F.col("r"))).alias("score"))


def dedupe_keep_max(rows: DataFrame, key: Column, score: str, order: str) -> DataFrame:
    """One row per key at the place of its first occurrence, with the highest score of the key."""
    others = [c for c in rows.columns if c not in (score, order)]
    return rows.groupBy(key.alias("__k")).agg(
        F.min_by(F.struct(*others), F.col(order)).alias("__r"), F.max(score).alias(score), F.min(order).alias(order)
    ).select("__r.*", score, order)
