"""Fetched pages: outcomes, run-wide page ids and robots rules over recorded responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from placeloom.operators import ranks
from placeloom.operators.skew import two_way

READABLE_CHARS = 120


def fetch_outcome(status: Column, text: Column) -> Column:
    """ok, or why a page is of no use: no answer, an answer outside 2xx, or too little readable text."""
    return (
        F.when(status.isNull(), "unreachable")
        .when(~status.between(200, 299), F.concat(F.lit("http "), status.cast("string")))
        .when(F.length(F.trim(F.coalesce(text, F.lit("")))) < READABLE_CHARS, "no readable text")
        .otherwise("ok")
    )


def page_ids(spark: SparkSession, pages: DataFrame, order: list[Column], existing: DataFrame | None = None) -> DataFrame:
    """``P1``, ``P2``, ... over the whole run in the order pages were read, so an id names one page of one place. With the
    ``existing(page_id)`` of earlier passes numbers go on after the highest."""
    start = 1
    if existing is not None:
        start += existing.agg(F.max(F.regexp_extract("page_id", r"^P(\d+)$", 1).try_cast("long"))).first()[0] or 0
    numbers = ranks.numbered(spark, pages, order, "page_number", start)
    return numbers.withColumn("page_id", F.concat(F.lit("P"), F.col("page_number").cast("string"))).drop("page_number")


def robots_rules(files: DataFrame) -> DataFrame:
    """``files(site, body)`` -> ``(site, agent, allow, path)``. Consecutive user-agent lines head one group of rules."""
    line = F.posexplode(F.split("body", r"\r?\n")).alias("ord", "raw")
    rows = files.select("site", line).withColumn("raw", F.regexp_replace("raw", "#.*$", "")).where("raw like '%:%'")
    rows = rows.select("site", "ord", F.lower(F.trim(F.substring_index("raw", ":", 1))).alias("field"), F.trim(F.expr("substr(raw, instr(raw, ':') + 1)")).alias("value"))
    rows = rows.where(F.col("field").isin("user-agent", "allow", "disallow"))
    w = W.partitionBy("site").orderBy("ord")
    head = (F.col("field") == "user-agent") & ~F.lag("field").over(w).eqNullSafe("user-agent")
    rows = rows.withColumn("head", head.cast("int")).withColumn("group", F.sum("head").over(w))
    agents = rows.where("field = 'user-agent'").select("site", "group", F.lower("value").alias("agent"))
    rules = rows.where("field <> 'user-agent'").select("site", "group", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"))
    return agents.join(rules, ["site", "group"], "left").select("site", "agent", "allow", "path")


def _rule_pattern(path: Column) -> Column:
    quoted = F.regexp_replace(path, r"([.+?^{}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\$(?!$)", r"\\\$"))


def allowed(urls: DataFrame, rules: DataFrame, agent: str, block: int = 20_000) -> DataFrame:
    """``urls(site, path)`` with ``allowed``: of the groups that name the agent the longest name counts (``*`` last), of
    its matching rules the longest, allow on ties. No rule means allowed.

    A rule is joined by its head, the text before its first wildcard or end mark, on the url's prefixes of the lengths that heads of the site have, so
    a url meets only rules whose head it begins with; of these only rules with a tail are tested. A head that many rules and urls of a site share
    is dealt out to many tasks."""
    mine = rules.where((F.col("agent") == "*") | F.contains(F.lit(agent.lower()), F.col("agent")))
    rank = F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))
    best = mine.groupBy("site").agg(F.max(rank).alias("best"))
    mine = mine.withColumn("rank", rank).join(best, "site").where("rank = best and path <> ''").select("site", F.col("path").alias("rule"), "allow").distinct()
    mine = mine.withColumn("head", F.regexp_extract("rule", r"^(.*?)(?:\*|\$$|$)", 1))
    lengths = mine.groupBy("site").agg(F.array_sort(F.collect_set(F.length("head"))).alias("lengths"))
    asked = urls.select("site", "path").distinct()
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    spread = asked.join(lengths, "site").select("site", "path", F.explode(prefixes).alias("head"))
    met = two_way(spread, mine, ["site", "head"], block)
    hit = met.where((F.col("head") == F.col("rule")) | F.regexp("path", _rule_pattern(F.col("rule"))))
    said = hit.groupBy("site", "path").agg(F.max_by("allow", F.struct(F.length("rule"), "allow")).alias("allow"))
    return urls.join(said, ["site", "path"], "left").select("site", "path", F.coalesce("allow", F.lit(True)).alias("allowed"))
