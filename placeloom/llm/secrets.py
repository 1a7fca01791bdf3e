"""Incremental secret scanning over a content-addressed blob ledger, DataFrame functions only.

Every historical version of a file is addressed by the SHA-256 of its text. Only blobs whose (blob, rule,
rule version) pair is not in the ledger are scanned, each blob once however many paths carry it; what was scanned, clean
or not, is appended to the ledger, a store of immutable shards under atomic versions, and findings are joined from it
back to all paths. Spans are code-point offsets, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.functions.arrays import blocks, running, running_sums
from placeloom.functions.extract import bound
from placeloom.llm.common import temporary_dir
from placeloom.llm.sharding import ShardStore


@dataclass(frozen=True)
class Rule:
    """``least`` is the fewest characters that ``group`` of a match must have; shorter matches are dropped
    after matching, so they still use up their characters. ``hints`` are sets of literals: one of each set must
    occur before the pattern is tried."""

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    hints: tuple[tuple[str, ...], ...] = ()


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    Rule("assign", 1, ASSIGN, 6, 2, ((":", "="),)),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", hints=(("AKIA",),)),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
EXTRA_RULES = (
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hints=(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),)),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=(("PRIVATE KEY-----",),)),
)
RULES = BASE_RULES + EXTRA_RULES
SPAN = "array<struct<start:bigint,end:bigint>>"
FOUND = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _spans(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches as spans: the pieces between matches and the matches themselves give every start by running
    sums, in linear work however many matches a text has."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.least else whole
    size = lambda c: F.length(c).cast("long")
    empty = F.array().cast(SPAN)

    def placed(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["pieces"], 1, F.size(x["m"])), x["m"], lambda gap, m: size(gap) + size(m))
        ends = F.zip_with(running_sums(steps), steps, lambda before, step: before + step)
        spans = F.zip_with(ends, F.arrays_zip(x["m"].alias("m"), x["j"].alias("j")), lambda end, m: F.struct((end - size(m["m"])).alias("start"), end.alias("end"), (F.length(m["j"]) >= rule.least).alias("ok")))
        return F.transform(F.filter(spans, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).cast(SPAN)

    found = bound(F.struct(F.split(text, rule.pattern, -1).alias("pieces"), whole.alias("m"), judged.alias("j")), placed)
    possible = text.rlike(rule.pattern)
    for hint in reversed(rule.hints):
        any_of = F.lit(False)
        for literal in hint:
            any_of = any_of | text.contains(literal)
        possible = any_of & possible
    return F.when(possible, found).otherwise(empty)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def new_ledger(spark: SparkSession, root: str | None = None) -> ShardStore:
    """A ledger at ``root``, or one that lasts as long as the application. Rows are (blob, scans of one run)."""
    return ShardStore(spark, root or f"{temporary_dir(spark, 'ledger')}/store")


def scan(versions: DataFrame, ledger: ShardStore, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the blobs of ``versions(text, ...)`` by the rules that the ledger does not have for them and add the outcome.
    Of two runs that commit at once one gets ``CommitConflict``."""
    blobs = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger.manifest()["version"]:
        pairs = ledger.read().select("blob", F.explode("scans").alias("s")).select("blob", F.concat_ws(":", "s.kind", "s.version").alias("pair"))
        blobs = blobs.join(pairs.groupBy("blob").agg(F.collect_set("pair").alias("seen")), "blob", "left")
    else:
        blobs = blobs.withColumn("seen", F.lit(None).cast("array<string>"))
    scans = [
        F.when(
            ~F.coalesce(F.array_contains("seen", f"{r.kind}:{r.version}"), F.lit(False)),
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _spans(F.col("text"), r).alias("spans")),
        )
        for r in rules
    ]
    ledger.append(blobs.select("blob", F.array_compact(F.array(*scans)).alias("scans")).where("size(scans) > 0"))


def hits(ledger: ShardStore, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, spans)`` of all blobs of the ledger with a finding by these rules, spans sorted by start, then rule order."""
    current = F.lit(False)
    rank = F.lit(None).cast("int")
    for i, r in enumerate(rules):
        mine = (F.col("kind") == r.kind) & (F.col("version") == r.version)
        current, rank = current | mine, F.when(mine, F.lit(i)).otherwise(rank)
    found = ledger.read().select("blob", F.inline("scans")).where("size(spans) > 0").where(current)
    whole = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank"), s["end"].alias("end"), F.col("kind")))
    found = found.withColumn("rank", rank).select("blob", whole.cast(FOUND).alias("spans"))
    found = found.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    # repeats stand side by side once sorted; array_distinct compares structs all with all
    once = bound(F.col("spans"), lambda v: F.filter(v, lambda s, i: F.when(i > 0, s != F.get(v, i - 1)).otherwise(True)))
    return found.select("blob", once.alias("spans"))


def findings(versions: DataFrame, keys: list[str], ledger: ShardStore, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``versions`` with its keys, ``blob`` and ``spans`` as the ledger has them."""
    paths = versions.select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], blob_of(F.col("text")).alias("blob"))
    return paths.join(hits(ledger, rules), "blob", "left").select(
        *[F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)], "blob", F.coalesce("spans", F.array().cast(FOUND)).alias("spans")
    )


def scan_versions(
    spark: SparkSession, versions: DataFrame, keys: list[str], ledger: ShardStore | None = None, rules: tuple[Rule, ...] = RULES
) -> tuple[DataFrame, ShardStore]:
    """``versions(*keys, text, ...)`` -> (findings, ledger): scans what the ledger lacks, then one row per input row.

    Null text is the empty blob. Repeated rows come back as often as they came. Columns beyond keys and text
    are ignored. An empty table gives empty results.
    """
    ledger = ledger or new_ledger(spark)
    scan(versions, ledger, rules)
    return findings(versions, keys, ledger, rules), ledger


def redacted(spark: SparkSession, docs: DataFrame, ledger: ShardStore | None = None) -> DataFrame:
    """The same rows and columns with every secret's characters replaced by its kind in brackets; where spans
    overlap the first names the kind. ``n_chars``, if there, follows the new text; clean rows come back unchanged, null
    texts and repeated rows too. Any other column names may occur."""
    ledger = ledger or new_ledger(spark)
    scan(docs, ledger)
    rows = docs.select(blob_of(F.col("text")).alias("blob"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(hits(ledger), "blob", "left")
    text = F.col("row.text")
    between = lambda t, a, b: F.substr(t, (a + 1).cast("int"), (b - a).cast("int"))

    def piece(cut: Column) -> Column:
        """A block of spans is replaced in its own stretch of the text, since cutting at a place costs the way there."""
        first, last = F.get(cut, F.lit(0))["upto"], F.element_at(cut, -1)["start"]
        one = lambda t, s: F.concat(between(t, s["upto"] - first, s["start"] - first), F.lit("["), s["kind"], F.lit("]"))
        return bound(between(text, first, last), lambda t: F.array_join(F.transform(cut, lambda s: one(t, s)), ""))

    upto = running(F.transform("spans", lambda s: s["end"]), F.lit(0).cast("long"), lambda a, x: F.greatest(a, x))
    placed = F.zip_with("spans", upto, lambda s, before: F.struct(before.alias("upto"), s["start"].alias("start"), s["kind"].alias("kind")))
    kept = F.filter(placed, lambda s: s["start"] >= s["upto"])
    rest = F.substr(text, (F.array_max(F.transform("spans", lambda s: s["end"])) + 1).cast("int"))
    clean = F.concat(F.array_join(F.transform(blocks(kept), piece), ""), rest)
    new = joined.select("row", F.when(F.col("spans").isNotNull(), clean).alias("new"))
    changed = {"text": F.col("new"), "n_chars": F.length("new").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    old = lambda c: F.col("row").getField(c)
    return new.select(*[(F.when(F.col("new").isNotNull(), changed[c]).otherwise(old(c)) if c in changed else old(c)).alias(c) for c in docs.columns])


def span_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_digest(spark: SparkSession, docs: DataFrame, arrivals: int = 2) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``: per row counts of the three base
    kinds, a digest of the base spans, and all spans as text.

    Null and empty texts have none; repeated rows and several texts under one doc_id come back as often as they came, null ids too;
    no other column is read, so names cannot clash; an empty table gives no rows. Work is linear in a text's matches.
    Rows arrive in batches by a hash of doc_id (null ids first) at one ledger, so a text that an earlier batch brought is not
    scanned again."""
    ledger = new_ledger(spark)
    batch = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)), F.lit(0))
    for k in range(arrivals):
        scan(docs.where(batch == k), ledger)
    found = findings(docs, ["doc_id"], ledger)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
