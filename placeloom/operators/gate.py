"""Verification gate: integrity rules whose findings fail or warn a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions import text

FINDING = ["severity", "rule", "place_id", "subject"]


def _found(df: DataFrame, rule: Column | str, subject: Column, severity: str = "error") -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), "place_id", subject.cast("string").alias("subject"))


def contacts(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """``claims(place_id, value, lane, from)``: every value not from open data names a page that holds it. Values and
    pages are compared folded and without separators."""
    c = claims.where("lane not in ('osm', 'registry')")
    j = c.join(pages.select("place_id", F.col("page_id").alias("from"), F.col("text").alias("page_text")), ["place_id", "from"], "left")
    gone = F.col("page_text").isNull()
    missing = ~F.contains(text.search_form(F.col("page_text")), text.search_form(F.col("value")))
    return _found(j.where(gone | missing), F.when(gone, "contact-unsourced").otherwise("contact-not-on-page"), F.col("value"))


def legal_ids(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """``claims(place_id, value, status, from)``: numbers read from pages name one that holds them."""
    j = claims.join(pages.select("place_id", F.col("page_id").alias("from"), F.col("text").alias("page_text")), ["place_id", "from"], "left")
    gone = F.col("page_text").isNull()
    missing = ~F.contains(text.id_form(F.col("page_text")), text.id_form(F.col("value")))
    return _found(j.where(gone | missing), F.when(gone, "legal-id-unsourced").otherwise("legal-id-not-on-page"), F.col("value"))


def registry_evidence(evidence: DataFrame, ids: DataFrame) -> DataFrame:
    """``evidence(place_id, legal_id)`` that no verified id of the place backs."""
    backed = ids.where("status = 'verified'").select("place_id", F.col("value").alias("legal_id"))
    return _found(evidence.where("legal_id is not null").join(backed, ["place_id", "legal_id"], "left_anti"), "registry-evidence-unbacked", F.col("legal_id"))


def orphan_dossiers(dossiers: DataFrame, places: DataFrame) -> DataFrame:
    keys = places.select(text.file_safe(F.col("place_id")).alias("file_id"))
    return _found(dossiers.select("file_id", F.col("file_id").alias("place_id")).join(keys, "file_id", "left_anti"), "dossier-orphan", F.col("file_id"))


def undated_records(dossiers: DataFrame, records: DataFrame) -> DataFrame:
    """A dossier about a dated record says its date, its month, or its year with "as of" or "as at"."""
    j = dossiers.join(records.where("as_of is not null").select("place_id", "as_of"), "place_id")
    year, month = F.substr("as_of", F.lit(1), F.lit(4)), F.substr("as_of", F.lit(1), F.lit(7))
    low = F.lower("body")
    said = F.contains(F.col("body"), F.col("as_of")) | F.contains(F.col("body"), month) | (F.contains(F.col("body"), year) & (F.contains(low, F.lit("as of")) | F.contains(low, F.lit("as at"))))
    return _found(j.where(~said), "dated-record-undated", F.col("as_of"))


def citations(dossiers: DataFrame, pages: DataFrame) -> DataFrame:
    """Cited pages exist; those of another place are foreign."""
    cited = dossiers.select("place_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\[(P\d+)\]"), F.lit(1)))).alias("page_id"))
    owner = pages.groupBy("page_id").agg(F.collect_set("place_id").alias("owners"))
    j = cited.join(owner, "page_id", "left")
    none = F.col("owners").isNull()
    return _found(j.where(none | ~F.array_contains("owners", F.col("place_id"))), F.when(none, "citation-unresolved").otherwise("citation-foreign"), F.col("page_id"))


def uncited_claims(dossiers: DataFrame) -> DataFrame:
    """Paragraphs that state facts without a ``[P#]`` or ``[M]`` mark. Fences are cut out first: after splitting at fence
    lines every second piece is code. Headings, lists of links and paragraphs under 40 characters are structure."""
    pieces = F.split(F.col("body"), r"(?m)^\s*```[^\n]*$")
    prose = F.filter(pieces, lambda _, i: i % 2 == 0)
    paragraphs = F.flatten(F.transform(prose, lambda p: F.split(p, r"\n\s*\n")))
    clean = F.transform(paragraphs, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"(?m)^\s*#.*$", ""), r"\s+", " ")))
    bad = F.filter(clean, lambda p: (F.length(p) >= 40) & ~p.rlike(r"\[(?:P\d+|M)\]"))
    return _found(dossiers.select("place_id", F.explode(bad).alias("paragraph")), "claim-uncited", F.substr("paragraph", F.lit(1), F.lit(80)))


def warnings(places: DataFrame, truncated: DataFrame, dossiers: DataFrame | None = None) -> DataFrame:
    """Findings that never fail a run; ``truncated(reason)`` are the lanes cut short. With ``dossiers`` given and none of them
    written that is said too."""
    cut = truncated.select(F.lit("warning").alias("severity"), F.lit("run-truncated").alias("rule"), F.lit("").alias("place_id"), F.col("reason").alias("subject"))
    places = places.withColumn("place_id", F.col("place_id").cast("string"))
    out = cut.unionByName(_found(places.where(F.col("reachable").eqNullSafe(False)), "site-unreachable", F.col("site_url"), "warning"))
    out = out.unionByName(_found(places.where(F.col("site_confidence") == "unverified"), "website-unverified", F.col("site_url"), "warning"))
    total = places.agg(F.count_if(F.col("site_confidence") == "corroborated").alias("sites"), F.count_if("enriched").alias("read"))
    cover = total.where("sites > read").select(F.lit("warning").alias("severity"), F.lit("coverage-enrichment").alias("rule"), F.lit("").alias("place_id"), F.concat_ws("/", "read", "sites").alias("subject"))
    out = out.unionByName(cover)
    if dossiers is None:
        return out
    none = dossiers.agg(F.count("*").alias("n")).where("n = 0")
    return out.unionByName(none.select(F.lit("warning").alias("severity"), F.lit("no-dossiers").alias("rule"), F.lit("").alias("place_id"), F.lit("dossiers").alias("subject")))


def quotes(values: DataFrame, pages: DataFrame, around: int = 170, per_place: int = 10, most_chars: int = 6000) -> DataFrame:
    """``values(place_id, ord, value, from)`` in their pages: found as written, case aside, else by their digits (all, the
    last nine, the last eight; six at least). Ten excerpts and 6000 characters per place; what is not found says so."""
    from pyspark.sql import Window as W

    j = values.join(pages.select("place_id", F.col("page_id").alias("from"), F.col("text").alias("page_text")), ["place_id", "from"], "left")
    low = F.lower(F.coalesce("page_text", F.lit("")))
    plain = F.expr("instr(lower(coalesce(page_text, '')), lower(value))")
    digits = F.regexp_replace("value", r"\D", "")
    spread = lambda d: F.when(F.length(d) >= 6, F.regexp_replace(d, r"(\d)(?=\d)", r"$1[\\s.()/-]*"))
    tries = [spread(digits), spread(F.right(digits, F.lit(9))), spread(F.right(digits, F.lit(8)))]
    found = F.coalesce(*[F.nullif(F.regexp_instr(low, t), F.lit(0)) for t in tries])
    at = F.coalesce(F.nullif(plain, F.lit(0)), found)
    begin = F.greatest(F.lit(1), at - around)
    piece = F.trim(F.regexp_replace(F.substr(F.col("page_text"), begin, F.length("value") + at - begin + around), r"\s+", " "))
    q = j.select("place_id", "ord", "value", "from", at.isNotNull().alias("found"), F.coalesce(piece, F.lit("")).alias("quote"))
    w = W.partitionBy("place_id").orderBy("ord")
    q = q.withColumn("n", F.row_number().over(w)).withColumn("chars", F.sum(F.length("quote")).over(w))
    return q.where((F.col("n") <= per_place) & (F.col("chars") <= most_chars)).select("place_id", "ord", "value", "from", "found", "quote")
