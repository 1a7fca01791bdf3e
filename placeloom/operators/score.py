"""Signals, score parts, ranking and headcount dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from placeloom.functions import dims


def size_bands(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({i}, '{code}', {floor}L, '{label}')" for i, (code, floor, label) in enumerate(dims.SIZE_BANDS))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(band_order, band, floor, label)")


def bands_at_least(spark: SparkSession, n: int) -> DataFrame:
    """Bands whose lower bound reaches n; the unknown band never does."""
    return size_bands(spark).where((F.col("floor") >= 0) & (F.col("floor") >= n))


def band_floor(band: Column) -> Column:
    out = F.lit(None).cast("long")
    for code, floor, _ in dims.SIZE_BANDS:
        if floor >= 0:
            out = F.when(band == code, F.lit(floor).cast("long")).otherwise(out)
    return out


def employee_floor(employees: Column, parent_band: Column, band: Column) -> Column:
    """Exact headcount, else the parent's band, else the own band; unknown is null."""
    return F.coalesce(F.when(employees >= 0, employees.cast("long")), band_floor(parent_band), band_floor(band))


def nace_section(code: Column) -> Column:
    return _letter(F.regexp_extract(code, r"^\s*(\d{1,2})", 1).try_cast("int"), dims.NACE_SECTIONS)


def us_sic_division(code: Column) -> Column:
    return _letter(F.substr(F.lpad(code, 4, "0"), F.lit(1), F.lit(2)).try_cast("int"), dims.US_SIC_DIVISIONS)


def _letter(number: Column, ranges: list[tuple[str, int, int, str]]) -> Column:
    out = F.lit(None).cast("string")
    for letter, low, high, _ in ranges:
        out = F.when(number.between(low, high), letter).otherwise(out)
    return out


def section_label(scheme: Column, letter: Column) -> Column:
    """Label of a letter in its vocabulary; letters of different schemes never mix, scheme none has none."""
    out = F.lit(None).cast("string")
    for name, table in (("nace", dims.NACE_SECTIONS), ("us-sic", dims.US_SIC_DIVISIONS)):
        for code, _, _, label in table:
            out = F.when((scheme == name) & (letter == code), label).otherwise(out)
    return out


def known_sections(scheme: Column, letters: Column) -> Column:
    """``(valid, unknown)`` letters of an array for a vocabulary."""
    nace, sic = ([r[0] for r in t] for t in (dims.NACE_SECTIONS, dims.US_SIC_DIVISIONS))
    table = F.when(scheme == "nace", F.array(*map(F.lit, nace))).when(scheme == "us-sic", F.array(*map(F.lit, sic))).otherwise(F.array().cast("array<string>"))
    upper = F.transform(letters, F.upper)
    return F.struct(F.array_intersect(upper, table).alias("valid"), F.array_except(upper, table).alias("unknown"))


def days_since(date: Column, as_of: Column) -> Column:
    """Days from an ISO date to ``as_of``, fractions of seconds included; null if unreadable. Negative for future dates."""
    return (F.unix_micros(as_of) - F.unix_micros(F.try_to_timestamp(date))) / 86400e6


def is_hiring(board_count: Column, has_careers_page: Column, open_roles: Column) -> Column:
    """Three-valued: no board and no careers page is no, open roles are yes, anything else is unknown."""
    return F.when((board_count == 0) & ~has_careers_page, False).when(open_roles > 0, True)


def oldest_role_days(posted: Column, as_of: Column) -> Column:
    """Whole days since the oldest readable date of an array, fractions of seconds included, not below zero; null without one."""
    oldest = F.array_min(F.filter(F.transform(posted, lambda d: F.unix_micros(F.try_to_timestamp(d))), lambda x: x.isNotNull()))
    days = F.floor((F.unix_micros(as_of) - oldest) / 86400e6).cast("long")
    return F.when(days < 0, F.lit(0).cast("long")).otherwise(days)


def matching_roles(titles: Column, terms: list[str]) -> Column:
    """Titles that contain any of the terms, case aside; all titles without terms."""
    if not terms:
        return titles
    hit = lambda t: F.exists(F.array(*[F.lit(x.lower()) for x in terms]), lambda x: F.contains(F.lower(t), x))
    return F.filter(titles, hit)


def js_round(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("long")


def score_parts(as_of: Column, weights: dict[str, int] | None = None) -> Column:
    """Map of the parts that were awarded. Columns read: site_confidence, site_reachable, last_content_at, page_count,
    is_hiring, open_roles, employee_floor, revenue, registered, contactable, has_ecommerce, has_pricing, matched_roles,
    term_matches, oldest_role_days. A future date makes the freshness part larger than its weight."""
    w = dims.WEIGHTS | (weights or {})
    age = days_since(F.col("last_content_at"), as_of)
    floor = F.col("employee_floor")
    parts = {
        "hasSite": F.when(F.col("site_confidence") == "corroborated", w["hasSite"]),
        "siteWorks": F.when(F.col("site_reachable") & (F.col("page_count") > 0), w["siteWorks"]),
        "fresh": F.when(age <= 180, js_round(w["fresh"] * (1 - age / 180))),
        "depth": F.when(F.col("page_count") > 0, F.least(F.lit(w["depth"]), F.col("page_count"))),
        "hiring": F.when(F.col("is_hiring").eqNullSafe(True), w["hiring"]),
        "openRoles": F.when(F.col("open_roles") > 0, F.least(F.lit(w["openRoles"]), F.col("open_roles") * 2)),
        "size": F.when(floor >= 0, js_round(w["size"] * F.least(F.lit(1.0), F.log10(F.greatest(F.lit(1), floor) + 1) / 3))),
        "revenue": F.when(F.col("revenue") > 0, js_round(w["revenue"] * F.least(F.lit(1.0), F.log10("revenue") / 8))),
        "registered": F.when(F.col("registered"), w["registered"]),
        "contactable": F.when(F.col("contactable"), w["contactable"]),
        "ecommerce": F.when(F.col("has_ecommerce"), w["ecommerce"]),
        "pricing": F.when(F.col("has_pricing"), w["pricing"]),
        "matchedRoles": F.when(F.col("matched_roles") > 0, F.least(F.lit(w["matchedRoles"]), F.col("matched_roles") * 4)),
        "termMatches": F.when(F.col("term_matches") > 0, w["termMatches"]),
        "staleRole": F.when(F.col("oldest_role_days") >= 90, w["staleRole"]),
    }
    every = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v.cast("long"))])
    return F.map_filter(every, lambda _, v: v.isNotNull() & (v != 0))


def score_total(parts: Column) -> Column:
    return F.aggregate(F.map_values(parts), F.lit(0).cast("long"), lambda a, x: a + x)


def score_places(places: DataFrame, as_of: Column, weights: dict[str, int] | None = None) -> DataFrame:
    return places.withColumn("parts", score_parts(as_of, weights)).withColumn("total", score_total(F.col("parts")))


def apply_fit(places: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attach ``(place_id, fit, why)`` without touching totals; also the verdicts whose place is unknown."""
    return places.join(verdicts, "place_id", "left"), verdicts.join(places.select("place_id"), "place_id", "left_anti")


def fit_rank(fit: Column) -> Column:
    return F.when(fit == "strong", 3).when(fit == "possible", 2).when(fit == "weak", 1).when(fit == "no", -2).otherwise(-1)


def ranked(places: DataFrame, tie: str = "place_id", limit: int | None = None) -> DataFrame:
    """Strong, possible, weak, unjudged, no; then total, then the tie column. A limit is a top-k, not a full sort."""
    order = [fit_rank(F.col("fit")).desc(), F.coalesce("total", F.lit(0)).desc(), F.col(tie)]
    if limit is not None:
        places = places.orderBy(*order).limit(limit)
    return places.withColumn("rank", F.row_number().over(W.orderBy(*order))) if limit is not None else places.orderBy(*order)


def table_order(column: Column, numeric: bool, descending: bool) -> Column:
    """Sort key of a table column: numbers by the number that a cell begins with, texts as they are; blanks, "?" and other
    cells without a number always come last, never as zero."""
    value = F.nullif(F.regexp_extract(F.trim(column), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0), F.lit("")).try_cast("double") if numeric else F.nullif(F.trim(column), F.lit(""))
    return value.desc_nulls_last() if descending else value.asc_nulls_last()


def keep_rows(places: DataFrame, min_score: int | None = None, min_fit: str | None = None) -> DataFrame:
    """Rows of the flat file: total at least min_score, fit at least min_fit on weak < possible < strong, others below all."""
    level = lambda c: F.array_position(F.array(F.lit("weak"), F.lit("possible"), F.lit("strong")), F.coalesce(c, F.lit(""))) - 1
    out = places
    if min_score is not None:
        out = out.where(F.coalesce("total", F.lit(0)) >= min_score)
    if min_fit is not None:
        out = out.where(level(F.col("fit")) >= level(F.lit(min_fit)))
    return out
