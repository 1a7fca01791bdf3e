"""Tallies, distributions and the coverage sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.functions import dims
from placeloom.operators import score


def tally(rows: DataFrame, key: Column, order: Column, limit: int | None = None) -> DataFrame:
    """``(key, n)`` by count, ties in first-seen order; blank keys do not count."""
    k = rows.select(key.alias("key"), order.alias("ord")).where("key is not null and key <> ''")
    out = k.groupBy("key").agg(F.count("*").alias("n"), F.min("ord").alias("first_seen")).orderBy(F.col("n").desc(), "first_seen")
    return out if limit is None else out.limit(limit)


def activity_label(scheme: Column, letter: Column, administrative: Column, category: Column) -> Column:
    """Vocabulary label with scheme and letter, else the administrative label, else the map category, else unclassified."""
    label = score.section_label(scheme, letter)
    return F.coalesce(F.concat(label, F.lit(" ("), scheme, F.lit(" "), letter, F.lit(")")), administrative, F.substring_index(category, "=", 1), F.lit("unclassified"))


def band_distribution(spark: SparkSession, rows: DataFrame, band: Column, connector: Column) -> DataFrame:
    """Counts in declared band order; the connector is named only if there are several."""
    counts = rows.select(band.alias("band"), connector.alias("connector")).where("band is not null").groupBy("band", "connector").agg(F.count("*").alias("n"))
    several = rows.agg(F.countDistinct(connector).alias("connectors"))
    out = counts.join(score.size_bands(spark), "band").crossJoin(F.broadcast(several))  # one row
    label = F.when(F.col("connectors") > 1, F.concat("label", F.lit(" · "), "connector")).otherwise(F.col("label"))
    return out.select("band_order", "band", label.alias("label"), "n").orderBy("band_order", "label")


def score_histogram(spark: SparkSession, totals: DataFrame) -> DataFrame:
    """All fixed bands in order, empty ones too."""
    band = F.lit(None).cast("string")
    for label, low, high in dims.SCORE_BANDS:
        band = F.when(F.col("total").between(low, high), label).otherwise(band)
    rows = ", ".join(f"({i}, '{label}')" for i, (label, _, _) in enumerate(dims.SCORE_BANDS))
    every = spark.sql(f"SELECT * FROM VALUES {rows} AS t(band_order, band)")
    counts = totals.select(band.alias("band")).groupBy("band").agg(F.count("*").alias("n"))
    return every.join(counts, "band", "left").select("band_order", "band", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy("band_order")


def contact_counts(places: DataFrame) -> DataFrame:
    """One row: contactability, websites by confidence, technology and pages in a single pass."""
    has = lambda c: F.size(c) > 0
    return places.agg(
        F.count("*").alias("places"), F.count_if(has("emails")).alias("with_emails"), F.count_if(has("phones")).alias("with_phones"),
        F.count_if(has("emails") & has("phones")).alias("with_both"), F.count_if(has("emails") | has("phones")).alias("with_any"),
        F.count_if(F.col("site_confidence") == "corroborated").alias("corroborated"), F.count_if(F.col("site_confidence") == "declared").alias("declared"),
        F.count_if(F.col("site_confidence") == "unverified").alias("unverified"), F.count_if(F.col("cms").isNotNull()).alias("with_cms"),
        F.count_if("has_pricing").alias("with_pricing"), F.count_if("has_ecommerce").alias("with_ecommerce"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages_read"),
    )


def hiring_counts(places: DataFrame) -> DataFrame:
    """Three-valued: hiring, not hiring and unknown over enriched rows; roles only of those that hire."""
    h = F.col("is_hiring")
    return places.agg(
        F.count_if(h.eqNullSafe(True)).alias("hiring"), F.count_if(h.eqNullSafe(False)).alias("not_hiring"), F.count_if(h.isNull()).alias("unknown"),
        F.coalesce(F.sum(F.when(h.eqNullSafe(True), F.col("open_roles"))), F.lit(0)).alias("open_roles"), F.coalesce(F.sum("matched_roles"), F.lit(0)).alias("matched_roles"),
    )


def register_counts(places: DataFrame) -> DataFrame:
    """By connector: places, dated records and their years, head offices, ceased, officers."""
    return places.where("connector is not null").groupBy("connector").agg(
        F.count("*").alias("n"), F.count("as_of").alias("dated"), F.nullif(F.array_join(F.sort_array(F.collect_set(F.substr("as_of", F.lit(1), F.lit(4)))), ","), F.lit("")).alias("years"),
        F.count_if("is_head_office").alias("head_offices"), F.count_if(F.col("status") == "ceased").alias("ceased"), F.sum("n_officers").alias("officers"),
    )


def legal_id_counts(places: DataFrame) -> DataFrame:
    """Counts by status after flattening ``legal_ids`` (array of structs with status)."""
    return places.select(F.explode("legal_ids").alias("l")).groupBy(F.col("l.status").alias("status")).agg(F.count("*").alias("n"))


def top_technologies(places: DataFrame, order: Column, limit: int = 10) -> DataFrame:
    stack = F.concat(F.coalesce("tech_stack", F.array().cast("array<string>")), F.array_compact(F.array("cms")))
    return tally(places.select(order.alias("o"), F.posexplode(stack).alias("i", "tech")), F.col("tech"), F.struct("o", "i"), limit)


def fold_notes(notes: DataFrame, cap: int = 25) -> DataFrame:
    """``notes(ord, text)`` -> distinct notes with counts: stage summaries first in order, then by count."""
    g = notes.groupBy("text").agg(F.count("*").alias("n"), F.min("ord").alias("first_seen"))
    summary = F.col("text").rlike("^(scan|confirm|match|resolve|enrich|score|dossier|check|render):")
    return g.withColumn("is_summary", summary).orderBy(F.col("is_summary").desc(), F.when(summary, F.lit(0).cast("long")).otherwise(-F.col("n")), "first_seen").limit(cap)


def brief(places: DataFrame, order: Column) -> DataFrame:
    """Lexicon and role filter of the first place that has them, and how many places they hit."""
    first = lambda c: F.min_by(F.when(F.size(c) > 0, F.col(c)), F.when(F.size(c) > 0, order)).alias(c)
    return places.agg(first("term_lexicon"), first("role_filter"), F.count_if(F.col("term_matches") > 0).alias("term_hits"), F.count_if(F.col("matched_roles") > 0).alias("role_hits"))


def lane_totals(lanes: DataFrame) -> DataFrame:
    """Requested and returned per lane kind; a run is truncated if any lane is."""
    return lanes.groupBy("lane").agg(F.sum("requested").alias("requested"), F.sum("returned").alias("returned"), F.bool_or("truncated").alias("truncated"))


def coverage_sentence(lanes: DataFrame, *by: str) -> DataFrame:
    """One row, or one for each run ``by``, saying where the places come from: a register sweep beats a confirm pass beats the map alone."""
    flags = lanes.groupBy(*by).agg(F.bool_or((F.col("lane") == "registry") & (F.col("mode") == "sweep")).alias("sweep"), F.bool_or((F.col("lane") == "registry") & (F.col("mode") == "confirm")).alias("confirm"), F.bool_or(F.col("lane") == "osm").alias("osm"))
    said = (
        F.when(F.col("sweep"), "register swept and fused with the map")
        .when(F.col("confirm"), "map places, each confirmed against a register")
        .when(F.col("osm"), "map places only; no register was asked")
        .otherwise("built from given rows")
    )
    return flags.select(*by, said.alias("coverage"))


def privacy_counts(places: DataFrame) -> DataFrame:
    """Officers, people and e-mails that look personal."""
    personal = F.size(F.filter("emails", lambda e: e.rlike("^[a-z]+[._-][a-z]+@")))
    return places.agg(F.sum("n_officers").alias("officers"), F.sum("n_people").alias("people"), F.sum(personal).cast("long").alias("personal_emails"))


def share(n: Column, total: Column) -> Column:
    """``n (p%)``; without a total just n."""
    return F.when(total > 0, F.concat(n.cast("string"), F.lit(" ("), F.floor(100.0 * n / total + 0.5).cast("long").cast("string"), F.lit("%)"))).otherwise(n.cast("string"))


def extent(places: DataFrame) -> DataFrame:
    """Bounds and best score for a map."""
    return places.agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.max("total").alias("best"))


def project(lat: Column, lon: Column, south: Column, north: Column, west: Column, east: Column, width: float = 800.0, height: float = 600.0) -> Column:
    """(x, y) on a canvas, longitudes scaled by the cosine of the middle latitude."""
    k = F.cos(F.radians((south + north) / 2))
    scale = F.least(F.lit(width) / F.greatest((east - west) * k, F.lit(1e-9)), F.lit(height) / F.greatest(north - south, F.lit(1e-9)))
    return F.struct(((lon - west) * k * scale).alias("x"), ((north - lat) * scale).alias("y"))


FACETS = {
    "brief": lambda: (F.col("term_matches") > 0) | (F.col("matched_roles") > 0),
    "hiring": lambda: F.col("is_hiring").eqNullSafe(True),
    "site": lambda: F.col("site_confidence") == "corroborated",
    "contact": lambda: (F.size("emails") > 0) | (F.size("phones") > 0),
    "reg": lambda: F.col("connector").isNotNull(),
    "judged": lambda: F.col("fit").isNotNull(),
    "dated": lambda: F.col("as_of").isNotNull(),
}


def facets(places: DataFrame) -> DataFrame:
    """``(facet, n)`` of the facets that split the places: more than none, fewer than all."""
    one = places.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(p(), F.lit(False))).alias(k) for k, p in FACETS.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("facet"), F.col(k).alias("n")) for k in FACETS])
    return one.select("total", F.inline(rows)).where("n > 0 and n < total").select("facet", "n")


def haystack(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
