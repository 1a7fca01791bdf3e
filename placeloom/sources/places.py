"""Targets of a run: gazetteer look-ups with commune enrichment, and recorded lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.plans.sweep import rivals

LANES = ("target", "osm", "registry")


def geocode(queries: DataFrame, gazetteer: DataFrame, communes: DataFrame) -> DataFrame:
    """``queries(query, pick)`` against recorded answers ``gazetteer(query, ord, label, lat, lon, importance, bbox, country, osm_type,
    osm_id, postcode)``, ord from 1, and ``communes(query, citycode, postcode)``.

    One row per query: ``(query, ok, reason, label, lat, lon, south, north, west, east, country, osm_type, osm_id, postcode, commune)``. Without a
    pick the first answer is taken unless a later one, nearly as important, lies elsewhere. A box that is not four numbers is drawn
    around the point. French targets get their commune, and its postcode if they have none."""
    q = queries.select(F.trim("query").alias("query"), "pick").distinct()
    answers = gazetteer.groupBy("query").agg(F.count("*").alias("answers"))
    doubtful = rivals(gazetteer.select("query", "ord", F.coalesce("importance", F.lit(0.0)).alias("importance"), "lat", "lon")).select("query").distinct().withColumn("rival", F.lit(True))
    hit = gazetteer.withColumnRenamed("query", "g_query")
    place = F.struct(*[c for c in gazetteer.columns if c not in ("query", "ord")])
    chosen = q.join(hit, (F.col("query") == F.col("g_query")) & (F.col("ord") == F.coalesce("pick", F.lit(1))), "left").select("query", "pick", F.when(F.col("g_query").isNotNull(), place).alias("g"))
    j = chosen.join(answers, "query", "left").join(doubtful, "query", "left").join(communes.select("query", "citycode", F.col("postcode").alias("c_postcode")), "query", "left")
    reason = (
        F.when(F.col("query") == "", "empty query")
        .when(F.col("answers").isNull(), "no result")
        .when(F.col("g").isNull(), "pick out of range")
        .when(F.col("pick").isNull() & F.col("rival"), "ambiguous")
    )
    j = j.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
    box = F.transform("g.bbox", lambda x: x.try_cast("double"))
    whole = (F.size("g.bbox") == 4) & F.forall(box, lambda x: x.isNotNull())
    side = lambda i, c, d: F.when(whole, F.get(box, F.lit(i))).otherwise(F.col(f"g.{c}") + d)
    france = F.lower("g.country") == "fr"
    out = dict(
        label=F.coalesce("g.label", "query"), lat=F.col("g.lat"), lon=F.col("g.lon"), south=side(0, "lat", -0.01), north=side(1, "lat", 0.01), west=side(2, "lon", -0.015), east=side(3, "lon", 0.015),
        country=F.lower("g.country"), osm_type=F.when(F.col("g.osm_type").isin("node", "way", "relation"), F.col("g.osm_type")), osm_id=F.col("g.osm_id"),
        postcode=F.coalesce("g.postcode", F.when(france, F.col("c_postcode"))), commune=F.when(france, F.col("citycode")),
    )
    return j.select("query", "ok", "reason", *[F.when(F.col("ok"), c).alias(k) for k, c in out.items()])


def record_lanes(folder: str, target: DataFrame, osm: DataFrame, registry: DataFrame) -> None:
    """Keep what the lanes of a run returned, so that the rest can be run again without them. A recording is not overwritten."""
    for lane, rows in zip(LANES, (target, osm, registry), strict=True):
        rows.write.parquet(f"{folder}/{lane}")


def load_lanes(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three lanes of a recording; a missing lane is an error, an empty target too."""
    lanes = {lane: spark.read.parquet(f"{folder}/{lane}") for lane in LANES}
    if lanes["target"].isEmpty():
        raise ValueError("a recording needs the target it was made for")
    return lanes

