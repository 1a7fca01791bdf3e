"""Point-of-interest extracts: raw elements to POI rows and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.functions import text
from placeloom.operators.areas import points_in_areas

ELEMENT_SCHEMA = T.StructType(
    [
        T.StructField("type", T.StringType()), T.StructField("id", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
        T.StructField("center", T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)

# fixed values: which tags make an element a business; whole keys, or listed values of a key
WHOLE_KEYS = "shop office craft healthcare club".split()
LISTED_VALUES = {
    "amenity": (
        "restaurant cafe bar pub fast_food food_court ice_cream biergarten bank bureau_de_change atm pharmacy clinic doctors dentist veterinary "
        "driving_school language_school prep_school music_school training childcare kindergarten school college university hospital nursing_home "
        "social_facility funeral_directors fuel car_wash car_rental car_sharing charging_station cinema theatre nightclub casino marketplace "
        "post_office coworking_space studio internet_cafe animal_boarding animal_shelter vehicle_inspection"
    ).split(),
    "tourism": "hotel motel hostel guest_house apartment chalet camp_site caravan_site museum gallery".split(),
    "leisure": (
        "fitness_centre sports_centre sports_hall dance escape_game bowling_alley amusement_arcade adult_gaming_centre horse_riding golf_course marina "
        "hackerspace trampoline_park"
    ).split(),
}
# fixed values: category keys in the order they are looked at
CATEGORY_KEYS = "shop office craft healthcare amenity tourism leisure club".split()
AREA_OFFSET = 3_600_000_000


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of an extract in JSON lines, explicit schema, bad lines kept aside as null rows."""
    return spark.read.schema(ELEMENT_SCHEMA).option("mode", "PERMISSIVE").json(path)


def business_filter(tags: Column, groups: list[str] | None = None) -> Column:
    wanted = groups or [*WHOLE_KEYS, *LISTED_VALUES]
    out = F.lit(False)
    for key in wanted:
        v = F.element_at(tags, F.lit(key))
        out = out | (v.isin(LISTED_VALUES[key]) if key in LISTED_VALUES else v.isNotNull())
    return F.coalesce(out, F.lit(False))


def within(elements: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Elements whose coordinate, or that of their centre, lies in a box; a box whose west is above its east crosses 180 degrees."""
    lat, lon = F.coalesce("lat", "center.lat"), F.coalesce("lon", "center.lon")
    columns = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return elements.where(lat.between(south, north) & columns)


def within_areas(spark: SparkSession, elements: DataFrame, areas: DataFrame) -> DataFrame:
    """Elements with the ``area_id`` of every administrative area of ``areas(area_id, rings, box)`` they lie in. An area whose outline is missing is
    read by its box instead, as a region that is too much for one question is."""
    placed = elements.select(F.struct(*elements.columns).alias("__e"), F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"))
    return points_in_areas(spark, placed, areas).select("__e.*", "area_id")


def to_pois(elements: DataFrame) -> DataFrame:
    """``(poi_id, osm_type, osm_id, name, lat, lon, tags)``; elements without a coordinate are dropped."""
    tag = lambda k: F.element_at("tags", F.lit(k))
    return elements.select(
        F.concat(F.substr("type", F.lit(1), F.lit(1)), F.col("id").cast("string")).alias("poi_id"), F.col("type").alias("osm_type"), F.col("id").alias("osm_id"),
        F.coalesce(tag("name"), tag("name:fr"), tag("brand"), tag("operator")).alias("name"), F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"),
        F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"),
    ).where("lat is not null and lon is not null")


def area_id(osm_type: Column, osm_id: Column) -> Column:
    return F.when(osm_type == "relation", osm_id + AREA_OFFSET)


def category(tags: Column) -> Column:
    """``key=value`` of the first category key; the bare key where the value is yes."""
    each = [F.when(F.element_at(tags, F.lit(k)) == "yes", F.lit(k)).otherwise(F.concat(F.lit(f"{k}="), F.element_at(tags, F.lit(k)))) for k in CATEGORY_KEYS]
    return F.coalesce(*each)


def website(tags: Column) -> Column:
    """First address of the first website tag, with a scheme."""
    raw = text.first_text(*[F.element_at(tags, F.lit(k)) for k in ("website", "contact:website", "url")])
    one = F.get(F.split(raw, r"[;\s]+"), F.lit(0))
    return F.when(one.rlike("(?i)^https?://"), one).otherwise(F.concat(F.lit("https://"), one))


def to_places(pois: DataFrame) -> DataFrame:
    tag = lambda k: F.element_at("tags", F.lit(k))
    site = website(F.col("tags"))
    return pois.select(
        F.concat(F.lit("osm:"), "poi_id").alias("place_id"), F.coalesce("name", F.lit("")).alias("name"), F.array(F.lit("osm")).alias("sources"), category(F.col("tags")).alias("category"),
        tag("addr:housenumber").alias("number"), tag("addr:street").alias("street"), tag("addr:postcode").alias("postcode"), tag("addr:city").alias("city"), "lat", "lon",
        site.alias("site_url"), F.when(site.isNotNull(), "declared").alias("site_confidence"),
    )


# fixed values: messages of an instance that is busy and of a question that is too big
BUSY = r"(?i)dispatcher|open64|too busy|rate.?limit|HTTP 50[234]|HTTP 429|HTTP 0\b|not JSON|fetch failed|aborted|socket|ETIMEDOUT|ECONNRESET"
TOO_BIG = r"(?i)query timed out|out of memory|too many results|memory limit"


def failure_class(message: Column) -> Column:
    """too-big: ask for less, no instance will give it; busy: ask another instance; a bare "timeout" says neither."""
    return F.when(message.rlike(TOO_BIG), "too-big").when(message.rlike(BUSY), "busy").otherwise("other")
