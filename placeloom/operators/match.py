"""Entity resolution: spatial candidates, identity-dominant pair score, bands, one-to-one assignment and fusion."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from placeloom.functions import geo, text
from placeloom.operators.cut import cut as _cut

MAX_DISTANCE_M = 150.0
MERGE_HIGH = 0.72
MERGE_LOW = 0.40
MIN_IDENTITY = 0.25
CELL = 0.002


@dataclass(frozen=True)
class MatchPlan:
    """``mode`` 'exact' widens the longitude look-up with latitude so that no pair within the distance is missed;
    'grid3x3' looks at the eight neighbouring cells only."""

    max_distance_m: float = MAX_DISTANCE_M
    high: float = MERGE_HIGH
    low: float = MERGE_LOW
    min_identity: float = MIN_IDENTITY
    cell: float = CELL
    mode: str = "exact"


def spatial_candidates(pois: DataFrame, records: DataFrame, plan: MatchPlan = MatchPlan()) -> DataFrame:
    """Pairs of ``pois(poi_ord, p_lat, p_lon, ...)`` and ``records(rec_ord, r_lat, r_lon, ...)`` within the distance.

    The POI side is replicated to the cells around it and joined on the cell, an equi-join that Spark can shuffle,
    split when a cell is hot or broadcast when small; the exact distance is a residual filter.
    """
    lat0, lon0 = geo.cell(F.col("p_lat"), plan.cell), geo.cell(F.col("p_lon"), plan.cell)
    around = lambda c: c
    if plan.mode == "exact":
        dy = geo.lat_reach(plan.max_distance_m, plan.cell)
        reach = geo.lon_reach(F.col("p_lat"), plan.max_distance_m, plan.cell)
        dxs = F.sequence(-reach, reach)
        cells = math.ceil(360 / plan.cell - 1e-9)  # columns meet again at 180 degrees
        around = lambda c: F.pmod(c, F.lit(cells).cast("long"))
    else:
        dy, dxs = 1, F.array(*[F.lit(x) for x in (-1, 0, 1)])
    spread = (
        pois.where("p_lat is not null and p_lon is not null")
        .withColumn("dy", F.explode(F.array(*[F.lit(y) for y in range(-dy, dy + 1)])))
        .withColumn("dx", F.explode(dxs))
        .withColumn("cy", lat0 + F.col("dy"))
        .withColumn("cx", around(lon0 + F.col("dx")))
    )
    placed = records.where("r_lat is not null and r_lon is not null").withColumn("cy", geo.cell(F.col("r_lat"), plan.cell)).withColumn("cx", around(geo.cell(F.col("r_lon"), plan.cell)))
    distance = geo.haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("r_lat"), F.col("r_lon"))
    return spread.join(placed, ["cy", "cx"]).withColumn("distance_m", distance).where(F.col("distance_m") <= plan.max_distance_m).drop("cy", "cx")


def address_score(p_number: Column, p_street: Column, r_number: Column, r_street: Column, r_kind: Column) -> Column:
    """1 when number and street agree, 0.6 for the street alone."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s", ""))
    number = F.coalesce((bare(p_number) == bare(r_number)) & (p_number != "") & (r_number != ""), F.lit(False))
    street = text.same_street(p_street, r_street, r_kind)
    return F.when(number & street, 1.0).when(street, 0.6).otherwise(0.0)


def score_pairs(pairs: DataFrame, plan: MatchPlan = MatchPlan()) -> DataFrame:
    """Add ``s_name, s_brand, s_address, matched_name, proximity, identity, score`` to candidate pairs.

    Needs ``p_forms`` and ``p_brand_forms`` (name forms), ``r_names`` as array of ``(name, forms)`` and
    ``r_trading`` as array of forms arrays, all built once per row before the join.
    """
    scored_names = F.transform(
        "r_names", lambda r: F.struct(text.forms_similarity(F.col("p_forms"), r["forms"]).alias("score"), r["name"].alias("name"))
    )
    best = F.aggregate(
        scored_names,
        F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("name")),
        lambda acc, x: F.when(x["score"] > acc["score"], x).otherwise(acc),
    )
    brand = F.coalesce(F.array_max(F.transform("r_trading", lambda f: text.forms_similarity(F.col("p_brand_forms"), f))), F.lit(0.0))
    # scores are the costly part: pairs are spread over tasks first, and the generator is a barrier that keeps the
    # optimizer from copying the similarity expressions into each of their uses
    address = address_score(F.col("p_number"), F.col("p_street"), F.col("r_number"), F.col("r_street"), F.col("r_kind"))
    once = F.struct(best.alias("best"), brand.alias("s_brand"), address.alias("s_address"))
    keep = [c for c in pairs.columns if c not in ("p_forms", "p_brand_forms", "r_names", "r_trading")]
    out = pairs.repartition("poi_id", "rec_key").select(*keep, F.inline(F.array(once))).select(
        *keep, F.col("best.score").alias("s_name"), F.col("best.name").alias("matched_name"), "s_brand", "s_address"
    )
    supported = (F.col("s_name") >= 0.4) | (F.col("s_brand") >= 0.4)
    by_address = F.when(F.col("s_address") == 1, F.when(supported, 0.9).otherwise(0.6)).otherwise(F.col("s_address") * 0.5)
    return (
        out.withColumn("identity", F.greatest("s_name", "s_brand", by_address))
        .where(F.col("identity") >= plan.min_identity)
        .withColumn("proximity", 1 - F.least(F.lit(1.0), F.col("distance_m") / plan.max_distance_m))
        .withColumn("score", 0.8 * F.col("identity") + 0.2 * F.col("proximity"))
        .where(F.col("score") >= plan.low)
    )


def band(score: Column, plan: MatchPlan = MatchPlan()) -> Column:
    return F.when(score >= plan.high, "merge").when(score >= plan.low, "undecided").otherwise("distinct")


def carried_by() -> Column:
    return (
        F.when((F.col("s_address") >= 1) & (F.col("s_name") < 0.5) & (F.col("s_brand") < 0.5), "address")
        .when(F.col("s_brand") > F.col("s_name"), "enseigne")
        .otherwise("name")
    )


LARGE_COMPONENT = 100_000


def assign_one_to_one(spark: SparkSession, pairs: DataFrame, order: list[Column], large: int = LARGE_COMPONENT) -> DataFrame:
    """Greedy one-to-one assignment in a strict total order, given by values that sort ascending. ``pairs`` has ``poi_id`` and
    ``rec_key``, both strings.

    Pairs that share no side, not even through others, do not affect each other, so every connected component is taken
    greedily by itself, in one task and in order. Components above ``large`` pairs go in rounds of mutual best pairs instead: the
    pairs that are first for both their sides are those that greedy takes next. Both ways give the same pairs."""
    ordered = _cut(spark, pairs.withColumn("__o", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])))
    labels = _components(spark, ordered)
    sized = ordered.join(labels, "poi_id")
    sized = _cut(spark, sized)
    big = F.broadcast(_cut(spark, sized.groupBy("component").count().where(F.col("count") > large).select("component")))  # at most one in ``large`` pairs
    small = sized.join(big, "component", "left_anti")
    taken = small.repartition("component").sortWithinPartitions("component", "__o").select("component", "poi_id", "rec_key").mapInPandas(_greedy, "poi_id string, rec_key string")
    chosen = _cut(spark, taken)
    first = ordered.join(chosen, ["poi_id", "rec_key"], "left_semi")
    rest = sized.join(big, "component", "left_semi").select(*ordered.columns)
    return (first if rest.isEmpty() else first.unionByName(_mutual_best(spark, rest))).select(*pairs.columns)


def _components(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """``(poi_id, component)``: the smallest record reachable. Labels go from records to POIs and back until none changes; each
    round halves the way of most labels by reading them through the record they name."""
    edges = pairs.select("poi_id", "rec_key").distinct()
    label = _cut(spark, edges.groupBy("rec_key").agg(F.min("rec_key").alias("component")))
    while True:
        by_poi = edges.join(label, "rec_key").groupBy("poi_id").agg(F.min("component").alias("component"))
        new = edges.join(by_poi, "poi_id").groupBy("rec_key").agg(F.min("component").alias("component"))
        ahead = new.select(F.col("rec_key").alias("component"), F.col("component").alias("ahead"))
        new = _cut(spark, new.join(ahead, "component", "left").select("rec_key", F.least("component", F.coalesce("ahead", "component")).alias("component")))
        if new.join(label.withColumnRenamed("component", "old"), "rec_key").where("component <> old").isEmpty():
            return edges.join(new, "rec_key").groupBy("poi_id").agg(F.min("component").alias("component"))
        label = new


def _greedy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by component and in order; what a component has taken is forgotten with it."""
    component, pois, records = None, set(), set()
    for f in frames:
        taken = []
        for c, p, r in zip(f["component"], f["poi_id"], f["rec_key"], strict=True):
            if c != component:
                component, pois, records = c, set(), set()
            if p not in pois and r not in records:
                pois.add(p)
                records.add(r)
                taken.append((p, r))
        if taken:
            yield pd.DataFrame(taken, columns=["poi_id", "rec_key"])


def _mutual_best(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    rest = _cut(spark, pairs)
    taken: DataFrame | None = None
    while True:
        ranked = rest.withColumn("rp", F.row_number().over(W.partitionBy("poi_id").orderBy("__o"))).withColumn("rr", F.row_number().over(W.partitionBy("rec_key").orderBy("__o")))
        ranked = _cut(spark, ranked)
        mutual = ranked.where("rp = 1 and rr = 1").drop("rp", "rr")
        if mutual.isEmpty():
            return rest if taken is None else taken
        taken = mutual if taken is None else taken.unionByName(mutual)
        rest = _cut(
            spark,
            ranked.drop("rp", "rr").join(mutual.select("poi_id"), "poi_id", "left_anti").join(mutual.select("rec_key"), "rec_key", "left_anti").select(*pairs.columns),
        )


def pair_order() -> list[Column]:
    """Values that sort ascending: best score first; ties by POI, then by cell and record order."""
    return [-F.col("score"), F.col("poi_ord"), F.col("dy"), F.col("dx"), F.col("rec_ord")]


def match_lanes(spark: SparkSession, scored: DataFrame, plan: MatchPlan = MatchPlan()) -> tuple[DataFrame, DataFrame]:
    """(merges, undecided) of scored pairs. Undecided pairs are those of the middle band neither side of which merged."""
    scored = _cut(spark, scored)
    merges = assign_one_to_one(spark, scored.where(F.col("score") >= plan.high), pair_order()).withColumn("matched_by", carried_by())
    merges = _cut(spark, merges)
    undecided = (
        scored.where(F.col("score") < plan.high)
        .join(merges.select("poi_id"), "poi_id", "left_anti")
        .join(merges.select("rec_key"), "rec_key", "left_anti")
    )
    return merges, undecided


def candidate_row(undecided: DataFrame) -> DataFrame:
    """Undecided pairs as work-list rows, best first."""
    r4 = lambda c: F.round(F.col(c), 4).alias(c)
    return undecided.select(
        "poi_id", "rec_key", "p_name", "matched_name", r4("score"), r4("proximity"), r4("s_name"), r4("s_brand"), r4("s_address"),
        F.floor(F.col("distance_m") + 0.5).cast("long").alias("distance_m"),
    ).orderBy(F.col("score").desc(), "poi_id", "rec_key")


def prepare_pois(pois: DataFrame) -> DataFrame:
    """``(poi_id, poi_ord, name, brand, number, street, lat, lon)`` -> the match side with name forms."""
    return pois.select(
        "poi_id", "poi_ord", F.col("name").alias("p_name"), F.col("number").alias("p_number"), F.col("street").alias("p_street"), F.col("lat").alias("p_lat"),
        F.col("lon").alias("p_lon"), text.name_forms(F.coalesce("name", F.lit(""))).alias("p_forms"), text.name_forms(F.coalesce("brand", F.lit(""))).alias("p_brand_forms"),
    )


def prepare_records(records: DataFrame) -> DataFrame:
    """``(rec_key, rec_ord, names, trading, number, kind, street, lat, lon)`` -> the match side with name forms."""
    names = F.filter("names", lambda n: F.trim(n) != "")
    return records.select(
        "rec_key", "rec_ord", F.transform(names, lambda n: F.struct(n.alias("name"), text.name_forms(n).alias("forms"))).alias("r_names"),
        F.transform(F.coalesce("trading", F.array().cast("array<string>")), text.name_forms).alias("r_trading"), F.col("number").alias("r_number"), F.col("kind").alias("r_kind"),
        F.col("street").alias("r_street"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"),
    )


def resolve_entities(spark: SparkSession, pois: DataFrame, records: DataFrame, plan: MatchPlan = MatchPlan()) -> tuple[DataFrame, DataFrame]:
    pairs = spatial_candidates(prepare_pois(pois), prepare_records(records), plan)
    return match_lanes(spark, score_pairs(pairs, plan), plan)


def fuse(pois: DataFrame, records: DataFrame, merges: DataFrame) -> DataFrame:
    """Full outer fusion: every POI stays, a merged record joins it, the other records become places of their own. Of
    each address part the POI's value wins unless blank. ``places = pois + records - merged``."""
    links = merges.select("poi_id", F.col("rec_key").alias("m_key"), F.round("score", 3).alias("match_confidence"), "matched_by")
    r = records.select(*[F.col(c).alias(f"r__{c}") for c in records.columns])
    part = lambda c: text.first_text(F.col(c), F.col(f"r__{c}")).alias(c)
    left = pois.join(links, "poi_id", "left").join(r, F.col("m_key") == F.col("r__rec_key"), "left")
    merged = F.col("m_key").isNotNull()
    fused = left.select(
        F.concat(F.lit("osm:"), F.col("poi_id")).alias("place_id"),
        text.first_text(F.col("name"), F.get("r__names", F.lit(0))).alias("name"),
        F.when(merged, F.array(F.lit("osm"), F.lit("registry"))).otherwise(F.array(F.lit("osm"))).alias("sources"),
        "match_confidence", "matched_by", F.col("m_key").alias("rec_key"), part("number"), part("street"),
        F.coalesce("lat", "r__lat").alias("lat"), F.coalesce("lon", "r__lon").alias("lon"),
    )
    alone = records.join(links.select(F.col("m_key").alias("rec_key")), "rec_key", "left_anti").select(
        F.col("rec_key").alias("place_id"), F.get("names", F.lit(0)).alias("name"), F.array(F.lit("registry")).alias("sources"), "rec_key", "number", "street", "lat", "lon"
    )
    return fused.unionByName(alone, allowMissingColumns=True)


def fold_verdicts(places: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply ``verdicts(place_id, rec_key, merge, why)``; returns (places, outcome per verdict).

    A key names a record exactly, or by a suffix after ``:`` that only one record has. A merge joins the
    register-only place into the POI place with confidence 1 and drops the absorbed row. Of several verdicts on one
    POI or one record the first by key order applies, so the result stays one to one; unknown ids are reported.
    """
    alone = places.where("array_contains(sources, 'registry') and not array_contains(sources, 'osm')")
    keys = alone.select(F.col("rec_key").alias("full_key"), F.col("rec_key").alias("key")).unionByName(
        alone.select(F.col("rec_key").alias("full_key"), F.substring_index("rec_key", ":", -1).alias("key")).where("key <> full_key")
    )
    unique = keys.groupBy("key").agg(F.min("full_key").alias("full_key"), F.countDistinct("full_key").alias("n")).where("n = 1").drop("n")
    osm = places.where("array_contains(sources, 'osm') and rec_key is null").select(F.col("place_id").alias("o_id"))
    known = (
        verdicts.join(unique, verdicts.rec_key == unique.key, "left")
        .join(osm, F.col("place_id") == F.col("o_id"), "left")
        .withColumn("known", F.col("full_key").isNotNull() & F.col("o_id").isNotNull())
    )
    go = F.col("known") & F.col("merge")
    turn = F.struct(*(["ord"] if "ord" in verdicts.columns else []), F.col("place_id").alias("p"), F.col("rec_key").alias("k"))
    asked = known.where(go).groupBy(F.col("place_id").alias("poi_id"), F.col("full_key").alias("t_key")).agg(F.min(turn).alias("turn"))
    taken = assign_one_to_one(places.sparkSession, asked.withColumnRenamed("t_key", "rec_key"), [F.col("turn")])
    taken = taken.select(F.col("poi_id").alias("place_id"), F.col("rec_key").alias("full_key"), F.col("turn.k").alias("t_key"))
    judged = known.join(taken, ["place_id", "full_key"], "left")
    judged = judged.withColumn(
        "outcome",
        F.when(~F.col("known"), "unknown").when(~F.col("merge"), "kept apart").when(F.col("t_key").eqNullSafe(F.col("rec_key")), "merged").otherwise("rejected"),
    )
    merged = taken.select("place_id", F.col("full_key").alias("new_key"))
    gone = merged.select(F.col("new_key").alias("rec_key"))
    kept = places.join(gone.withColumn("absorbed", F.lit(True)), "rec_key", "left").where("absorbed is null or array_contains(sources, 'osm')").drop("absorbed")
    out = kept.join(merged, "place_id", "left")
    hit = F.col("new_key").isNotNull()
    out = out.select(
        *[
            F.when(hit, F.col("new_key")).otherwise(F.col("rec_key")).alias("rec_key") if c == "rec_key"
            else F.when(hit, F.array(F.lit("osm"), F.lit("registry"))).otherwise(F.col("sources")).alias("sources") if c == "sources"
            else F.when(hit, F.lit(1.0)).otherwise(F.col(c)).alias(c) if c == "match_confidence"
            else F.when(hit, F.lit("verdict")).otherwise(F.col(c)).alias(c) if c == "matched_by"
            else F.col(c)
            for c in places.columns
        ]
    )
    return out, judged.select("place_id", "rec_key", "merge", "outcome")
