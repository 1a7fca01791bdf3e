"""Partitioned acquisition: split ladders under a result cap, quad tiles and shared row budgets, as plans over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from placeloom.functions import geo
from placeloom.operators.cut import cut

CAP = 10_000


def split_ladder(rows: DataFrame, section: Column, division: Column, cap: int = CAP) -> DataFrame:
    """``(level, section, division, n, truncated)``: the whole if below the cap, else its sections, else their divisions;
    a division still at the cap is declared truncated. One grouping-sets pass counts all levels."""
    g = rows.select(section.alias("section"), division.alias("division"))
    counts = g.groupingSets([[], [F.col("section")], [F.col("section"), F.col("division")]], "section", "division").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    counts = counts.withColumn("level", F.when(F.col("gid") == 3, "whole").when(F.col("gid") == 1, "section").otherwise("division")).drop("gid")
    total = counts.where("level = 'whole'").select(F.col("n").alias("total"))
    per_section = counts.where("level = 'section'").select(F.col("section").alias("s"), F.col("n").alias("section_n"))
    j = counts.join(F.broadcast(total), F.lit(True)).join(per_section, F.col("section").eqNullSafe(F.col("s")) & (F.col("level") == "division"), "left")
    used = (
        ((F.col("level") == "whole") & (F.col("total") < cap))
        | ((F.col("level") == "section") & (F.col("total") >= cap) & (F.col("n") < cap))
        | ((F.col("level") == "division") & (F.col("total") >= cap) & (F.col("section_n") >= cap))
    )
    return j.where(used).select("level", "section", "division", F.least(F.col("n"), F.lit(cap)).cast("long").alias("n"), (F.col("n") >= cap).alias("truncated"))


def quad_tiles(spark: SparkSession, bbox: tuple[float, float, float, float], points: DataFrame, cap: int, depth: int = 3, stride: int = 4) -> DataFrame:
    """Leaf tiles of a quad tree over ``points(lat, lon)``: a tile above the cap is quartered, to the given depth (31 at most); a leaf
    still above it is incomplete.

    A point's place is one number, two bits a level (Morton code), found by halving as the tiles are; points are read once and
    collapse to counts of the finest codes. Then ``stride`` levels at a time are counted, and only below tiles that are still above the cap, so
    the work after the first aggregation follows the crowded places and not the depth."""
    south, north, west, east = map(float, bbox)
    inside = points.where((F.col("lat") >= south) & (F.col("lat") < north) & (F.col("lon") >= west) & (F.col("lon") < east))
    finest = cut(spark, inside.select(_morton(F.col("lat"), F.col("lon"), bbox, depth).alias("code")).groupBy("code").agg(F.count("*").alias("n")))
    up = lambda c, level: F.expr(f"shiftrightunsigned({c}, cast(2 * ({depth} - {level}) AS int))")
    open_, level = finest, 0
    counts = finest.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("tile"), "n")
    counts = cut(spark, counts)
    crowded = counts.where(F.col("n") > cap)
    while level < depth and not crowded.isEmpty():
        lower = min(level + stride, depth)
        # finest codes below tiles that are still above the cap, counted at the next levels; a tile's parent has its first bits
        open_ = open_.join(crowded.select(F.col("tile").alias("__t")), up("code", level) == F.col("__t"), "left_semi")
        each = open_.select("n", "code", F.explode(F.array(*[F.lit(k) for k in range(level + 1, lower + 1)])).alias("level"))
        new = cut(spark, each.groupBy("level", up("code", "level").alias("tile")).agg(F.sum("n").alias("n")))
        counts, level = counts.unionByName(new), lower
        crowded = new.where((F.col("level") == level) & (F.col("n") > cap))
    split = counts.where((F.col("n") > cap) & (F.col("level") < depth))
    children = split.select((F.col("level") + 1).alias("level"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda q: F.col("tile") * 4 + q)).alias("tile"))
    tiles = children.unionByName(counts.where("level = 0").select("level", "tile")).join(counts, ["level", "tile"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    leaves = tiles.where((F.col("n") <= cap) | (F.col("level") == depth))
    path = F.when(F.col("level") == 0, "").otherwise(F.lpad(F.conv(F.col("tile").cast("string"), 10, 4), F.col("level"), F.lit("0")))
    leaves = leaves.withColumn("path", path)
    box = _box(F.col("path"), bbox, depth)
    return leaves.select("level", "path", *[box[k].alias(k) for k in ("south", "north", "west", "east")], "n", (F.col("n") > cap).alias("incomplete"))


def _morton(lat: Column, lon: Column, bbox, depth: int) -> Column:
    """Two bits a level: quadrants 0 south-west, 1 south-east, 2 north-west, 3 north-east."""
    south, north, west, east = (F.lit(float(x)) for x in bbox)
    start = F.struct(south.alias("s"), north.alias("n"), west.alias("w"), east.alias("e"), F.lit(0).cast("long").alias("code"))

    def halve(b: Column, _) -> Column:
        lat_mid, lon_mid = (b["s"] + b["n"]) / 2, (b["w"] + b["e"]) / 2
        up, right = lat >= lat_mid, lon >= lon_mid
        return F.struct(
            F.when(up, lat_mid).otherwise(b["s"]).alias("s"), F.when(up, b["n"]).otherwise(lat_mid).alias("n"), F.when(right, lon_mid).otherwise(b["w"]).alias("w"), F.when(right, b["e"]).otherwise(lon_mid).alias("e"),
            (b["code"] * 4 + F.when(up, 2).otherwise(0) + F.when(right, 1).otherwise(0)).cast("long").alias("code"),
        )

    return F.aggregate(F.slice(F.array_repeat(F.lit(0), max(depth, 1)), 1, depth), start, halve, lambda b: b["code"])


def _box(path: Column, bbox, depth: int) -> Column:
    south, north, west, east = (F.lit(float(x)) for x in bbox)
    start = F.struct(south.alias("south"), north.alias("north"), west.alias("west"), east.alias("east"))

    def halve(b: Column, q: Column) -> Column:
        lat, lon, digit = (b["south"] + b["north"]) / 2, (b["west"] + b["east"]) / 2, q.cast("int")
        up, right = digit >= 2, digit % 2 == 1
        return F.struct(
            F.when(up, lat).otherwise(b["south"]).alias("south"), F.when(up, b["north"]).otherwise(lat).alias("north"),
            F.when(right, lon).otherwise(b["west"]).alias("west"), F.when(right, b["east"]).otherwise(lon).alias("east"),
        )

    return F.aggregate(F.filter(F.split(path, ""), lambda q: q != ""), start, halve)


def budgeted(rows: DataFrame, lane: str, order: list[Column], budget: int, splitters: int = 16, small: int = 100_000) -> DataFrame:
    """The first rows of an ordered budget shared by all lanes, with a mark on lanes that were cut.

    ``order`` are ascending columns, blanks first (negate numbers that fall); rows that tie go by lane. No row is sorted or shuffled: the row at
    the budget is found by counting rows between ``splitters`` that a random draw gives, again inside the interval that holds it, until that
    has at most ``small`` rows or the row has a splitter's key. Counts are exact, so the draw decides only how many passes it takes."""
    names = [f"o{k}" for k in range(len(order) + 1)]
    keyed = rows.select(F.col(lane).alias("lane"), F.struct(*[c.alias(n) for c, n in zip([*order, F.col(lane)], names, strict=True)]).alias("k"))
    kinds = [f.dataType for f in keyed.schema["k"].dataType.fields]
    fixed = lambda r: F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(r, kinds, names, strict=True)])
    total = keyed.count()
    last, need, inside, left = None, budget, F.lit(True), total
    while 0 < budget < total:
        held = keyed.where(inside)
        if left <= small:
            sums = held.groupBy("k").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(W.orderBy("k")))  # at most ``small`` rows
            last, upto, n = sums.where(F.col("upto") >= need).orderBy("k").select("k", "upto", "n").first()
            need -= upto - n
            break
        drawn = [tuple(r["k"]) for r in held.select("k").orderBy(F.rand(7)).limit(32 * splitters).distinct().orderBy("k").collect()]
        marks = drawn[len(drawn) // (2 * splitters) :: max(1, len(drawn) // splitters)]
        ends = [fixed(m) for m in marks]

        def below(lo: int, hi: int) -> Column:  # how many splitters are less than the key, by halving
            mid = (lo + hi) // 2
            return F.lit(lo) if lo == hi else F.when(F.col("k") <= ends[mid], below(lo, mid)).otherwise(below(mid + 1, hi))

        placed = held.select("k", below(0, len(ends)).alias("below"))
        placed = placed.select("below", F.get(F.array(*ends), F.col("below")).eqNullSafe(F.col("k")).alias("on"))
        counts = {(r["below"], r["on"]): r["count"] for r in placed.groupBy("below", "on").count().collect()}
        for at in range(len(marks) + 1):
            left = counts.get((at, False), 0)  # rows between splitters at - 1 and at
            if need <= left:
                break
            need -= left
            if need <= (on := counts.get((at, True), 0)):
                last = marks[at]
                break
            need -= on
        if last is not None:
            break
        if at:
            inside = inside & (F.col("k") > fixed(marks[at - 1]))
        if at < len(marks):
            inside = inside & (F.col("k") < fixed(marks[at]))
    if budget <= 0:
        got = F.lit(0).cast("long")
    elif last is None:
        got = F.count("*")
    else:
        got = F.count_if(F.col("k") < fixed(last)) + F.when(F.col("lane").eqNullSafe(fixed(last)[names[-1]]), F.lit(need)).otherwise(F.lit(0))
    sums = keyed.groupBy("lane").agg(F.count("*").alias("requested"), got.cast("long").alias("returned"))
    return sums.select(F.col("lane").alias(lane), "requested", "returned", (F.col("returned") < F.col("requested")).alias("truncated"))


def rivals(candidates: DataFrame, ratio: float = 0.85, metres: float = 10_000.0) -> DataFrame:
    """Ambiguous geocoder answers: ``(query, ord, importance, lat, lon)`` of which a later one is nearly as important
    as the first (or the first has none) and more than ten kilometres away."""
    w = W.partitionBy("query").orderBy("ord")
    first = lambda c: F.first(c).over(w)
    far = geo.haversine_m(first("lat"), first("lon"), F.col("lat"), F.col("lon")) > metres
    near_equal = (first("importance") == 0) | (F.col("importance") / first("importance") >= ratio)
    return candidates.withColumn("rival", (F.row_number().over(w) > 1) & near_equal & far).where("rival").drop("rival")
