"""Points in areas: polygons are covered by square cells, coarse inside and fine along the border, and joined on the cell.

A point in an interior cell needs no test. A cell on the border carries the few edges that a ray from inside it to the right can
meet, and its points are tested by counting crossings (even-odd, so holes are rings like any other). Rings may run across 180 degrees;
they may not go round a pole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.operators.cut import cut

COARSEST = 1.0  # degrees; halves are exact


def area_edges(areas: DataFrame) -> DataFrame:
    """``areas(area_id, rings array<array<struct<lon,lat>>>, ...)`` -> ``(area_id, edges)``. Rings are closed here if they are not; longitudes go on
    beyond 180 where the shorter way from one corner to the next does. An area without rings has the corners of its ``box`` (south, north,
    west, east), if there is such a column."""
    rings = F.col("rings")
    if "box" in areas.columns:
        west, wide = F.col("box.west"), F.col("box.east") - F.col("box.west") + F.when(F.col("box.east") < F.col("box.west"), 360.0).otherwise(0.0)
        corner = lambda k, lat: F.struct((west + wide * k / 3).alias("lon"), F.col(lat).cast("double").alias("lat"))
        box = F.array(F.array(*[corner(k, "box.south") for k in range(4)], *[corner(3 - k, "box.north") for k in range(4)]))  # thirds, since the shorter way counts
        rings = F.when((F.coalesce(F.size(rings), F.lit(0)) < 1) & F.col("box").isNotNull(), box).otherwise(rings)
    ring = areas.select("area_id", F.posexplode(rings).alias("ring", "corners")).where(F.size("corners") >= 3)
    corner = ring.select("area_id", "ring", F.posexplode("corners").alias("i", "c")).select("area_id", "ring", "i", F.col("c.lon").alias("lon"), F.col("c.lat").alias("lat"))
    turn = W.partitionBy("area_id", "ring").orderBy("i")
    step = F.col("lon") - F.lag("lon").over(turn)
    laid = corner.withColumn("jump", F.coalesce(F.floor((step + 180) / 360), F.lit(0)))  # whole turns, so that longitudes keep all digits
    laid = laid.withColumn("x", F.col("lon") - 360.0 * F.sum("jump").over(turn)).drop("jump")
    whole = W.partitionBy("area_id", "ring").orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    follows = lambda c: F.coalesce(F.lead(c).over(turn), F.first(c).over(whole))
    edges = laid.select("area_id", F.struct(F.col("x").alias("xa"), F.col("lat").alias("ya"), follows("x").alias("xb"), follows("lat").alias("yb")).alias("e"))
    return edges.groupBy("area_id").agg(F.collect_list("e").alias("edges"))


def crossings_odd(x: Column, y: Column, edges: Column) -> Column:
    """Whether a ray to the right meets the edges an odd number of times; a corner belongs to the edge that leaves it upwards."""
    hit = lambda e: ((e["ya"] > y) != (e["yb"] > y)) & (x < (e["xb"] - e["xa"]) * (y - e["ya"]) / (e["yb"] - e["ya"]) + e["xa"])
    return F.size(F.filter(edges, hit)) % 2 == 1


def _touches(e: Column, x0: Column, y0: Column, size: float) -> Column:
    """An edge meets a closed cell: their boxes do, and the cell's corners are not all on one side of the edge's line."""
    x1, y1 = x0 + size, y0 + size
    near = (F.least(e["xa"], e["xb"]) <= x1) & (F.greatest(e["xa"], e["xb"]) >= x0) & (F.least(e["ya"], e["yb"]) <= y1) & (F.greatest(e["ya"], e["yb"]) >= y0)
    side = lambda x, y: (e["xb"] - e["xa"]) * (y - e["ya"]) - (e["yb"] - e["ya"]) * (x - e["xa"])
    sides = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
    return near & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def covering(spark: SparkSession, areas: DataFrame, levels: int = 8, few: int = 4, coarsest: float = COARSEST) -> DataFrame:
    """``(area_id, level, cx, cy, edges)``: cells that cover every area without overlap, in halves of ``coarsest``; ``edges`` is null inside, else what a
    ray from the cell to the right can meet. A border cell is cut in four until few edges touch it or the last level is reached;
    only border cells go on, so the work follows the border's length."""
    whole = cut(spark, area_edges(areas))
    least = lambda a, b: F.array_min(F.transform("edges", lambda e: F.least(e[a], e[b])))
    most = lambda a, b: F.array_max(F.transform("edges", lambda e: F.greatest(e[a], e[b])))
    cell = lambda c: F.floor(c / coarsest)
    open_ = whole.withColumn("cx", F.explode(F.sequence(cell(least("xa", "xb")), cell(most("xa", "xb"))))).withColumn("cy", F.explode(F.sequence(cell(least("ya", "yb")), cell(most("ya", "yb")))))
    done = None
    for level in range(levels + 1):
        size = coarsest / 2**level
        x0, y0 = F.col("cx") * size, F.col("cy") * size
        strip = F.filter("edges", lambda e: (F.greatest(e["ya"], e["yb"]) >= y0) & (F.least(e["ya"], e["yb"]) <= y0 + size) & (F.greatest(e["xa"], e["xb"]) >= x0))
        here = open_.select("area_id", "cx", "cy", strip.alias("edges")).withColumn("touching", F.size(F.filter("edges", lambda e: _touches(e, x0, y0, size))))
        here = here.where((F.col("touching") > 0) | crossings_odd(x0 + size / 2, y0 + size / 2, F.col("edges")))
        here = cut(spark, here)
        last = F.lit(level == levels) | (F.col("touching") <= few)
        kept = here.where(last).select("area_id", F.lit(level).alias("level"), "cx", "cy", F.when(F.col("touching") > 0, F.col("edges")).alias("edges"))
        done = kept if done is None else done.unionByName(kept)
        open_ = here.where(~last).select("area_id", "edges", "cx", "cy", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k"))
        open_ = open_.select("area_id", "edges", (F.col("cx") * 2 + F.col("k") % 2).alias("cx"), (F.col("cy") * 2 + F.floor(F.col("k") / 2)).alias("cy"))
        if level < levels and here.where(~last).isEmpty():
            break
    return done


def points_in_areas(spark: SparkSession, points: DataFrame, areas: DataFrame, levels: int = 8, few: int = 4, coarsest: float = COARSEST) -> DataFrame:
    """``points(lat, lon, ...)`` with ``area_id``, a row for every area of ``areas(area_id, rings[, box])`` that a point lies in. Points without
    coordinates lie in none. An equi-join on cells; only points of border cells are tested, against that cell's edges."""
    cells = cut(spark, covering(spark, areas, levels, few, coarsest))
    deep = [r["level"] for r in cells.select("level").distinct().collect()]
    if not deep:
        return points.limit(0).withColumn("area_id", F.lit(None).cast(areas.schema["area_id"].dataType))
    size = F.lit(coarsest) / F.pow(F.lit(2.0), F.col("__level"))
    around = F.round(F.lit(360.0) / size).cast("long")
    keyed = cells.select("area_id", F.col("level").alias("__level"), F.col("cx").alias("__cx"), F.col("cy").alias("__y"), F.col("edges").alias("__edges")).withColumn("__x", F.pmod(F.col("__cx"), around))
    placed = points.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("__level", F.explode(F.array(*[F.lit(k) for k in deep])))
    placed = placed.withColumn("__x", F.pmod(F.floor(F.col("lon") / size), around)).withColumn("__y", F.floor(F.col("lat") / size))
    met = placed.join(keyed, ["__level", "__x", "__y"])
    turns = F.round(((F.col("__cx") + 0.5) * size - F.col("lon")) / 360)
    return met.where(F.col("__edges").isNull() | crossings_odd(F.col("lon") + 360 * turns, F.col("lat"), F.col("__edges"))).select(*points.columns, "area_id")
