import random

import pytest
from pyspark.sql import functions as F

from placeloom.operators import areas
from placeloom.sources import poi

SCHEMA = "area_id string, rings array<array<struct<lon:double,lat:double>>>, box struct<south:double,north:double,west:double,east:double>"


def unwrapped(ring):
    out = [ring[0]]
    for lon, lat in ring[1:]:
        while lon - out[-1][0] >= 180:
            lon -= 360
        while lon - out[-1][0] < -180:
            lon += 360
        out.append((lon, lat))
    return out


def holds(rings, lat, lon):
    for turn in (-360, 0, 360):
        n = 0
        for ring in map(unwrapped, rings):
            for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1], strict=True):
                n += (ya > lat) != (yb > lat) and lon + turn < (xb - xa) * (lat - ya) / (yb - ya) + xa
        if n % 2:
            return True
    return False


def star(g, lon, lat, size, corners):
    import math

    ring = []
    for k in range(corners):
        r = size * g.uniform(0.3, 1)
        ring.append((lon + r * math.cos(2 * math.pi * k / corners), lat + r * math.sin(2 * math.pi * k / corners)))
    return [((x + 180) % 360 - 180, y) for x, y in ring]


@pytest.fixture(scope="module")
def shapes():
    g = random.Random(6)
    out = {f"s{i}": [star(g, g.uniform(-180, 180), g.uniform(-40, 40), g.choice([0.01, 0.4, 3, 25]), g.randint(3, 60))] for i in range(14)}
    out["dateline"] = [star(g, 179.6, 5, 4, 40), star(g, 180, 5, 0.8, 12)]
    out["hole"] = [star(g, 10, 10, 6, 300), star(g, 10, 10, 1, 9)]
    out["box"] = [[(2.0, 3.0), (4.0, 3.0), (4.0, 5.0), (2.0, 5.0)]]
    out["two parts"] = [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], [(5.0, 5.0), (6.5, 5.25), (5.0, 6.0)]]
    return out


@pytest.mark.parametrize("levels, few, coarsest", [(8, 4, 1.0), (0, 4, 8.0), (5, 0, 4.0)])
def test_points_in_areas(spark, shapes, levels, few, coarsest):
    g = random.Random(7)
    points = [(i, g.uniform(-60, 60), g.uniform(-180, 180)) for i in range(400)]
    for rings in shapes.values():
        for lon, lat in rings[0][:20]:
            points += [(len(points) + k, lat + g.gauss(0, 0.3), ((lon + g.gauss(0, 0.3) + 180) % 360) - 180) for k in range(3)]
    points += [(10_000 + i, lat, lon) for i, (lat, lon) in enumerate([(3.0, 2.0), (3.0, 4.0), (5.0, 2.0), (4.0, 3.0), (3.5, 2.0), (0.0, 180.0), (0.0, -180.0), (5.0, 180.0), (5.0, -180.0)])]
    df = spark.createDataFrame([*points, (-1, None, 3.0), (-2, 3.0, None)], "id int, lat double, lon double")
    a = spark.createDataFrame([(k, [[{"lon": x, "lat": y} for x, y in r] for r in rings], None) for k, rings in shapes.items()], SCHEMA)
    rows = areas.points_in_areas(spark, df, a, levels, few, coarsest).select("area_id", "id").collect()
    want = {(k, i) for k, rings in shapes.items() for i, lat, lon in points if holds(rings, lat, lon)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) > 100


def test_cells_follow_the_border(spark, shapes):
    """One more level doubles the border cells, not the covering of the inside; the join is on cells."""
    a = spark.createDataFrame([("hole", [[{"lon": x, "lat": y} for x, y in r] for r in shapes["hole"]], None)], SCHEMA)
    border = [areas.covering(spark, a, levels, 0).where("edges IS NOT NULL").count() for levels in (3, 4, 5)]
    assert 1.5 < border[2] / border[1] < 2.7 and 1.5 < border[1] / border[0] < 2.7
    assert areas.covering(spark, a, 5, 0).where("edges IS NULL AND level < 3").count() > 10
    assert areas.covering(spark, a, 6, 0).select(F.max(F.size("edges"))).first()[0] < 120
    plan = areas.points_in_areas(spark, spark.range(5).selectExpr("id", "1D AS lat", "1D AS lon"), a)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_areas_without_outline_have_their_box(spark):
    rows = [("a", None, (1.0, 2.0, 179.0, -179.0)), ("b", [], (-10.0, 10.0, -180.0, 180.0)), ("c", None, None), ("d", [[]], None)]
    a = spark.createDataFrame(rows, SCHEMA)
    e = spark.createDataFrame([(1, 1.5, 179.5, None), (2, None, None, (1.5, -179.5)), (3, 1.5, 0.0, None), (4, 50.0, 0.0, None)], "id long, lat double, lon double, center struct<lat:double,lon:double>")
    got = {(r["area_id"], r["id"]) for r in poi.within_areas(spark, e, a).collect()}
    assert got == {("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3)}
    assert poi.within_areas(spark, e, a.limit(0)).count() == 0 and poi.within_areas(spark, e.limit(0), a).count() == 0
