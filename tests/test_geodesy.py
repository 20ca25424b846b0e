import math

import pytest
from pyspark.sql import functions as F

from parcelwise.functions import crs, geodesy
from parcelwise.operators import rings


def deg(d, m, s):
    return math.copysign(abs(d) + m / 60 + s / 3600, d)


def test_published_pair_of_points(spark):
    """Flinders Peak to Buninyong on GRS80, as geodetic agencies print it."""
    p = spark.createDataFrame([(deg(144, 25, 29.52440), deg(-37, 57, 3.72030), deg(143, 55, 35.38390), deg(-37, 39, 10.15610))], "a double, b double, c double, d double")
    r = p.select(geodesy.geodesic(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("g")).select("g.*").first()
    assert abs(r.distance - 54972.271) < 0.001
    assert abs(r.azimuth - deg(306, 52, 5.37)) * 3600 < 0.01 and abs(r.back_azimuth - deg(127, 10, 25.07)) * 3600 < 0.01


def test_ways_along_meridian_and_equator(spark):
    rows = [(0.0, 0.0, 1.0, 0.0), (0.0, -90.0, 0.0, 90.0), (5.0, 5.0, 5.0, 5.0), (0.0, 0.0, 179.9, 0.1), (179.0, 0.0, -179.0, 0.0), (None, 0.0, 1.0, 1.0)]
    got = [r.g for r in spark.createDataFrame(rows, "a double, b double, c double, d double").coalesce(1).select(geodesy.geodesic(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("g")).collect()]
    assert abs(got[0].distance - 6378137.0 * math.radians(1)) < 1e-3 and abs(got[0].azimuth - 90) < 1e-9
    assert abs(got[1].distance - 2 * 10001965.729) < 1e-2
    assert (got[2].distance, got[2].azimuth, got[2].back_azimuth) == (0.0, 0.0, 180.0)
    assert got[3] is None or got[3].distance is None
    assert abs(got[4].distance - 6378137.0 * math.radians(2)) < 1e-3
    assert got[5] is None or got[5].distance is None


@pytest.mark.parametrize("family", ["SAD69", "CORREGO_ALEGRE", "WGS84"])
def test_shift_and_back(spark, family):
    rows = [(-46.63, -23.55), (-74.0, 5.9), (-34.8, -7.1), (-60.0, 0.0), (0.0, 90.0), (10.0, -90.0)]
    p = spark.createDataFrame(rows, "lon double, lat double")
    there = p.withColumn("t", geodesy.shifted(F.col("lon"), F.col("lat"), F.lit(family), F.lit("SIRGAS2000")))
    back = there.withColumn("b", geodesy.shifted(F.col("t.longitude"), F.col("t.latitude"), F.lit("SIRGAS2000"), F.lit(family), F.col("t.height"))).collect()
    for r in back[:4]:
        assert math.hypot((r.b.longitude - r.lon) * math.cos(math.radians(r.lat)), r.b.latitude - r.lat) * 111_320 < 1e-3 and abs(r.b.height) < 1e-3
        moved = math.hypot((r.t.longitude - r.lon) * math.cos(math.radians(r.lat)), r.t.latitude - r.lat) * 111_320
        assert family == "WGS84" and moved < 0.001 or 20 < moved < 300
    if family == "SAD69":
        moved = math.hypot((back[0].t.longitude + 46.63) * math.cos(math.radians(23.55)), back[0].t.latitude + 23.55) * 111_320
        assert 20 < moved < 100
    assert all(abs(abs(r.b.latitude) - 90) < 1e-7 for r in back[4:])


def test_projection_and_its_inverse(spark):
    rows = [(333000.0, 7394000.0, 23, "S"), (166022.0, 9000000.0, 22, "S"), (500000.0, 100000.0, 20, "N"), (833000.0, 5500000.0, 18, "S")]
    p = spark.createDataFrame(rows, "e double, n double, zone int, h string")
    for family in geodesy.FAMILIES:
        g = p.withColumn("g", geodesy.unprojected(F.col("e"), F.col("n"), F.col("zone"), F.col("h"), F.lit(family)))
        for r in g.select("*", geodesy.projected(F.col("g.longitude"), F.col("g.latitude"), F.col("zone"), F.col("h"), F.lit(family)).alias("p"), crs.geographic(F.col("e"), F.col("n"), F.col("zone"), F.col("h")).alias("c")).collect():
            assert abs(r.p.easting - r.e) < 1e-5 and abs(r.p.northing - r.n) < 1e-5
            assert family != "SIRGAS2000" or (abs(r.g.longitude - r.c.longitude) < 1e-8 and abs(r.g.latitude - r.c.latitude) < 1e-8)


def test_transformation_between_systems(spark):
    p = spark.createDataFrame([(333000.0, 7394000.0, "SAD69", 23, "S", "SIRGAS2000", 23, "S"), (-46.63, -23.55, "SIRGAS2000", None, None, "SIRGAS2000", 23, "S"), (333000.0, 7394000.0, "SAD69", 23, "S", "SAD69", 23, "S"), (1.0, 2.0, "none", None, None, "WGS84", None, None), (333000.0, 7394000.0, "SAD69", 23, "S", "SIRGAS2000", None, None)], "x double, y double, f string, z int, h string, tf string, tz int, th string")
    got = [r.t for r in p.coalesce(1).select(geodesy.transformed(F.col("x"), F.col("y"), (F.col("f"), F.col("z"), F.col("h")), (F.col("tf"), F.col("tz"), F.col("th"))).alias("t")).collect()]
    assert 20 < math.hypot(got[0].x - 333000, got[0].y - 7394000) < 100
    assert 300_000 < got[1].x < 400_000 and 7_390_000 < got[1].y < 7_400_000
    assert abs(got[2].x - 333000) < 1e-4 and abs(got[2].y - 7394000) < 1e-4
    assert got[3] is None or got[3].x is None
    assert -47 < got[4].x < -46 and -24 < got[4].y < -23


def test_area_on_the_ellipsoid(spark):
    ring = [(500000.0, 7394000.0), (501000.0, 7394000.0), (501000.0, 7394800.0), (500000.0, 7394900.0)]
    v = spark.createDataFrame([(1, i, e, n) for i, (e, n) in enumerate(ring)] + [(2, 0, 500000.0, 7394000.0), (2, 1, 500100.0, 7394000.0)], "k int, idx int, e double, n double")
    placed = v.select("k", "idx", geodesy.unprojected(F.col("e"), F.col("n"), F.lit(23), F.lit("S"), F.lit("SIRGAS2000")).alias("g")).select("k", "idx", "g.*")
    got = {r.k: r for r in rings.geodesic_metrics(placed, ["k"]).collect()}
    assert abs(got[1].ground_area / (850_000 / crs.K0**2) - 1) < 1e-6 and got[2].ground_area == 0.0 and got[2].vertices == 2
    assert abs(got[2].ground_perimeter - 200 / crs.K0) < 0.001
