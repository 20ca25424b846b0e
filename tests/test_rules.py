"""One injected defect each; whatever else a rule says fails the test."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from parcelwise.operators import rings, rules

LOT = [(612340.25, 7801215.5), (612391.75, 7801198.0), (612420.0, 7801260.25), (612377.5, 7801301.0), (612329.0, 7801266.75), (612352.5, 7801241.0)]


def shoelace(points):
    """Twice the signed area, in exact fractions."""
    p = [(Fraction(e), Fraction(n)) for e, n in points]
    return sum(p[k][0] * p[(k + 1) % len(p)][1] - p[(k + 1) % len(p)][0] * p[k][1] for k in range(len(p)))


AREA = float(abs(shoelace(LOT)) / 2)
PERIMETER = sum(math.dist(LOT[k], LOT[(k + 1) % len(LOT)]) for k in range(len(LOT)))
ANGLES = (len(LOT) - 2) * 180.0


def ring(spark, points):
    return spark.createDataFrame([(1, k, float(e), float(n)) for k, (e, n) in enumerate(points)], "pair long, idx int, e double, n double")


@pytest.mark.parametrize("points", [LOT, LOT[::-1], LOT[3:] + LOT[:3]])
def test_area_and_perimeter_against_exact_sums(spark, points):
    m = rings.ring_metrics(ring(spark, points), ["pair"]).first()
    assert m.vertices == len(LOT) and m.area == AREA and abs(m.perimeter - PERIMETER) < 1e-9 and m.ccw == (shoelace(points) > 0)


def test_fewer_than_three_vertices_have_no_area(spark):
    one, two = (rings.ring_metrics(ring(spark, LOT[:k]), ["pair"]).first() for k in (1, 2))
    assert (one.area, one.perimeter, two.area) == (0.0, 0.0, 0.0) and abs(two.perimeter - 2 * math.dist(*LOT[:2])) < 1e-9


@pytest.mark.parametrize("points", [LOT, LOT[::-1], LOT[:3], LOT[1:5]])
def test_angles_sum_up_and_coordinates_close(spark, points):
    angles = rings.interior_angles(ring(spark, points), ["pair"])
    assert abs(angles.agg(F.sum("interior_angle")).first()[0] - (len(points) - 2) * 180) < 1e-7
    sides = rings.sides(ring(spark, points), ["pair"]).select("pair", "idx", "azimuth", F.col("length").alias("distance"), F.lit(0.005).alias("halfwidth"))
    assert rings.closure(sides, ["pair"]).first().error < 1e-7


def declared(spark, distance=0.0, azimuth=0.0):
    rows = rings.sides(ring(spark, LOT), ["pair"])
    return rows.withColumns({
        "role": F.lit("A"),
        "distance": F.col("length") + F.when(F.col("idx") == 4, distance).otherwise(0.0),
        "declared_azimuth": F.col("azimuth") + F.when(F.col("idx") == 3, azimuth).otherwise(0.0),
        "distance_hw": F.lit(0.005),
        "azimuth_hw": F.lit(0.00005),
    })


@pytest.mark.parametrize("distance,azimuth,want", [(0.0, 0.0, []), (0.37, 0.0, [("R6", "4")]), (0.0, -0.012, [("R7", "3")]), (0.0048, 0.00003, []), (-2.1, 0.9, [("R7", "3"), ("R6", "4")])])
def test_declared_sides(spark, distance, azimuth, want):
    assert [(r.rule, r.subject) for r in rules.declared_sides(declared(spark, distance, azimuth)).collect()] == want


def totals(spark, **values):
    row = {"pair": 1, "role": "A", "declared_area": AREA, "area_hw": 0.05, "area": AREA, "declared_perimeter": PERIMETER, "perimeter_hw": 0.05, "perimeter": PERIMETER, "vertices": len(LOT), "angle_sum": ANGLES} | values
    return spark.createDataFrame([row], "pair long, role string, declared_area double, area_hw double, area double, declared_perimeter double, perimeter_hw double, perimeter double, vertices int, angle_sum double")


@pytest.mark.parametrize("values,want", [({}, []), ({"declared_area": AREA - 31.0}, ["R8"]), ({"declared_perimeter": PERIMETER + 0.7}, ["R9"]), ({"declared_perimeter": PERIMETER + 0.29}, []), ({"angle_sum": ANGLES - 0.004}, ["R10"]), ({"declared_area": None}, [])])
def test_declared_totals(spark, values, want):
    assert [r.rule for r in rules.declared_totals(totals(spark, **values)).collect()] == want


@pytest.mark.parametrize("a,b,want", [("EPSG:31980", "EPSG:31980", []), (None, "EPSG:31981", [("R1", "A")]), ("EPSG:32722", "EPSG:22523", [("R2", "AB")]), (None, None, [("R1", "A"), ("R1", "B")])])
def test_reference_systems(spark, a, b, want):
    parcels = spark.createDataFrame([(1, a, b)], "pair long, epsg_a string, epsg_b string")
    assert [(r.rule, r.scope) for r in rules.reference_systems(parcels).collect()] == want


@pytest.mark.parametrize("angle,wrong_chord,wrong_arc,want", [(71.5, 0, 0, []), (71.5, 0.2, 0, ["R4"]), (71.5, 0, -1.1, ["R5"]), (140.0, 0.9, 0.4, ["R4", "R5"]), (None, 0.9, 0.4, ["R3"])])
@pytest.mark.parametrize("radius", [15.0, 48.25])
def test_arcs(spark, radius, angle, wrong_chord, wrong_arc, want):
    turn = math.radians(angle or 30.0)
    row = (1, "A", 0, radius, 0.005, radius * turn + wrong_arc, 0.005, angle, 2 * radius * math.sin(turn / 2) + wrong_chord)
    rows = spark.createDataFrame([row, (2, "A", 0, None, None, None, None, None, 9.0)], "pair long, role string, idx int, radius double, radius_hw double, development double, development_hw double, central_angle double, length double")
    assert [r.rule for r in rules.arcs(rows).collect()] == want


@pytest.mark.parametrize("cause,want", [(None, {("R17", "inter_document", "error")}), ("translation", {("R17", "systematic", "info")})])
def test_one_cause_softens_coordinates(spark, cause, want):
    points = spark.createDataFrame([(1, 0, 2, 31.0, 12.0, 31.0, 12.75, cause), (1, 1, 3, 55.5, 64.0, 55.5, 64.0, cause)], "pair long, idx_a int, idx_b int, ea double, na double, eb double, nb double, cause string").withColumns({"hw_a": F.lit(0.0005), "hw_b": F.lit(None).cast("double")})
    found = rules.coordinates(points).collect()
    assert {(r.rule, r.kind, r.severity) for r in found} == want and [(r.field, r.subject, r.delta) for r in found] == [("northing", "0", 0.75)]


def test_tax_ids(spark):
    one, two, firm = "39053344705", "52998224725", "11444777000161"
    rows = [(1, "A", one, 1.0, 0), (1, "B", one, 1.0, 0), (2, "A", one, 1.0, 0), (2, "A", two, 0.9, 0), (2, "A", two, 0.55, 1), (2, "B", firm, 1.0, 0)]
    found = rules.tax_ids_between(spark.createDataFrame(rows, "pair long, role string, digits string, confidence double, ordinal int")).collect()
    want = [(1, "R26", "tax_id", "tax ids", "AB"), (2, "R27", "cnpj", "11.444.777/0001-61", "B"), (2, "R27", "cpf", "390.533.447-05", "A"), (2, "R27", "cpf", "529.982.247-25", "A"), (2, "R28", "cpf", "529.982.247-25", "A")]
    assert sorted((r.pair, r.rule, r.field, r.subject, r.scope) for r in found) == want


def test_low_confidence_is_silent_after_an_edit(spark):
    rows = [(1, "A", "latitude", "0", 5.0, 0.62, False), (1, "A", "easting", "1", 6.0, 0.62, True), (1, "B", "area", "area", 7.0, 0.41, False), (1, "B", "area", "area", 8.0, 0.8, False)]
    found = rules.low_confidence(spark.createDataFrame(rows, "pair long, role string, field string, subject string, value double, confidence double, edited boolean")).collect()
    assert sorted((r.rule, r.subject, r.scope, r.value_a) for r in found) == [("R32", "0", "A", 5.0), ("R33", "area", "B", 7.0)]


def test_summary_is_zero_filled(spark):
    found = rules.declared_totals(totals(spark, declared_area=1.0))
    got = {r.pair: r for r in rules.summary(found, spark.createDataFrame([(1,), (2,)], "pair long")).collect()}
    r = got[1]
    assert (r.total, r.error_count, r.warning_count, r.internal_count, r.data_gap_count, r.status) == (1, 1, 0, 1, 0, "compared")
    assert set(got[2]) == {2, 0, "compared"}
