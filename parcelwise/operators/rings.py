"""Rings: closed polygons as ordered vertex rows (parcel, idx, e, n). Sides, angles, area, perimeter, closure.

Every operator partitions by the ring's key only, so one shuffle serves them all. Areas are taken about the ring's
first vertex: terms of the plain shoelace at UTM magnitude lose more than the comparison threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.functions.geodesy import authalic, authalic_radius2, ellipsoid, excess, geodesic


def _window(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("idx")


def _whole(keys: list[str]) -> Window:
    return _window(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def following(column: str, keys: list[str]) -> Column:
    """The next vertex's value; the first one's after the last."""
    return F.coalesce(F.lead(column).over(_window(keys)), F.first(column).over(_whole(keys)))


def preceding(column: str, keys: list[str]) -> Column:
    return F.coalesce(F.lag(column).over(_window(keys)), F.last(column).over(_whole(keys)))


def distance(de: Column, dn: Column) -> Column:
    """By the square root, whose result every engine rounds alike; that of hypot is another double in one of 25 sides."""
    return F.sqrt(de * de + dn * dn)


def azimuth(de: Column, dn: Column) -> Column:
    """In [0, 360). The turn is added whatever the sign, as in SQL: pmod adds it below zero only, which gives another double in two of five sides."""
    return (F.degrees(F.atan2(de, dn)) % 360.0 + 360.0) % 360.0


def sides(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """vertices with next_e, next_n, and the length and azimuth of the side that leaves each."""
    out = vertices.withColumns({"next_e": following("e", keys), "next_n": following("n", keys)})
    de, dn = F.col("next_e") - F.col("e"), F.col("next_n") - F.col("n")
    return out.withColumns({"length": distance(de, dn), "azimuth": azimuth(de, dn)})


def ring_metrics(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """keys, vertices, area, perimeter, ccw, centroid_e, centroid_n of each ring. Fewer than three vertices have no area."""
    whole = _whole(keys)
    s = sides(vertices, keys).withColumns({"e0": F.first("e").over(whole), "n0": F.first("n").over(whole)})
    cross = (F.col("e") - F.col("e0")) * (F.col("next_n") - F.col("n0")) - (F.col("next_e") - F.col("e0")) * (F.col("n") - F.col("n0"))
    grouped = s.withColumn("cross", cross).groupBy(*keys).agg(F.count(F.lit(1)).alias("vertices"), (F.sum("cross") / 2).alias("signed"), F.sum("length").alias("length"), F.avg("e").alias("centroid_e"), F.avg("n").alias("centroid_n"))
    signed = F.when(F.col("vertices") >= 3, F.col("signed")).otherwise(0.0)
    return grouped.select(*keys, "vertices", F.abs(signed).alias("area"), F.when(F.col("vertices") >= 2, F.col("length")).otherwise(0.0).alias("perimeter"), (signed > 0).alias("ccw"), "centroid_e", "centroid_n")


def interior_angles(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """vertices with interior_angle, on the side that the ring's orientation tells."""
    whole = _whole(keys)
    s = sides(vertices, keys).withColumns({"e0": F.first("e").over(whole), "n0": F.first("n").over(whole), "prev_e": preceding("e", keys), "prev_n": preceding("n", keys)})
    cross = (F.col("e") - F.col("e0")) * (F.col("next_n") - F.col("n0")) - (F.col("next_e") - F.col("e0")) * (F.col("n") - F.col("n0"))
    s = s.withColumn("signed", F.sum(cross).over(Window.partitionBy(*keys)))
    back = azimuth(F.col("prev_e") - F.col("e"), F.col("prev_n") - F.col("n"))
    turn = F.when(F.col("signed") > 0, F.col("azimuth") - back).otherwise(back - F.col("azimuth"))
    return s.withColumn("interior_angle", F.pmod(turn, F.lit(360.0))).drop("e0", "n0", "prev_e", "prev_n", "signed")


def traverse(declared: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of idx, azimuth, distance with the position reached after each, from a start at (0, 0)."""
    running = _window(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rad = F.radians("azimuth")
    return declared.withColumns({"de": F.sum(F.col("distance") * F.sin(rad)).over(running), "dn": F.sum(F.col("distance") * F.cos(rad)).over(running)})


def closure(declared: DataFrame, keys: list[str]) -> DataFrame:
    """keys, de, dn, error, total, precision (X of 1:X, infinite under a micrometre) and budget, where every side has azimuth and distance.

    budget is the sum of positive half-widths of the distances, or the noise threshold without any.
    """
    rad, d = F.radians("azimuth"), F.col("distance")
    grouped = declared.groupBy(*keys).agg(
        F.sum(d * F.sin(rad)).alias("de"),
        F.sum(d * F.cos(rad)).alias("dn"),
        F.sum("distance").alias("total"),
        F.count(F.lit(1)).alias("sides"),
        F.count(F.when(F.col("azimuth").isNotNull() & d.isNotNull(), 1)).alias("complete"),
        F.sum(F.when(F.col("halfwidth") > 0, F.col("halfwidth"))).alias("widths"),
    )
    error = F.hypot("de", "dn")
    return grouped.filter("sides = complete").select(*keys, "de", "dn", error.alias("error"), "total", F.when(error < 1e-6, F.lit(float("inf"))).otherwise(F.col("total") / error).alias("precision"), F.coalesce("widths", F.lit(1e-4)).alias("budget"))


def arc_chord(radius: Column, central_angle: Column) -> Column:
    return 2 * radius * F.sin(F.radians(central_angle) / 2)


def arc_development(radius: Column, central_angle: Column) -> Column:
    return radius * F.radians(central_angle)


def geodesic_metrics(vertices: DataFrame, keys: list[str], family: str = "SIRGAS2000") -> DataFrame:
    """keys, vertices, ground_area, ground_perimeter of rings of longitude and latitude, on the ellipsoid.

    Sides are geodesics; for the area they are great circles of the sphere of equal area, which differ from these by less than a square millimetre a kilometre of side.
    Differences are taken from the ring's first vertex, so that small rings lose no digits. Fewer than three vertices have no area.
    """
    shape = ellipsoid(F.lit(family))
    r = vertices.withColumn("beta", authalic(F.col("latitude"), shape))
    r = r.withColumns({f"next_{c}": following(c, keys) for c in ("longitude", "latitude", "beta")})
    side = geodesic(F.col("longitude"), F.col("latitude"), F.col("next_longitude"), F.col("next_latitude"), family)["distance"]
    found = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("vertices"), F.abs(F.sum(excess(F.col("longitude"), F.col("beta"), F.col("next_longitude"), F.col("next_beta")))).alias("excess"), F.sum(side).alias("ground_perimeter"))
    return found.select(*keys, "vertices", F.when(F.col("vertices") >= 3, F.col("excess") * authalic_radius2(shape)).otherwise(0.0).alias("ground_area"), "ground_perimeter")
