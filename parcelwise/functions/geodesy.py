"""Points between datums, and lengths, azimuths and areas on the ellipsoid. Column functions.

A datum family tells its ellipsoid and its shift to SIRGAS 2000 (three parameters, good to some metres; SIRGAS 2000 and WGS 84 are taken as one). An unknown family gives null.
Iterations are folds of a fixed number of steps, so they stay inside the plan's expressions. Latitudes and longitudes are in degrees.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelwise.functions.angles import normalize_azimuth
from parcelwise.functions.crs import K0, central_meridian
from parcelwise.functions.let import let

#: Semi-major axis, inverse flattening, and shift to SIRGAS 2000 along the geocentric axes, in metres.
FAMILIES = {
    "SIRGAS2000": (6378137.0, 298.257222101, 0.0, 0.0, 0.0),
    "WGS84": (6378137.0, 298.257223563, 0.0, 0.0, 0.0),
    "SAD69": (6378160.0, 298.25, -67.35, 3.88, -38.22),
    "CORREGO_ALEGRE": (6378388.0, 297.0, -206.05, 168.28, -3.82),
}
#: Steps of the fold from geocentric to geodetic (each gains two digits and a half), and of Vincenty's (each gains three, near antipodes fewer).
GEODETIC_STEPS, INVERSE_STEPS = 8, 24
#: Longitudes on the auxiliary sphere that still move by more than this after the last step have no answer.
INVERSE_EPS = 1e-12


def _series(f: float) -> dict[str, float]:
    """Series in the third flattening (to its fourth power) of the transverse Mercator projection: radius, to the sphere and back (a, b), and from conformal latitude (d)."""
    n = f / (2 - f)
    return {
        "radius": (1 + n**2 / 4 + n**4 / 64) / (1 + n),
        "a1": n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, "a2": 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, "a3": 61 * n**3 / 240 - 103 * n**4 / 140, "a4": 49561 * n**4 / 161280,
        "b1": n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, "b2": n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, "b3": 17 * n**3 / 480 - 37 * n**4 / 840, "b4": 4397 * n**4 / 161280,
        "d1": 2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, "d2": 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, "d3": 56 * n**3 / 15 - 136 * n**4 / 35, "d4": 4279 * n**4 / 630,
    }


def ellipsoid(family: Column) -> Column:
    """struct of what the functions below need of a family: a, f, e2, dx, dy, dz and the projection's series; null for an unknown one."""
    entries = []
    for name, (a, inverse, dx, dy, dz) in FAMILIES.items():
        f = 1 / inverse
        values = {"a": a, "f": f, "e2": f * (2 - f), "dx": dx, "dy": dy, "dz": dz} | _series(f)
        entries += [F.lit(name), F.struct(*[F.lit(v).alias(k) for k, v in values.items()])]
    return F.create_map(*entries)[family]


def geocentric(longitude: Column, latitude: Column, height: Column, shape: Column) -> Column:
    """struct<x, y, z> in metres."""
    phi, lam = F.radians(latitude), F.radians(longitude)
    return let(
        F.struct(F.sin(phi).alias("s"), F.cos(phi).alias("c"), (shape["a"] / F.sqrt(1 - shape["e2"] * F.sin(phi) * F.sin(phi))).alias("n")),
        lambda t: F.struct(((t["n"] + height) * t["c"] * F.cos(lam)).alias("x"), ((t["n"] + height) * t["c"] * F.sin(lam)).alias("y"), ((t["n"] * (1 - shape["e2"]) + height) * t["s"]).alias("z")),
    )


def geodetic(point: Column, shape: Column) -> Column:
    """struct<longitude, latitude, height> of a geocentric point, by a fixed-point fold on the latitude."""
    p, z, e2, a = F.hypot(point["x"], point["y"]), point["z"], shape["e2"], shape["a"]
    first = F.atan2(z, p * (1 - e2))
    step = lambda phi, _: F.atan2(z + e2 * a * F.sin(phi) / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi)), p)
    # height along the normal: no division by a cosine that vanishes at the poles
    height = lambda phi: p * F.cos(phi) + z * F.sin(phi) - a * F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    return let(
        F.aggregate(F.sequence(F.lit(1), F.lit(GEODETIC_STEPS)), first, step),
        lambda phi: F.struct(F.degrees(F.atan2(point["y"], point["x"])).alias("longitude"), F.degrees(phi).alias("latitude"), height(phi).alias("height")),
    )


def shifted(longitude: Column, latitude: Column, source: Column, target: Column, height: Column | float = 0.0) -> Column:
    """struct<longitude, latitude, height> of a point of the datum family source in the family target, by way of SIRGAS 2000."""
    height = F.lit(height) if isinstance(height, float) else height
    both = F.struct(ellipsoid(source).alias("s"), ellipsoid(target).alias("t"))

    def move(b: Column) -> Column:
        moved = lambda g: F.struct(*[(g[k] + b["s"][f"d{k}"] - b["t"][f"d{k}"]).alias(k) for k in "xyz"])
        return F.when(b["s"].isNotNull() & b["t"].isNotNull(), let(let(geocentric(longitude, latitude, height, b["s"]), moved), lambda g: geodetic(g, b["t"])))

    return F.when(source == target, F.struct(longitude.cast("double").alias("longitude"), latitude.cast("double").alias("latitude"), height.cast("double").alias("height"))).otherwise(let(both, move))


def unprojected(easting: Column, northing: Column, zone: Column, hemisphere: Column, family: Column) -> Column:
    """struct<longitude, latitude> of UTM coordinates on the family's own ellipsoid."""

    def inverse(s: Column) -> Column:
        r = s["a"] * s["radius"] * K0
        plane = F.struct(((northing - F.when(hemisphere == "S", 1e7).otherwise(0.0)) / r).alias("xi"), ((easting - 500000) / r).alias("eta"))

        def sphere(t: Column) -> Column:
            xi, eta = t["xi"], t["eta"]
            for j in (1, 2, 3, 4):
                xi = xi - s[f"b{j}"] * F.sin(2 * j * t["xi"]) * F.cosh(2 * j * t["eta"])
                eta = eta - s[f"b{j}"] * F.cos(2 * j * t["xi"]) * F.sinh(2 * j * t["eta"])
            return F.struct(xi.alias("xi"), eta.alias("eta"))

        def place(t: Column) -> Column:
            chi = F.asin(F.sin(t["xi"]) / F.cosh(t["eta"]))
            latitude = let(chi, lambda x: x + s["d1"] * F.sin(2 * x) + s["d2"] * F.sin(4 * x) + s["d3"] * F.sin(6 * x) + s["d4"] * F.sin(8 * x))
            return F.struct((central_meridian(zone) + F.degrees(F.atan2(F.sinh(t["eta"]), F.cos(t["xi"])))).alias("longitude"), F.degrees(latitude).alias("latitude"))

        return F.when(s.isNotNull(), let(let(plane, sphere), place))

    return let(ellipsoid(family), inverse)


def projected(longitude: Column, latitude: Column, zone: Column, hemisphere: Column, family: Column) -> Column:
    """struct<easting, northing> in the UTM zone, on the family's own ellipsoid."""

    def forward(s: Column) -> Column:
        phi, lam = F.radians(latitude), F.radians(longitude - central_meridian(zone))
        e = F.sqrt(s["e2"])
        conformal = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))

        def plane(tau: Column) -> Column:
            return F.struct(F.atan2(tau, F.cos(lam)).alias("xi"), F.asinh(F.sin(lam) / F.hypot(tau, F.cos(lam))).alias("eta"))

        def place(t: Column) -> Column:
            xi, eta = t["xi"], t["eta"]
            for j in (1, 2, 3, 4):
                xi = xi + s[f"a{j}"] * F.sin(2 * j * t["xi"]) * F.cosh(2 * j * t["eta"])
                eta = eta + s[f"a{j}"] * F.cos(2 * j * t["xi"]) * F.sinh(2 * j * t["eta"])
            r = s["a"] * s["radius"] * K0
            return F.struct((500000 + r * eta).alias("easting"), (F.when(hemisphere == "S", 1e7).otherwise(0.0) + r * xi).alias("northing"))

        return F.when(s.isNotNull(), let(let(conformal, plane), place))

    return let(ellipsoid(family), forward)


def transformed(x: Column, y: Column, source: tuple[Column, Column, Column], target: tuple[Column, Column, Column]) -> Column:
    """struct<x, y> between reference systems given as (family, zone, hemisphere): eastings and northings where the zone is known, longitudes and latitudes where it is null."""
    family, zone, hemisphere = source
    to_family, to_zone, to_hemisphere = target
    plain = F.struct(x.cast("double").alias("longitude"), y.cast("double").alias("latitude"))
    place = F.when(zone.isNull(), plain).otherwise(unprojected(x, y, zone, hemisphere, family))
    moved = let(place, lambda p: shifted(p["longitude"], p["latitude"], family, to_family))

    def out(p: Column) -> Column:
        at = projected(p["longitude"], p["latitude"], to_zone, to_hemisphere, to_family)
        return F.when(to_zone.isNull(), F.struct(p["longitude"].alias("x"), p["latitude"].alias("y"))).otherwise(F.struct(at["easting"].alias("x"), at["northing"].alias("y")))

    return let(moved, out)


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column, family: Column | str = "SIRGAS2000") -> Column:
    """struct<distance, azimuth, back_azimuth>: the shortest way on the ellipsoid by Vincenty's inverse, as a fold on the longitude of the auxiliary sphere.

    back_azimuth points from the second point to the first. Equal points have distance 0 and azimuths 0 and 180. Points so near to antipodes that the fold does not settle give null.
    """
    shape = ellipsoid(F.lit(family) if isinstance(family, str) else family)

    def solve(s: Column) -> Column:
        reduced = lambda lat: F.atan((1 - s["f"]) * F.tan(F.radians(lat)))
        start = F.struct(F.radians(F.pmod(lon2 - lon1 + 540, F.lit(360.0)) - 180).alias("l"), reduced(lat1).alias("u1"), reduced(lat2).alias("u2"))

        def terms(t: Column, lam: Column) -> Column:
            """What the step and the result share at a longitude lam."""
            s1, c1, s2, c2 = F.sin(t["u1"]), F.cos(t["u1"]), F.sin(t["u2"]), F.cos(t["u2"])
            across = F.hypot(c2 * F.sin(lam), c1 * s2 - s1 * c2 * F.cos(lam))
            along = s1 * s2 + c1 * c2 * F.cos(lam)
            base = F.struct(across.alias("sin"), along.alias("cos"), F.atan2(across, along).alias("sigma"), F.when(across > 0, c1 * c2 * F.sin(lam) / across).otherwise(0.0).alias("alpha"), (s1 * s2).alias("ss"))
            more = lambda b: F.struct(b["sin"].alias("sin"), b["cos"].alias("cos"), b["sigma"].alias("sigma"), b["alpha"].alias("alpha"), (1 - b["alpha"] * b["alpha"]).alias("q"), F.when(b["alpha"] * b["alpha"] < 1, b["cos"] - 2 * b["ss"] / (1 - b["alpha"] * b["alpha"])).otherwise(0.0).alias("m"))
            return let(base, more)

        def step(t: Column, lam: Column) -> Column:
            def next_(b: Column) -> Column:
                c = s["f"] / 16 * b["q"] * (4 + s["f"] * (4 - 3 * b["q"]))
                return t["l"] + (1 - c) * s["f"] * b["alpha"] * (b["sigma"] + c * b["sin"] * (b["m"] + c * b["cos"] * (2 * b["m"] * b["m"] - 1)))

            return let(terms(t, lam), next_)

        def result(t: Column, lam: Column, moved: Column) -> Column:
            def measure(b: Column) -> Column:
                u = b["q"] * s["e2"] / (1 - s["e2"])
                big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
                small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
                m, k = b["m"], b["sin"]
                change = small * k * (m + small / 4 * (b["cos"] * (2 * m * m - 1) - small / 6 * m * (4 * k * k - 3) * (4 * m * m - 3)))
                s1, c1, s2, c2 = F.sin(t["u1"]), F.cos(t["u1"]), F.sin(t["u2"]), F.cos(t["u2"])
                ahead = F.degrees(F.atan2(c2 * F.sin(lam), c1 * s2 - s1 * c2 * F.cos(lam)))
                back = F.degrees(F.atan2(c1 * F.sin(lam), c1 * s2 * F.cos(lam) - s1 * c2)) + 180
                return F.struct((s["a"] * (1 - s["f"]) * big * (b["sigma"] - change)).alias("distance"), normalize_azimuth(ahead).alias("azimuth"), normalize_azimuth(back).alias("back_azimuth"))

            return F.when(moved <= INVERSE_EPS, let(terms(t, lam), measure))

        def fold(t: Column) -> Column:
            # a longitude that no longer moves gives itself: the steps that are left are passed over
            on = lambda x: let(step(t, x["lam"]), lambda y: F.struct(y.alias("lam"), F.abs(y - x["lam"]).alias("moved")))
            state = F.aggregate(F.sequence(F.lit(1), F.lit(INVERSE_STEPS)), F.struct(t["l"].alias("lam"), F.lit(1.0).alias("moved")), lambda x, _: F.when(x["moved"] == 0, x).otherwise(on(x)))
            return let(state, lambda x: result(t, x["lam"], x["moved"]))

        return F.when(s.isNotNull(), let(start, fold))

    return let(shape, solve)


def authalic(latitude: Column, shape: Column) -> Column:
    """The latitude, in radians, on the sphere of equal area."""
    e, x = F.sqrt(shape["e2"]), F.sin(F.radians(latitude))
    q = lambda y: (1 - shape["e2"]) * (y / (1 - shape["e2"] * y * y) + F.atanh(e * y) / e)
    return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q(x) / q(F.lit(1.0)))))


def excess(lon1: Column, beta1: Column, lon2: Column, beta2: Column) -> Column:
    """Signed spherical excess between a side and the equator (authalic latitudes in radians, longitudes in degrees)."""
    t1, t2, half = F.tan(beta1 / 2), F.tan(beta2 / 2), F.radians(F.pmod(lon2 - lon1 + 540, F.lit(360.0)) - 180) / 2
    return 2 * F.atan2(F.tan(half) * (t1 + t2), 1 + t1 * t2)


def authalic_radius2(shape: Column) -> Column:
    """Square of the radius of the sphere of equal area."""
    e = F.sqrt(shape["e2"])
    return shape["a"] * shape["a"] / 2 * (1 + (1 - shape["e2"]) / e * F.atanh(e))
