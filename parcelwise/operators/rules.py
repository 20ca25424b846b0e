"""Comparison rules: each turns prepared rows into findings of one schema; findings() unites them.

A finding is pair, rule, kind, severity, field, subject, scope, value_a, value_b, delta, tolerance. Values of text are in
text_a, text_b. Rules that read the same rows are made in one pass, as an array of structs that is exploded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.functions.angles import angular_difference
from parcelwise.functions.let import exploded
from parcelwise.functions.numbers import ANGLE_EPS, LINEAR_EPS, exceeds, quantum
from parcelwise.functions.text import mask_tax_id
from parcelwise.operators.rings import arc_chord, arc_development

#: Below it, a value that nobody has edited is to be reviewed.
LOW_CONFIDENCE = 0.80
SEVERITIES, KINDS = ["error", "warning", "info"], ["systematic", "data_gap", "structural", "inter_document", "internal", "low_confidence"]


def finding(rule: str, kind: str | Column, severity: str | Column, field: str | Column, subject: Column, scope: str | Column = "AB", a: Column | None = None, b: Column | None = None, delta: Column | None = None, tolerance: Column | None = None, text_a: Column | None = None, text_b: Column | None = None) -> Column:
    """The struct of one finding."""
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    number = lambda x: (F.lit(None) if x is None else x).cast("double")
    text = lambda x: (F.lit(None) if x is None else x).cast("string")
    return F.struct(F.lit(rule).alias("rule"), col(kind).alias("kind"), col(severity).alias("severity"), col(field).cast("string").alias("field"), subject.cast("string").alias("subject"), col(scope).alias("scope"), number(a).alias("value_a"), number(b).alias("value_b"), number(delta).alias("delta"), number(tolerance).alias("tolerance"), text(text_a).alias("text_a"), text(text_b).alias("text_b"))


def emit(rows: DataFrame, *checks: tuple[Column, Column], key: str = "pair") -> DataFrame:
    """A row for each (condition, finding) that holds."""
    found = F.filter(F.array(*[F.when(condition, value) for condition, value in checks]), lambda x: x.isNotNull())
    return exploded(rows, [key], found, "f").select(key, "f.*")


def reference_systems(parcels: DataFrame) -> DataFrame:
    """R1, R2 from rows of pair, epsg_a, epsg_b."""
    return emit(
        parcels,
        (F.col("epsg_a").isNull(), finding("R1", "data_gap", "error", "datum", F.lit("A"), "A")),
        (F.col("epsg_b").isNull(), finding("R1", "data_gap", "error", "datum", F.lit("B"), "B")),
        (F.col("epsg_a") != F.col("epsg_b"), finding("R2", "inter_document", "warning", "datum", F.lit("datum"), text_a=F.col("epsg_a"), text_b=F.col("epsg_b"))),
    )


def arcs(segments: DataFrame) -> DataFrame:
    """R3, R4, R5 from rows of pair, role, idx, radius, radius_hw, development, development_hw, central_angle, length (between vertices)."""
    chord, arc = arc_chord(F.col("radius"), F.col("central_angle")), arc_development(F.col("radius"), F.col("central_angle"))
    subject, curved = F.col("idx"), F.col("radius").isNotNull()
    return emit(
        segments,
        (curved & F.col("central_angle").isNull(), finding("R3", "structural", "info", "distance", subject, F.col("role"))),
        (curved & exceeds(F.col("length") - chord, quantum(F.col("radius_hw"))), finding("R4", "internal", "warning", "distance", subject, F.col("role"), F.col("length"), chord, F.col("length") - chord, quantum(F.col("radius_hw")))),
        (curved & exceeds(F.col("development") - arc, quantum(F.col("development_hw"))), finding("R5", "internal", "warning", "distance", subject, F.col("role"), F.col("development"), arc, F.col("development") - arc, quantum(F.col("development_hw")))),
    )


def declared_sides(segments: DataFrame) -> DataFrame:
    """R6, R7 from rows of pair, role, idx, distance, distance_hw, declared_azimuth, azimuth_hw, length, azimuth."""
    d, z = F.col("distance") - F.col("length"), angular_difference(F.col("declared_azimuth"), F.col("azimuth"))
    td, tz = quantum(F.col("distance_hw")), quantum(F.col("azimuth_hw"), eps=ANGLE_EPS)
    return emit(
        segments,
        (exceeds(d, td), finding("R6", "internal", "warning", "distance", F.col("idx"), F.col("role"), F.col("distance"), F.col("length"), d, td)),
        (exceeds(z, tz), finding("R7", "internal", "warning", "azimuth", F.col("idx"), F.col("role"), F.col("declared_azimuth"), F.col("azimuth"), z, tz)),
    )


def declared_totals(parcels: DataFrame) -> DataFrame:
    """R8, R9, R10 from rows of pair, role, declared_area, area_hw, area, declared_perimeter, perimeter_hw, perimeter, vertices, angle_sum."""
    da, dp = F.col("declared_area") - F.col("area"), F.col("declared_perimeter") - F.col("perimeter")
    ta = quantum(F.col("area_hw"))
    tp = F.greatest(quantum(F.col("perimeter_hw")), F.col("vertices") * F.coalesce(F.when(F.col("perimeter_hw") > 0, F.col("perimeter_hw")), F.lit(LINEAR_EPS)))
    dz, tz = F.col("angle_sum") - (F.col("vertices") - 2) * 180.0, F.col("vertices") * ANGLE_EPS
    return emit(
        parcels,
        (exceeds(da, ta), finding("R8", "internal", "error", "area", F.col("role"), F.col("role"), F.col("declared_area"), F.col("area"), da, ta)),
        (exceeds(dp, tp), finding("R9", "internal", "warning", "perimeter", F.col("role"), F.col("role"), F.col("declared_perimeter"), F.col("perimeter"), dp, tp)),
        (exceeds(dz, tz), finding("R10", "internal", "warning", "interior_angle", F.col("role"), F.col("role"), F.col("angle_sum"), (F.col("vertices") - 2) * 180.0, dz, tz)),
    )


def closures(rows: DataFrame) -> DataFrame:
    """R11 (over the budget) or R12 from rows of pair, role, error, budget."""
    over = F.col("error") > F.col("budget")
    return emit(
        rows,
        (over, finding("R11", "internal", "error", "perimeter", F.col("role"), F.col("role"), delta=F.col("error"), tolerance=F.col("budget"))),
        (~over, finding("R12", "internal", "info", "perimeter", F.col("role"), F.col("role"), delta=F.col("error"), tolerance=F.col("budget"))),
    )


def vertex_counts(counts: DataFrame) -> DataFrame:
    """R14 from rows of pair, na, nb."""
    return emit(counts, (F.col("na") != F.col("nb"), finding("R14", "structural", "error", "vertex_code", F.lit("vertices"), a=F.col("na"), b=F.col("nb"), delta=F.col("nb") - F.col("na"))))


def without_partner(vertices: DataFrame, scope: str) -> DataFrame:
    """R15 from the unmatched vertices of one side."""
    return emit(vertices, (F.lit(True), finding("R15", "structural", "warning", "vertex_code", F.coalesce("code", F.concat(F.lit("#"), (F.col("idx") + 1).cast("string"))), scope)))


def one_cause(fits: DataFrame) -> DataFrame:
    """R16 from fits with kind."""
    size = F.when(F.col("kind") == "translation", F.col("shift")).when(F.col("kind") == "rotation", F.abs(F.col("rotation_deg"))).otherwise(F.abs(F.col("scale") - 1) * 1e6)
    return emit(fits, (F.col("kind").isNotNull(), finding("R16", "systematic", "error", "easting", F.col("kind"), delta=size)))


def coordinates(points: DataFrame, key: str = "pair", widths: tuple[str, str, str, str] = ("hw_a", "hw_b", "hw_a", "hw_b")) -> DataFrame:
    """R17 for E and for N of each matched vertex (with cause, of with_cause()); only informative where one cause explains the pair. widths: columns of the half-widths of E in A and B, and of N; they may be null."""
    kind, severity = F.when(F.col("cause").isNotNull(), "systematic").otherwise("inter_document"), F.when(F.col("cause").isNotNull(), "info").otherwise("error")
    of = {"easting": quantum(F.col(widths[0]), F.col(widths[1])), "northing": quantum(F.col(widths[2]), F.col(widths[3]))}
    checks = [(exceeds(F.col(b) - F.col(a), of[field]), finding("R17", kind, severity, field, F.col("idx_a"), "AB", F.col(a), F.col(b), F.col(b) - F.col(a), of[field])) for field, a, b in (("easting", "ea", "eb"), ("northing", "na", "nb"))]
    return emit(points, *checks, key=key)


def notes(rows: DataFrame, key: str = "pair") -> DataFrame:
    """R13 from rows of pair, note: what matching has to say of a pair."""
    return emit(rows, (F.col("note").isNotNull(), finding("R13", "structural", "info", F.lit(None), F.lit("match"), text_a=F.col("note"))), key=key)


def matched_sides(pairs: DataFrame, a: DataFrame, b: DataFrame, key: str = "pair", undirected: bool = False) -> DataFrame:
    """Sides of A with the side of B between the partners of their ends; columns of B carry the suffix _b.

    a, b: rows of key, from_idx, to_idx and values. Sides run in one direction; undirected also takes B's sides turned round.
    """
    to = lambda x, y: pairs.select(key, F.col("idx_a").alias(x), F.col("idx_b").alias(y))
    other = b.select(key, *[F.col(c).alias(f"{c}_b") for c in b.columns if c != key])
    if undirected:
        other = other.unionByName(other.withColumns({"from_idx_b": F.col("to_idx_b"), "to_idx_b": F.col("from_idx_b")}))
    return a.join(to("from_idx", "from_idx_b"), [key, "from_idx"]).join(to("to_idx", "to_idx_b"), [key, "to_idx"]).join(other, [key, "from_idx_b", "to_idx_b"])


def sides_between(rows: DataFrame) -> DataFrame:
    """R18 to R21 from matched sides with length, distance, distance_hw, declared_azimuth, azimuth_hw, neighbour and their twins in _b."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(F.col(c), "\\s+", " ")))
    length, d = F.col("length_b") - F.col("length"), F.col("distance_b") - F.col("distance")
    z = angular_difference(F.col("declared_azimuth_b"), F.col("declared_azimuth"))
    td, tz = quantum(F.col("distance_hw"), F.col("distance_hw_b")), quantum(F.col("azimuth_hw"), F.col("azimuth_hw_b"), eps=ANGLE_EPS)
    s = F.col("from_idx")
    return emit(
        rows,
        (F.abs(length) > LINEAR_EPS, finding("R18", "inter_document", "error", "distance", s, "AB", F.col("length"), F.col("length_b"), length, F.lit(LINEAR_EPS))),
        (exceeds(d, td), finding("R19", "inter_document", "error", "distance", s, "AB", F.col("distance"), F.col("distance_b"), d, td)),
        (exceeds(z, tz), finding("R20", "inter_document", "error", "azimuth", s, "AB", F.col("declared_azimuth"), F.col("declared_azimuth_b"), z, tz)),
        (flat("neighbour") != flat("neighbour_b"), finding("R21", "inter_document", "warning", "confrontant", s, text_a=F.col("neighbour"), text_b=F.col("neighbour_b"))),
    )


def totals_between(rows: DataFrame) -> DataFrame:
    """R22 to R25 from rows of pair with area, declared_area, area_hw, declared_perimeter, perimeter_hw, registration, each with suffix _a and _b."""
    c, d = F.col, lambda x: F.col(f"{x}_b") - F.col(f"{x}_a")
    widest = lambda x: F.greatest(quantum(c(f"{x}_a"), c(f"{x}_b")), F.lit(LINEAR_EPS))
    row = lambda rule, field, name, delta, tolerance: finding(rule, "inter_document", "error", field, F.lit(field), "AB", c(f"{name}_a"), c(f"{name}_b"), delta, tolerance)
    return emit(
        rows,
        (F.abs(d("area")) > LINEAR_EPS, row("R22", "area", "area", d("area"), F.lit(LINEAR_EPS))),
        (exceeds(d("declared_area"), widest("area_hw")), row("R23", "area", "declared_area", d("declared_area"), widest("area_hw"))),
        (exceeds(d("declared_perimeter"), widest("perimeter_hw")), row("R24", "perimeter", "declared_perimeter", d("declared_perimeter"), widest("perimeter_hw"))),
        (c("registration_a") != c("registration_b"), finding("R25", "inter_document", "warning", "registration", F.lit("registration"), text_a=c("registration_a"), text_b=c("registration_b"))),
    )


def tax_ids_between(ids: DataFrame, key: str = "pair") -> DataFrame:
    """R26 to R28 from rows of pair, role, digits, confidence (several a number: the last by ordinal counts).

    Equal and non-empty sets give R26 alone; otherwise R27 for each number of one side. Weak numbers of either side give R28.
    """
    one = ids.groupBy(key, "role", "digits").agg(F.max_by("confidence", "ordinal").alias("confidence"))
    both = one.groupBy(key, "digits").agg(F.max(F.when(F.col("role") == "A", F.col("confidence"))).alias("a"), F.max(F.when(F.col("role") == "B", F.col("confidence"))).alias("b"))
    alike = both.groupBy(key).agg(F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("alike"), F.count(F.lit(1)).alias("n"))
    name, shown = F.when(F.length("digits") == 14, "cnpj").otherwise("cpf"), mask_tax_id(F.col("digits"))
    field = lambda rule, severity, scope, kind="inter_document", confidence=None: finding(rule, kind, severity, name, shown, scope, confidence)
    sets = emit(alike, (F.col("alike"), finding("R26", "inter_document", "info", "tax_id", F.lit("tax ids"), a=F.col("n"), b=F.col("n"))), key=key)
    single = emit(
        both,
        (F.col("b").isNull(), field("R27", "error", "A")),
        (F.col("a").isNull(), field("R27", "error", "B")),
        (F.col("a") < LOW_CONFIDENCE, field("R28", "warning", "A", "low_confidence", F.col("a"))),
        (F.col("b") < LOW_CONFIDENCE, field("R28", "warning", "B", "low_confidence", F.col("b"))),
        key=key,
    )
    return sets.unionByName(single)


def citations(rows: DataFrame, rule_conflict: str, rule_among: str | None, field: str, key: str = "pair") -> DataFrame:
    """R29, R31 (citations that differ from the computed value, where another matches it) and R30 (where neither case holds, those that differ from the first).

    rows: key, role, ordinal, value, computed, matches (whether the citation equals the computed value as printed), matches_first.
    """
    groups = rows.groupBy(key, "role").agg(F.bool_or("matches").alias("some"), F.bool_and("matches").alias("all"), F.min_by("value", "ordinal").alias("primary"), F.min("ordinal").alias("first_ordinal"))
    joined = rows.join(groups, [key, "role"])
    split = F.col("some") & ~F.col("all")
    delta = F.col("value") - F.col("computed")
    checks = [(split & ~F.col("matches"), finding(rule_conflict, "internal", "warning", field, F.col("ordinal"), F.col("role"), F.col("value"), F.col("computed"), delta))]
    if rule_among:
        checks.append((~split & (F.col("ordinal") > F.col("first_ordinal")) & ~F.col("matches_first"), finding(rule_among, "internal", "warning", field, F.col("ordinal"), F.col("role"), F.col("primary"), F.col("value"), F.col("primary") - F.col("value"))))
    return emit(joined, *checks, key=key)


def low_confidence(observations: DataFrame, key: str = "pair") -> DataFrame:
    """R32 (coordinates) and R33 (area, perimeter, registration) from rows of pair, role, field, subject, value, confidence, edited: unsure values that nobody has edited."""
    weak = (F.col("confidence") < LOW_CONFIDENCE) & ~F.col("edited")
    rule = lambda name: finding(name, "low_confidence", "warning", F.col("field"), F.col("subject"), F.col("role"), F.col("value"), tolerance=F.lit(LOW_CONFIDENCE))
    return emit(observations, (weak & F.col("field").isin("easting", "northing", "latitude", "longitude"), rule("R32")), (weak & F.col("field").isin("area", "perimeter", "registration"), rule("R33")), key=key)


def findings(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rank(column: str, values: list[str]) -> Column:
    return F.coalesce(F.when(F.array_position(F.array(*map(F.lit, values)), F.col(column)) > 0, F.array_position(F.array(*map(F.lit, values)), F.col(column)) - 1), F.lit(9))


def placed(found: DataFrame, key: str = "pair") -> DataFrame:
    """found with place, the order within a pair: severity, kind, subject; what is alike in these as the rules emit it (rule number, scope, field)."""
    order = Window.partitionBy(key).orderBy(rank("severity", SEVERITIES), rank("kind", KINDS), "subject", F.substring("rule", 2, 3).cast("int"), "scope", "field", "delta")
    return found.withColumn("place", F.row_number().over(order))


def summary(found: DataFrame, pairs: DataFrame, key: str = "pair") -> DataFrame:
    """Counts of each of the pairs, zero where nothing was found, and whether it waits for review."""
    count = lambda c, v: F.count_if(F.col(c) == v).alias(f"{v}_count")
    review = F.bool_or(F.col("kind").isin("data_gap", "low_confidence"))
    all_ = pairs.select(key).join(found, key, "left")
    return all_.groupBy(key).agg(F.count("rule").alias("total"), *[count("severity", s) for s in SEVERITIES], *[count("kind", k) for k in KINDS], F.when(review, "awaiting_review").otherwise("compared").alias("status"))
