"""Queries on rings, matching and rules, with their SQL. Values are rounded by floor(x * 10^d + 0.5), alike in both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.functions import crs, numbers
from parcelwise.operators import matching, rings, rules
from parcelwise.queries.tables import DECLARED, SIDES, VA, VB, declared, signed_half_turn, table, vertices_a, vertices_b
from parcelwise.sources.lineage import settled


def _r(column: str | Column, d: int) -> Column:
    """Whole units of 10^-d."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c * 10**d + 0.5).cast("long")


def ring_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rings.ring_metrics(vertices_a(spark, sf_dir), ["pair"])
    return m.select("pair", F.col("vertices"), _r("area", 2).alias("area_cm2"), _r("perimeter", 3).alias("perimeter_mm"), "ccw", _r("centroid_e", 3).alias("centroid_e_mm"), _r("centroid_n", 3).alias("centroid_n_mm"))


def ring_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings.sides(vertices_a(spark, sf_dir), ["pair"]).select("pair", "idx", _r("length", 4).alias("length_u"), _r("azimuth", 6).alias("azimuth_u"))


def angle_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = rings.interior_angles(vertices_a(spark, sf_dir), ["pair"])
    return a.groupBy("pair").agg(F.count(F.lit(1)).alias("vertices"), _r(F.sum("interior_angle"), 4).alias("angle_sum_u"), _r(F.max("interior_angle"), 4).alias("largest_u"))


def traverse_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = declared(spark, sf_dir).select("pair", "idx", F.col("declared_azimuth").alias("azimuth"), "distance", "halfwidth")
    return rings.closure(d, ["pair"]).select("pair", _r("de", 4).alias("de_u"), _r("dn", 4).alias("dn_u"), _r("error", 4).alias("error_u"), _r("total", 2).alias("total_cm"), _r("budget", 3).alias("budget_mm"), (F.col("error") > F.col("budget")).alias("over"), F.when(F.col("error") > 0.001, _r("precision", 0)).alias("precision"))


def traverse_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = declared(spark, sf_dir).select("pair", "idx", F.col("declared_azimuth").alias("azimuth"), "distance")
    return rings.traverse(d, ["pair"]).select("pair", "idx", _r("de", 4).alias("de_u"), _r("dn", 4).alias("dn_u"))


def scale_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rings.ring_metrics(vertices_a(spark, sf_dir), ["pair"])
    geo = m.withColumn("geo", crs.geographic(F.col("centroid_e"), F.col("centroid_n"), F.lit(23), F.lit("S"))).select("*", "geo.*")
    return geo.select("pair", _r("longitude", 8).alias("longitude_u"), _r("latitude", 8).alias("latitude_u"), _r(crs.grid_scale(F.col("centroid_e"), F.col("latitude")), 10).alias("scale_u"), crs.within_brazil(F.col("longitude"), F.col("latitude")).alias("in_brazil"), _r(crs.ground_of_grid(F.col("perimeter"), crs.combined_scale(F.col("centroid_e"), F.col("latitude"), F.lit(760.0))), 2).alias("ground_cm"))


def _ab(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = vertices_a(spark, sf_dir)
    return a, vertices_b(a)


def code_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_by_code(*_ab(spark, sf_dir)).select("pair", "idx_a", "idx_b")


def unmatched_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = matching.with_partners(*_ab(spark, sf_dir)).filter("NOT matched")
    return rest.select("pair", "idx", "code", F.upper("side").alias("role"))


def cyclic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of equal cost are told by the order (not flipped, least shift); costs are compared in whole micrometres there."""
    a, b = _ab(spark, sf_dir)
    return matching.match_cyclic(a, b).groupBy("pair").agg(_r(F.max("cost"), 3).alias("cost_mm"), F.count(F.lit(1)).alias("vertices"))


def cyclic_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners by the sequence of sides where it tells them alone: B as A turned round or begun elsewhere."""
    a, b = (x.filter("pair % 10 IN (5, 6)") for x in _ab(spark, sf_dir))
    least = rings.sides(a, ["pair"]).groupBy("pair").agg(F.count_distinct(F.floor(F.col("length") * 1000)).alias("kinds"), F.count(F.lit(1)).alias("size"))
    clear = least.filter("kinds = size").select("pair")
    return matching.match_cyclic(a.join(clear, "pair", "left_semi"), b.join(clear, "pair", "left_semi")).select("pair", "idx_a", "idx_b", F.col("shift").cast("long").alias("shift"), "flip")


def match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_vertices(*_ab(spark, sf_dir)).select("pair", "idx_a", "idx_b", "method", F.round("residual", 3).alias("residual"))


def geometric_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_geometric(*_ab(spark, sf_dir)).select("pair", "idx_a", "idx_b", F.round("residual", 3).alias("residual"))


def _fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _ab(spark, sf_dir)
    return matching.systematic(matching.helmert(matching.match_by_code(a, b)))


def systematic_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fits(spark, sf_dir).select("pair", "pairs", "kind", _r("shift", 3).alias("shift_mm"), _r("shift_rms", 3).alias("shift_rms_mm"))


def coordinate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _ab(spark, sf_dir)
    points = matching.with_cause(matching.match_by_code(a, b))
    found = rules.coordinates(points.withColumns({"hw_a": F.lit(0.0005), "hw_b": F.lit(0.0005)}))
    return found.select("pair", "kind", "severity", "field", "subject", _r("delta", 4).alias("delta_u"))


def _shown(found: DataFrame, d: int) -> DataFrame:
    return found.select("pair", "rule", "kind", "severity", "field", "subject", "scope", _r("delta", d).alias("delta_u"))


def _printed(column: str, d: int) -> Column:
    """As a document prints it; the last digit's border lies off the values that the tables hold, so that no rounding noise shows."""
    return F.floor(F.col(column) * 10**d + 0.501) / 10**d


def _ring_sides(v: DataFrame, other: bool) -> DataFrame:
    """Sides with what a document prints of them; other: some neighbours are spelled otherwise, and one distance of some pairs is wrong."""
    s = rings.sides(v, ["pair"]).withColumn("to_idx", rings.following("idx", ["pair"])).withColumnRenamed("idx", "from_idx")
    wrong = F.when((F.pmod("pair", F.lit(31)) == 3) & (F.col("from_idx") == 0) & F.lit(other), 2.0).otherwise(0.0)
    name = F.when((F.pmod("pair", F.lit(13)) == 5) & F.lit(other), F.concat(F.lit("Outro "), "from_idx")).otherwise(F.concat(F.lit("Lote  "), "from_idx"))
    return s.select("pair", "from_idx", "to_idx", "length", (_printed("length", 2) + wrong).alias("distance"), F.lit(0.006).alias("distance_hw"), _printed("azimuth", 4).alias("declared_azimuth"), F.lit(0.00006).alias("azimuth_hw"), name.alias("neighbour"))


def side_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of A against those of B between the partners of their ends."""
    a, b = _ab(spark, sf_dir)
    found = rules.sides_between(rules.matched_sides(matching.match_by_code(a, b), _ring_sides(a, False), _ring_sides(b, True)))
    return _shown(signed_half_turn(found), 4)


def internal_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(rules.declared_sides(declared(spark, sf_dir).withColumn("role", F.lit("A"))), 3)


def _totals_of(v: DataFrame, role: str) -> DataFrame:
    angles = rings.interior_angles(v.select("pair", "idx", "e", "n"), ["pair"]).groupBy("pair").agg(F.sum("interior_angle").alias("angle_sum"))
    t = rings.ring_metrics(v.select("pair", "idx", "e", "n"), ["pair"]).join(angles, "pair").withColumn("role", F.lit(role))
    at = lambda n, k: (F.pmod("pair", F.lit(n)) == k) & (F.col("role") == ("B" if n in (17, 19) else "A"))
    return t.withColumns({
        "declared_area": _printed("area", 2) + F.when(at(11, 3), 10.0).otherwise(0.0), "area_hw": F.lit(0.006),
        "declared_perimeter": _printed("perimeter", 2) + F.when(at(23, 5), 1.0).otherwise(0.0), "perimeter_hw": F.lit(0.006),
        "registration": F.concat(F.lit("M"), (F.col("pair") + F.when(at(17, 4), 1).otherwise(0)).cast("string")),
        "epsg": F.when(at(19, 6), F.lit(None)).when(at(19, 7), "EPSG:29193").otherwise("EPSG:31983"),
    })


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair, role and totals of both documents: A prints a wrong area or perimeter in some pairs, B another registration, datum or none."""
    a, b = _ab(spark, sf_dir)
    return _totals_of(a, "A").unionByName(_totals_of(b, "B"))


def _wide(totals: DataFrame) -> DataFrame:
    side = lambda role: F.first(F.when(F.col("role") == role, F.struct(*[c for c in totals.columns if c not in ("pair", "role")])), ignorenulls=True).alias(role)
    both = totals.groupBy("pair").agg(side("A"), side("B"))
    return both.select("pair", *[F.col(f"{role}.{c}").alias(f"{c}_{role.lower()}") for role in "AB" for c in totals.columns if c not in ("pair", "role")])


def total_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared area, perimeter and sum of angles of both documents against the computed ones."""
    return _shown(rules.declared_totals(_totals(spark, sf_dir)), 1)


def closure_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R11, R12 of the declared traverses."""
    d = declared(spark, sf_dir).withColumn("role", F.lit("A"))
    return _shown(rules.closures(rings.closure(d.select("pair", "role", F.col("declared_azimuth").alias("azimuth"), "distance", "halfwidth"), ["pair", "role"])), 4)


def between_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference systems and totals of A against B."""
    wide = _wide(_totals(spark, sf_dir))
    found = rules.totals_between(wide).unionByName(rules.reference_systems(wide))
    return found.select("pair", "rule", "kind", "severity", "field", "subject", "scope", _r("delta", 1).alias("delta_u"), "text_a", "text_b")


def _repeated(b: DataFrame) -> DataFrame:
    """B with a code given twice in some pairs."""
    return b.withColumn("code", F.when((F.pmod("pair", F.lit(29)) == 7) & (F.col("idx") == 1), "P-01").otherwise(F.col("code")))


def structure_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R13 to R15 of matching by codes, some of them repeated: notes, numbers of vertices, vertices without a partner."""
    a, b = _ab(spark, sf_dir)
    b = _repeated(b)
    pairs = matching.match_by_code(a, b)
    size = lambda df, c: df.groupBy("pair").agg(F.count(F.lit(1)).alias(c))
    again = matching.repeated_codes(a, b).select("pair", F.concat(F.lit("repeated codes: "), "codes").alias("note"))
    found = rules.findings(
        rules.notes(again),
        rules.vertex_counts(size(a, "na").join(size(b, "nb"), "pair")),
        rules.without_partner(matching.unmatched(a, pairs, "idx_a"), "A"),
        rules.without_partner(matching.unmatched(b, pairs, "idx_b"), "B"),
    )
    return found.select("pair", "rule", "kind", "severity", "field", "subject", "scope", _r("delta", 0).alias("delta_u"), "text_a")


def cause_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cause that explains a pair's differences, and its size."""
    return _shown(rules.one_cause(_fits(spark, sf_dir)), 3)


def arc_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 to R5 of parts as arcs: some without a central angle, some with a wrong chord or development."""
    k = F.col("p_partkey")
    arcs = table(spark, sf_dir, "part").select(k.alias("pair"), F.lit("A").alias("role"), F.lit(1).alias("idx"), F.when(k % 10 != 9, (k % 50 + 5).cast("double")).alias("radius"), F.lit(0.005).alias("radius_hw"), F.when(k % 4 != 3, (k % 120 + 10).cast("double")).alias("central_angle"))
    arcs = arcs.withColumns({"length": rings.arc_chord(F.col("radius"), F.col("central_angle")) + F.when(F.col("pair") % 3 == 1, 0.25).otherwise(0.001), "development": rings.arc_development(F.col("radius"), F.col("central_angle")) - F.when(F.col("pair") % 5 == 2, 0.5).otherwise(0.001), "development_hw": F.lit(0.005)})
    return _shown(rules.arcs(arcs), 3)


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of suppliers' lines: field, value, confidence by keys; some edited."""
    fields = ["easting", "northing", "latitude", "longitude", "area", "perimeter", "registration", "distance"]
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), F.when(k % 2 == 0, "A").otherwise("B").alias("role"), F.get(F.array(*map(F.lit, fields)), (k % 8).cast("int")).alias("field"), F.concat(F.lit("P"), F.col("l_linenumber").cast("string")).alias("subject"), F.col("l_quantity").alias("value"), F.get(F.array(*map(F.lit, [1.0, 0.95, 0.8, 0.7, 0.5])), (F.col("l_partkey") % 5).cast("int")).alias("confidence"), (F.col("l_suppkey") % 3 == 0).alias("edited"))


def confidence_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsure coordinates and totals that nobody has edited."""
    found = rules.low_confidence(_observed(spark, sf_dir))
    return found.select("pair", "rule", "kind", "severity", "field", "subject", "scope", F.col("value_a").cast("long").alias("value_a"))


def citation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What texts cite against the computed value, and against one another. Cited: orders' line quantities; computed: the first line's, or none of them."""
    w = Window.partitionBy("pair").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").alias("value"))
    rows = lines.select("pair", F.lit("A").alias("role"), F.row_number().over(w).alias("ordinal"), "value", (F.first("value").over(w) + F.when(F.pmod("pair", F.lit(3)) == 0, 0.004).when(F.pmod("pair", F.lit(3)) == 1, 0.0).otherwise(0.3)).alias("computed"))
    cited = rows.withColumns({"halfwidth": F.lit(0.05), "field": F.when(F.pmod("pair", F.lit(2)) == 0, "area").otherwise("perimeter")})
    first = F.first("value").over(Window.partitionBy("pair").orderBy("ordinal"))
    cited = cited.withColumns({"matches": numbers.values_equal(F.col("value"), F.col("computed"), F.col("halfwidth")), "matches_first": numbers.values_equal(F.col("value"), first, F.col("halfwidth"))})
    found = rules.citations(cited.filter("field = 'area'"), "R29", "R30", "area").unionByName(rules.citations(cited.filter("field = 'perimeter'"), "R31", None, "perimeter"))
    return _shown(found, 2)


def _family_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the rules on sides, totals, closures, structure and confidence, over tables that are written once."""
    a = settled(vertices_a(spark, sf_dir))
    b = vertices_b(a)
    totals = settled(_totals_of(a, "A").unionByName(_totals_of(b, "B")))
    wide = _wide(totals)
    d = declared(spark, sf_dir).withColumn("role", F.lit("A"))
    closing = rings.closure(d.select("pair", "role", F.col("declared_azimuth").alias("azimuth"), "distance", "halfwidth"), ["pair", "role"])
    return rules.findings(
        rules.reference_systems(wide), rules.declared_sides(d), rules.declared_totals(totals), rules.closures(closing),
        rules.vertex_counts(wide.select("pair", F.col("vertices_a").alias("na"), F.col("vertices_b").alias("nb"))),
        rules.totals_between(wide), rules.low_confidence(_observed(spark, sf_dir).join(a.select("pair").distinct(), "pair", "left_semi")),
    )


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that the derived tables feed, over all pairs, matched by the cascade. What several rules read is written once."""
    a = settled(vertices_a(spark, sf_dir))
    b = settled(vertices_b(a))
    pairs = settled(matching.match_vertices(a, b).select("pair", "idx_a", "idx_b", "method"))
    points = settled(matching.with_cause(matching.paired_points(pairs, a, b)))
    again = matching.repeated_codes(a, b).select("pair", F.concat(F.lit("repeated codes: "), "codes").alias("note"))
    return rules.findings(
        _family_findings(spark, sf_dir),
        rules.notes(again),
        rules.without_partner(matching.unmatched(a, pairs, "idx_a"), "A"),
        rules.without_partner(matching.unmatched(b, pairs, "idx_b"), "B"),
        rules.one_cause(matching.systematic(matching.helmert(points))),
        rules.coordinates(points.withColumns({"hw_a": F.lit(0.0005), "hw_b": F.lit(0.0005)})),
        rules.sides_between(rules.matched_sides(pairs, _ring_sides(a, False), _ring_sides(b, True))),
    )


def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R34 of the families that need no partner of a vertex; pairs without a finding have zeros."""
    return rules.summary(_family_findings(spark, sf_dir), vertices_a(spark, sf_dir).select("pair").distinct())


def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings on declared sides, totals and closures in the order of the report."""
    d = declared(spark, sf_dir).withColumn("role", F.lit("A"))
    closing = rings.closure(d.select("pair", "role", F.col("declared_azimuth").alias("azimuth"), "distance", "halfwidth"), ["pair", "role"])
    found = rules.findings(rules.declared_sides(d), rules.closures(closing), rules.reference_systems(_wide(_totals(spark, sf_dir))))
    return rules.placed(found).select("pair", F.col("place").cast("long").alias("place"), "rule", "field", "scope")


def vertex_count_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _ab(spark, sf_dir)
    size = lambda df, c: df.groupBy("pair").agg(F.count(F.lit(1)).alias(c))
    return rules.vertex_counts(size(a, "na").join(size(b, "nb"), "pair")).select("pair", "rule", "severity", F.col("value_a").cast("long").alias("value_a"), F.col("value_b").cast("long").alias("value_b"))


QUERIES = {f.__name__: f for f in (ring_metrics, ring_sides, angle_sums, traverse_closure, traverse_positions, scale_factors, code_match, unmatched_vertices, cyclic_match, cyclic_alignment, match_cascade, geometric_match, systematic_offsets, coordinate_findings, side_findings, internal_findings, total_findings, closure_findings, between_totals, structure_findings, cause_findings, arc_findings, confidence_findings, citation_findings, all_findings, finding_counts, finding_order, vertex_count_findings)}


def _u(x: str, d: int) -> str:
    return f"CAST(floor(({x}) * {10**d} + 0.5) AS BIGINT)"


_CROSS = "(e - e0) * (n2 - n0) - (e2 - e0) * (n - n0)"
_AB = f"WITH {VA}, {VB}"
_CODES = """cm AS (SELECT a.pair, a.idx AS idx_a, b.idx AS idx_b, a.e AS ea, a.n AS na, b.e AS eb, b.n AS nb FROM va a JOIN vb b ON a.pair = b.pair
  AND regexp_replace(a.code, '^([A-Z])-0*', '\\1') = regexp_replace(b.code, '^([A-Z])-0*', '\\1'))"""
_FITS = """mean AS (SELECT pair, count(*) AS pairs, avg(ea) AS ea0, avg(na) AS na0, avg(eb) AS eb0, avg(nb) AS nb0 FROM cm GROUP BY pair),
fit AS (
  SELECT *, sqrt((eb0 - ea0) ** 2 + (nb0 - na0) ** 2) AS shift, sqrt(spread / pairs) AS shift_rms, degrees(atan2(crs, dot)) AS rot, sqrt(crs ** 2 + dot ** 2) / sa AS scale,
         sqrt(greatest(sb - (crs ** 2 + dot ** 2) / sa, 0) / pairs) AS rms, sqrt(far) AS span FROM (
    SELECT c.pair, any_value(pairs) AS pairs, any_value(ea0) AS ea0, any_value(na0) AS na0, any_value(eb0) AS eb0, any_value(nb0) AS nb0,
           sum((ea - ea0) * (nb - nb0) - (na - na0) * (eb - eb0)) AS crs, sum((ea - ea0) * (eb - eb0) + (na - na0) * (nb - nb0)) AS dot,
           sum((ea - ea0) ** 2 + (na - na0) ** 2) AS sa, sum((eb - eb0) ** 2 + (nb - nb0) ** 2) AS sb, max((ea - ea0) ** 2 + (na - na0) ** 2) AS far,
           sum(((eb - eb0) - (ea - ea0)) ** 2 + ((nb - nb0) - (na - na0)) ** 2) AS spread
    FROM cm c JOIN mean m ON c.pair = m.pair GROUP BY c.pair)),
kinds AS (SELECT *, CASE WHEN pairs < 3 THEN NULL WHEN shift > 0.2 AND shift_rms < 0.25 * shift THEN 'translation'
  WHEN abs(rot) > 0.002 AND rms < 0.25 * radians(abs(rot)) * span THEN 'rotation' WHEN abs(scale - 1) * 1e6 > 20 AND rms < 0.25 * abs(scale - 1) * span THEN 'scale' END AS kind FROM fit)"""
_SIDES_B = SIDES.replace("sa AS", "sb AS").replace("FROM va", "FROM vb")
_NEXT = "coalesce(lead(idx) OVER (PARTITION BY pair ORDER BY idx), first_value(idx) OVER (PARTITION BY pair ORDER BY idx)) AS to_idx"
_ANGLE = """ang AS (SELECT pair, idx, CASE WHEN signed > 0 THEN ((azimuth - back) % 360 + 360) % 360 ELSE ((back - azimuth) % 360 + 360) % 360 END AS angle FROM (
  SELECT *, ((degrees(atan2(pe - e, pn - n)) % 360) + 360) % 360 AS back, sum((e - e0) * (n2 - n0) - (e2 - e0) * (n - n0)) OVER (PARTITION BY pair) AS signed FROM (
    SELECT *, coalesce(lag(e) OVER w, last_value(e) OVER full_) AS pe, coalesce(lag(n) OVER w, last_value(n) OVER full_) AS pn FROM sa
    WINDOW w AS (PARTITION BY pair ORDER BY idx), full_ AS (PARTITION BY pair ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))))"""

def _totals_sql(v: str, role: str) -> str:
    """The ring's totals as both documents print them; A has a wrong area or perimeter in some pairs."""
    sides_, angles = SIDES.replace("sa AS", f"s{role} AS").replace("FROM va", f"FROM {v}"), _ANGLE.replace("ang AS", f"ang{role} AS").replace("FROM sa", f"FROM s{role}")
    wrong = "CASE WHEN s.pair % 11 = 3 THEN 10.0::DOUBLE ELSE 0 END", "CASE WHEN s.pair % 23 = 5 THEN 1.0::DOUBLE ELSE 0 END"
    da, dp = wrong if role == "A" else ("0", "0")
    return f"""{sides_}, {angles}, tot{role} AS (SELECT s.pair, '{role}' AS role, n, area, per, asum, floor(area * 100 + 0.501) / 100 + {da} AS darea, floor(per * 100 + 0.501) / 100 + {dp} AS dper FROM (
        SELECT pair, count(*) AS n, abs(sum({_CROSS}) / 2) AS area, sum(length) AS per FROM s{role} GROUP BY pair) s JOIN (SELECT pair, sum(angle) AS asum FROM ang{role} GROUP BY pair) g ON s.pair = g.pair)"""


_TOTALS = f"""{_totals_sql("va", "A")}, {_totals_sql("vb", "B")}, tot AS (SELECT * FROM totA UNION ALL SELECT * FROM totB)"""
_OBSERVED = """ob AS (SELECT * FROM (SELECT l_orderkey AS pair, (l_orderkey * 7 + l_linenumber) % 8 AS f, ['easting', 'northing', 'latitude', 'longitude', 'area', 'perimeter', 'registration', 'distance'][(l_orderkey * 7 + l_linenumber) % 8 + 1] AS field,
  'P' || l_linenumber AS subject, CASE WHEN (l_orderkey * 7 + l_linenumber) % 2 = 0 THEN 'A' ELSE 'B' END AS scope, CAST(l_quantity AS BIGINT) AS value_a FROM lineitem WHERE l_partkey % 5 IN (3, 4) AND l_suppkey % 3 <> 0) WHERE f < 7)"""

SQL = {
    "ring_metrics": f"""WITH {VA}, {SIDES} SELECT pair, count(*) AS vertices, {_u(f'abs(sum({_CROSS}) / 2)', 2)} AS area_cm2, {_u('sum(length)', 3)} AS perimeter_mm,
        sum({_CROSS}) / 2 > 0 AS ccw, {_u('avg(e)', 3)} AS centroid_e_mm, {_u('avg(n)', 3)} AS centroid_n_mm FROM sa GROUP BY pair""",
    "ring_sides": f"WITH {VA}, {SIDES} SELECT pair, idx, {_u('length', 4)} AS length_u, {_u('azimuth', 6)} AS azimuth_u FROM sa",
    "angle_sums": f"WITH {VA}, {SIDES}, {_ANGLE} SELECT pair, count(*) AS vertices, {_u('sum(angle)', 4)} AS angle_sum_u, {_u('max(angle)', 4)} AS largest_u FROM ang GROUP BY pair",
    "traverse_closure": f"""WITH {VA}, {SIDES}, {DECLARED} SELECT pair, {_u('de', 4)} AS de_u, {_u('dn', 4)} AS dn_u, {_u('sqrt(de * de + dn * dn)', 4)} AS error_u, {_u('total', 2)} AS total_cm,
        {_u('budget', 3)} AS budget_mm, sqrt(de * de + dn * dn) > budget AS over, CASE WHEN sqrt(de * de + dn * dn) > 0.001 THEN {_u('total / sqrt(de * de + dn * dn)', 0)} END AS precision FROM (SELECT pair, sum(distance * sin(radians(declared_azimuth))) AS de, sum(distance * cos(radians(declared_azimuth))) AS dn,
        sum(distance) AS total, sum(0.005::DOUBLE) AS budget FROM dc GROUP BY pair)""",
    "traverse_positions": f"""WITH {VA}, {SIDES}, {DECLARED} SELECT pair, idx, {_u('sum(distance * sin(radians(declared_azimuth))) OVER w', 4)} AS de_u,
        {_u('sum(distance * cos(radians(declared_azimuth))) OVER w', 4)} AS dn_u FROM dc WINDOW w AS (PARTITION BY pair ORDER BY idx)""",
    "code_match": f"{_AB}, {_CODES} SELECT pair, idx_a, idx_b FROM cm",
    "unmatched_vertices": f"""{_AB}, {_CODES} SELECT pair, idx, code, 'A' AS role FROM va WHERE NOT EXISTS (SELECT 1 FROM cm WHERE cm.pair = va.pair AND cm.idx_a = va.idx)
        UNION ALL SELECT pair, idx, code, 'B' FROM vb WHERE NOT EXISTS (SELECT 1 FROM cm WHERE cm.pair = vb.pair AND cm.idx_b = vb.idx)""",
    "cyclic_match": f"""{_AB}, {SIDES}, {_SIDES_B}, n AS (SELECT va_n.pair, na FROM (SELECT pair, count(*) AS na FROM va GROUP BY pair) va_n JOIN (SELECT pair, count(*) AS nb FROM vb GROUP BY pair) vb_n ON va_n.pair = vb_n.pair AND na = nb),
        tries AS (SELECT sa.pair, shift, flip, any_value(na) AS na, sum(abs(sa.length - sb.length)) / any_value(na) AS cost FROM n
          JOIN (SELECT unnest(range(0, 100)) AS shift) s ON shift < na CROSS JOIN (VALUES (false), (true)) f(flip) JOIN sa ON sa.pair = n.pair
          JOIN sb ON sb.pair = n.pair AND sb.idx = CASE WHEN flip THEN ((shift - sa.idx - 1) % na + na) % na ELSE (sa.idx + shift) % na END GROUP BY sa.pair, shift, flip)
        SELECT pair, {_u('min(cost)', 3)} AS cost_mm, any_value(na) AS vertices FROM tries GROUP BY pair""",
    "cyclic_alignment": f"""WITH {VA}, {SIDES}, u AS (SELECT pair, count(*) AS m FROM sa GROUP BY pair HAVING count(DISTINCT floor(length * 1000)) = count(*))
        SELECT a.pair, idx AS idx_a, CAST(CASE a.pair % 10 WHEN 5 THEN m - 1 - idx ELSE (idx + 1) % m END AS INT) AS idx_b, CASE a.pair % 10 WHEN 5 THEN m - 1 ELSE 1 END AS shift, a.pair % 10 = 5 AS flip FROM va a JOIN u ON a.pair = u.pair WHERE a.pair % 10 IN (5, 6)""",
    "systematic_offsets": f"{_AB}, {_CODES}, {_FITS} SELECT pair, pairs, kind, {_u('shift', 3)} AS shift_mm, {_u('shift_rms', 3)} AS shift_rms_mm FROM kinds",
    "coordinate_findings": f"""{_AB}, {_CODES}, {_FITS} SELECT c.pair, CASE WHEN kind IS NULL THEN 'inter_document' ELSE 'systematic' END AS kind, CASE WHEN kind IS NULL THEN 'error' ELSE 'info' END AS severity,
        field, CAST(idx_a AS VARCHAR) AS subject, {_u('delta', 4)} AS delta_u FROM (SELECT pair, idx_a, 'easting' AS field, eb - ea AS delta FROM cm UNION ALL SELECT pair, idx_a, 'northing', nb - na FROM cm) c
        JOIN kinds k ON c.pair = k.pair WHERE abs(delta) > 0.0005""",
    "side_findings": f"""{_AB}, {_CODES}, {SIDES}, {_SIDES_B}, ta AS (SELECT *, {_NEXT} FROM sa), tb AS (SELECT *, {_NEXT} FROM sb),
        both_ AS (SELECT a.pair, a.idx AS from_idx, b.idx AS from_b, b.length - a.length AS dl, floor(b.length * 100 + 0.501) / 100 + CASE WHEN a.pair % 31 = 3 AND b.idx = 0 THEN 2.0::DOUBLE ELSE 0 END - floor(a.length * 100 + 0.501) / 100 AS dd,
            ((floor(b.azimuth * 10000 + 0.501) / 10000 - floor(a.azimuth * 10000 + 0.501) / 10000 + 180) % 360 + 360) % 360 - 180 AS dz
          FROM ta a JOIN cm c ON c.pair = a.pair AND c.idx_a = a.idx JOIN cm d ON d.pair = a.pair AND d.idx_a = a.to_idx
          JOIN tb b ON b.pair = a.pair AND b.idx = c.idx_b AND b.to_idx = d.idx_b)
        SELECT pair, 'R18' AS rule, 'inter_document' AS kind, 'error' AS severity, 'distance' AS field, CAST(from_idx AS VARCHAR) AS subject, 'AB' AS scope, {_u('dl', 4)} AS delta_u FROM both_ WHERE abs(dl) > 1e-4
        UNION ALL SELECT pair, 'R19', 'inter_document', 'error', 'distance', CAST(from_idx AS VARCHAR), 'AB', {_u('dd', 4)} FROM both_ WHERE abs(dd) > 0.006
        UNION ALL SELECT pair, 'R20', 'inter_document', 'error', 'azimuth', CAST(from_idx AS VARCHAR), 'AB', {_u('dz', 4)} FROM both_ WHERE abs(dz) > 0.00006
        UNION ALL SELECT pair, 'R21', 'inter_document', 'warning', 'confrontant', CAST(from_idx AS VARCHAR), 'AB', NULL FROM both_ WHERE pair % 13 = 5 OR from_idx <> from_b""",
    "internal_findings": f"""WITH {VA}, {SIDES}, {DECLARED}, d AS (SELECT *, distance - length AS dd, ((declared_azimuth - azimuth + 180) % 360 + 360) % 360 - 180 AS dz FROM dc)
        SELECT pair, 'R6' AS rule, 'internal' AS kind, 'warning' AS severity, 'distance' AS field, CAST(idx AS VARCHAR) AS subject, 'A' AS scope, {_u('dd', 3)} AS delta_u FROM d WHERE abs(dd) > 0.005
        UNION ALL SELECT pair, 'R7', 'internal', 'warning', 'azimuth', CAST(idx AS VARCHAR), 'A', {_u('dz', 3)} FROM d WHERE abs(dz) > 0.00005""",
    "total_findings": f"""{_AB}, {_TOTALS}
        SELECT pair, 'R8' AS rule, 'internal' AS kind, 'error' AS severity, 'area' AS field, role AS subject, role AS scope, {_u('darea - area', 1)} AS delta_u FROM tot WHERE abs(darea - area) > 0.006
        UNION ALL SELECT pair, 'R9', 'internal', 'warning', 'perimeter', role, role, {_u('dper - per', 1)} FROM tot WHERE abs(dper - per) > 0.006 * n
        UNION ALL SELECT pair, 'R10', 'internal', 'warning', 'interior_angle', role, role, {_u('asum - (n - 2) * 180', 1)} FROM tot WHERE abs(asum - (n - 2) * 180) > n * 1e-8""",
    "closure_findings": f"""WITH {VA}, {SIDES}, {DECLARED}, c AS (SELECT pair, sqrt(de * de + dn * dn) AS error, budget FROM (SELECT pair, sum(distance * sin(radians(declared_azimuth))) AS de, sum(distance * cos(radians(declared_azimuth))) AS dn, sum(0.005::DOUBLE) AS budget FROM dc GROUP BY pair))
        SELECT pair, CASE WHEN error > budget THEN 'R11' ELSE 'R12' END AS rule, 'internal' AS kind, CASE WHEN error > budget THEN 'error' ELSE 'info' END AS severity, 'perimeter' AS field, 'A' AS subject, 'A' AS scope, {_u('error', 4)} AS delta_u FROM c""",
    "between_totals": f"""{_AB}, {_TOTALS}, p AS (SELECT DISTINCT pair FROM va), w AS (SELECT a.pair, b.area - a.area AS da, b.darea - a.darea AS dd, b.dper - a.dper AS dp FROM tot a JOIN tot b ON a.pair = b.pair AND a.role = 'A' AND b.role = 'B')
        SELECT pair, 'R1' AS rule, 'data_gap' AS kind, 'error' AS severity, 'datum' AS field, 'B' AS subject, 'B' AS scope, NULL::BIGINT AS delta_u, NULL::VARCHAR AS text_a, NULL::VARCHAR AS text_b FROM p WHERE pair % 19 = 6
        UNION ALL SELECT pair, 'R2', 'inter_document', 'warning', 'datum', 'datum', 'AB', NULL, 'EPSG:31983', 'EPSG:29193' FROM p WHERE pair % 19 = 7
        UNION ALL SELECT pair, 'R22', 'inter_document', 'error', 'area', 'area', 'AB', {_u('da', 1)}, NULL, NULL FROM w WHERE abs(da) > 1e-4
        UNION ALL SELECT pair, 'R23', 'inter_document', 'error', 'area', 'area', 'AB', {_u('dd', 1)}, NULL, NULL FROM w WHERE abs(dd) > 0.006
        UNION ALL SELECT pair, 'R24', 'inter_document', 'error', 'perimeter', 'perimeter', 'AB', {_u('dp', 1)}, NULL, NULL FROM w WHERE abs(dp) > 0.006
        UNION ALL SELECT pair, 'R25', 'inter_document', 'warning', 'registration', 'registration', 'AB', NULL, 'M' || pair, 'M' || (pair + 1) FROM p WHERE pair % 17 = 4""",
    "structure_findings": f"""{_AB}, vr AS (SELECT pair, idx, CASE WHEN pair % 29 = 7 AND idx = 1 THEN 'P-01' ELSE code END AS code FROM vb), once AS (SELECT pair, code, any_value(idx) AS idx FROM vr GROUP BY ALL HAVING count(*) = 1),
        cm AS (SELECT a.pair, a.idx AS idx_a, b.idx AS idx_b FROM va a JOIN once b ON a.pair = b.pair AND a.code = b.code), na AS (SELECT pair, count(*) AS n FROM va GROUP BY pair), nb AS (SELECT pair, count(*) AS n FROM vb GROUP BY pair)
        SELECT pair, 'R13' AS rule, 'structural' AS kind, 'info' AS severity, NULL::VARCHAR AS field, 'match' AS subject, 'AB' AS scope, NULL::BIGINT AS delta_u, 'repeated codes: P1' AS text_a FROM vr GROUP BY pair HAVING count(*) FILTER (WHERE code = 'P-01') > 1
        UNION ALL SELECT na.pair, 'R14', 'structural', 'error', 'vertex_code', 'vertices', 'AB', nb.n - na.n, NULL FROM na JOIN nb ON na.pair = nb.pair AND na.n <> nb.n
        UNION ALL SELECT pair, 'R15', 'structural', 'warning', 'vertex_code', code, 'A', NULL, NULL FROM va WHERE NOT EXISTS (SELECT 1 FROM cm WHERE cm.pair = va.pair AND cm.idx_a = va.idx)
        UNION ALL SELECT pair, 'R15', 'structural', 'warning', 'vertex_code', code, 'B', NULL, NULL FROM vr WHERE NOT EXISTS (SELECT 1 FROM cm WHERE cm.pair = vr.pair AND cm.idx_b = vr.idx)""",
    "cause_findings": f"""{_AB}, {_CODES}, {_FITS} SELECT pair, 'R16' AS rule, 'systematic' AS kind, 'error' AS severity, 'easting' AS field, kind AS subject, 'AB' AS scope,
        {_u("CASE kind WHEN 'translation' THEN shift WHEN 'rotation' THEN abs(rot) ELSE abs(scale - 1) * 1e6 END", 3)} AS delta_u FROM kinds WHERE kind IS NOT NULL""",
    "arc_findings": f"""WITH s AS (SELECT p_partkey AS k, p_partkey % 4 = 3 AS bare, 0.25::DOUBLE AS c, 0.5::DOUBLE AS d FROM part WHERE p_partkey % 10 <> 9)
        SELECT k AS pair, 'R3' AS rule, 'structural' AS kind, 'info' AS severity, 'distance' AS field, '1' AS subject, 'A' AS scope, NULL::BIGINT AS delta_u FROM s WHERE bare
        UNION ALL SELECT k, 'R4', 'internal', 'warning', 'distance', '1', 'A', {_u('c', 3)} FROM s WHERE NOT bare AND k % 3 = 1 UNION ALL SELECT k, 'R5', 'internal', 'warning', 'distance', '1', 'A', {_u('-d', 3)} FROM s WHERE NOT bare AND k % 5 = 2""",
    "confidence_findings": f"WITH {_OBSERVED} SELECT pair, CASE WHEN f < 4 THEN 'R32' ELSE 'R33' END AS rule, 'low_confidence' AS kind, 'warning' AS severity, field, subject, scope, value_a FROM ob",
    # as printed with one decimal, the first citation is the computed value but for pairs that leave 2 by 3
    "citation_findings": f"""WITH l AS (SELECT l_orderkey AS pair, l_quantity AS v, row_number() OVER w AS k, first_value(l_quantity) OVER w AS f FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
        c AS (SELECT *, pair % 3 = 2 AS none, f + CASE pair % 3 WHEN 0 THEN 0.004::DOUBLE WHEN 1 THEN 0 ELSE 0.3::DOUBLE END AS computed FROM l)
        SELECT pair, CASE WHEN pair % 2 = 0 THEN 'R29' ELSE 'R31' END AS rule, 'internal' AS kind, 'warning' AS severity, CASE WHEN pair % 2 = 0 THEN 'area' ELSE 'perimeter' END AS field, CAST(k AS VARCHAR) AS subject, 'A' AS scope, {_u('v - computed', 2)} AS delta_u FROM c WHERE NOT none AND v <> f
        UNION ALL SELECT pair, 'R30', 'internal', 'warning', 'area', CAST(k AS VARCHAR), 'A', {_u('f - v', 2)} FROM c WHERE none AND pair % 2 = 0 AND v <> f""",
    "vertex_count_findings": f"""{_AB} SELECT a.pair, 'R14' AS rule, 'error' AS severity, na AS value_a, nb AS value_b FROM (SELECT pair, count(*) AS na FROM va GROUP BY pair) a
        JOIN (SELECT pair, count(*) AS nb FROM vb GROUP BY pair) b ON a.pair = b.pair AND na <> nb""",
}
_FAMILIES = ["internal_findings", "total_findings", "closure_findings", "between_totals", "confidence_findings"]
SQL["finding_counts"] = f"""WITH {VA}, p AS (SELECT DISTINCT pair FROM va), f AS ({" UNION ALL ".join(f"SELECT pair, rule, kind, severity FROM ({SQL[x]})" for x in _FAMILIES)} UNION ALL SELECT pair, rule, 'structural', severity FROM ({SQL["vertex_count_findings"]}))
    SELECT p.pair, count(rule) AS total, {", ".join(f"count(*) FILTER (WHERE severity = '{x}') AS {x}_count" for x in rules.SEVERITIES)}, {", ".join(f"count(*) FILTER (WHERE kind = '{x}') AS {x}_count" for x in rules.KINDS)},
      CASE WHEN coalesce(bool_or(kind IN ('data_gap', 'low_confidence')), false) THEN 'awaiting_review' ELSE 'compared' END AS status FROM p LEFT JOIN f ON p.pair = f.pair GROUP BY p.pair"""
SQL["finding_order"] = f"""WITH f AS (SELECT pair, rule, kind, severity, field, subject, scope, delta_u FROM ({SQL["internal_findings"]}) UNION ALL SELECT pair, rule, kind, severity, field, subject, scope, delta_u FROM ({SQL["closure_findings"]})
    UNION ALL SELECT pair, rule, kind, severity, field, subject, scope, delta_u FROM ({SQL["between_totals"]}) WHERE rule IN ('R1', 'R2'))
    SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY list_position(['error', 'warning', 'info'], severity), list_position(['systematic', 'data_gap', 'structural', 'inter_document', 'internal', 'low_confidence'], kind), subject, CAST(rule[2:] AS INT), scope, field) AS place, rule, field, scope FROM f"""
# the inverse projection by its series, written out
SQL["scale_factors"] = f"""WITH {VA}, {SIDES}, m AS (SELECT pair, avg(e) AS e, avg(n) AS n, sum(length) AS per FROM sa GROUP BY pair),
    k AS (SELECT 1 / 298.257222101::DOUBLE AS f, 6378137.0::DOUBLE AS a), t AS (SELECT f / (2 - f) AS t, f * (2 - f) AS e2, a FROM k),
    x AS (SELECT m.*, t, e2, a, (n - 1e7) / (0.9996::DOUBLE * a / (1 + t) * (1 + t ** 2 / 4 + t ** 4 / 64)) AS xi, (e - 500000) / (0.9996::DOUBLE * a / (1 + t) * (1 + t ** 2 / 4 + t ** 4 / 64)) AS eta FROM m, t),
    y AS (SELECT *, xi - (t / 2 - 2 * t ** 2 / 3 + 37 * t ** 3 / 96) * sin(2 * xi) * cosh(2 * eta) - (t ** 2 / 48 + t ** 3 / 15) * sin(4 * xi) * cosh(4 * eta) - 17 * t ** 3 / 480 * sin(6 * xi) * cosh(6 * eta) AS xp,
      eta - (t / 2 - 2 * t ** 2 / 3 + 37 * t ** 3 / 96) * cos(2 * xi) * sinh(2 * eta) - (t ** 2 / 48 + t ** 3 / 15) * cos(4 * xi) * sinh(4 * eta) - 17 * t ** 3 / 480 * cos(6 * xi) * sinh(6 * eta) AS ep FROM x),
    z AS (SELECT *, asin(sin(xp) / cosh(ep)) AS chi FROM y),
    g AS (SELECT pair, e, per, e2, a, -45 + degrees(atan2(sinh(ep), cos(xp))) AS lon, chi + (2 * t - 2 * t ** 2 / 3 - 2 * t ** 3) * sin(2 * chi) + (7 * t ** 2 / 3 - 8 * t ** 3 / 5) * sin(4 * chi) + 56 * t ** 3 / 15 * sin(6 * chi) AS lat FROM z),
    r AS (SELECT *, a * sqrt(1 - e2) / (1 - e2 * sin(lat) ** 2) AS rad FROM g), s AS (SELECT *, 0.9996::DOUBLE * (1 + ((e - 500000) / 0.9996::DOUBLE) ** 2 / (2 * rad ** 2)) AS scale FROM r)
    SELECT pair, {_u('lon', 8)} AS longitude_u, {_u('degrees(lat)', 8)} AS latitude_u, {_u('scale', 10)} AS scale_u, lon BETWEEN -74.5 AND -33 AND degrees(lat) BETWEEN -34.5 AND 6 AS in_brazil, {_u('per / (scale * (rad / (rad + 760)))', 2)} AS ground_cm FROM s"""
