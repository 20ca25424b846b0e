"""Queries on text, numbers, angles, extraction, storage and the queue, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.functions import angles, crs, numbers, text
from parcelwise.functions.let import exploded
from parcelwise.operators import context, extraction, parcels, rules
from parcelwise.queries.tables import SIDES, VA, table, table_cells, text_pages, vertices_a
from parcelwise.sources import store
from parcelwise.sources.lineage import settled
from parcelwise.streaming import queue


def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices printed in three ways, parsed under two conventions."""
    lines = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("cents")).distinct()
    plain = F.concat((F.col("cents") / 100).cast("long").cast("string"), F.lit(","), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    dotted = F.concat(F.lit("R$ "), F.regexp_replace((F.col("cents") / 100).cast("long").cast("string"), "(\\d)(\\d{3})$", "$1.$2"), F.lit(","), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"), F.lit(" m"))
    thousand = F.concat(F.lit("\u2212"), (F.col("cents") % 1000).cast("string"), F.lit(".125"))
    rows = lines.select("cents", F.explode(F.array(F.struct(F.lit(1).alias("form"), plain.alias("raw"), F.lit("br").alias("conv")), *[F.struct(F.lit(k).alias("form"), raw.alias("raw"), F.lit(conv).alias("conv")) for k, raw, conv in ((2, dotted, "us"), (3, thousand, "br"), (4, thousand, "us"))])).alias("x")).select("cents", "x.*")
    n = numbers.parse_number(F.col("raw"), F.col("conv"))
    return rows.select("cents", "form", F.floor(n["value"] * 1000 + 0.5).cast("long").alias("value_m"), n["decimals"].alias("decimals"))


def parsed_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees, minutes and seconds, and quadrant bearings, from the parts' keys."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    d, m, s = F.col("k") % 90, F.col("k") % 60, F.col("k") % 59
    dms = F.concat(d.cast("string"), F.lit("°"), m.cast("string"), F.lit("'"), s.cast("string"), F.lit(",5\""))
    quadrant = F.get(F.array(*map(F.lit, ["NE", "SE", "SO", "NL"])), (F.col("k") % 4).cast("int"))
    bearing = F.concat(F.substring(quadrant, 1, 1), F.lit(" "), dms, F.lit(" "), F.substring(quadrant, 2, 1))
    rows = parts.select("k", dms.alias("dms"), bearing.alias("bearing"))
    one, two = angles.parse_angle(F.col("dms")), angles.parse_angle(F.col("bearing"))
    return rows.select("k", F.floor(one["degrees"] * 1e7 + 0.5).cast("long").alias("degrees_u"), F.floor(one["precision"] * 10 + 0.5).cast("long").alias("precision_u"), F.floor(two["degrees"] * 1e7 + 0.5).cast("long").alias("azimuth_u"), angles.to_dms(F.col("k") * 0.0125).alias("shown"), angles.azimuth_to_bearing(F.col("k") * 0.37)["quadrant"].alias("quadrant"), F.floor(angles.angular_difference(F.col("k") * 1.0, F.col("k") * 3.0) * 1000 + 0.5).cast("long").alias("difference_u"))


def normalized_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a label."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    return lines.select("doc_id", "line", text.normalize_label(F.col("raw")).alias("label"))


def normalized_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.format_string("%s-%05d", F.when(F.col("p_partkey") % 3 == 0, "v").when(F.col("p_partkey") % 3 == 1, "BR-SP-M").otherwise(""), F.col("p_partkey")).alias("raw"))
    return raw.select("k", text.normalize_code(F.col("raw")).alias("code"))


def tax_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine digits from each customer's key, completed by their check digits (one in five wrong), masked, found in a text and checked."""
    nine = F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0")
    rows = table(spark, sf_dir, "customer").select("c_custkey", nine.alias("nine"))
    rows = rows.withColumn("d1", text._check_digit(F.col("nine"), text.CPF_WEIGHTS[0])).withColumn("ten", F.concat("nine", F.col("d1").cast("string")))
    rows = rows.withColumn("d2", text._check_digit(F.col("ten"), text.CPF_WEIGHTS[1]))
    digits = F.concat("ten", F.when(F.col("c_custkey") % 5 == 0, (F.col("d2") + 1) % 10).otherwise(F.col("d2")).cast("string"))
    printed = rows.select("c_custkey", digits.alias("digits")).select("c_custkey", F.concat(F.lit("CPF n. "), text.mask_tax_id(F.col("digits")), F.lit(", residente")).alias("printed"))
    return exploded(printed, ["c_custkey"], text.tax_ids(F.col("printed"))).select("c_custkey", "x.*").select("c_custkey", "digits", "valid", text.mask_tax_id(F.col("digits")).alias("shown"))


def utm_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["sirgas 2000", "sad69", "corrego alegre", "datum wgs 84 utm"]
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.get(F.array(*map(F.lit, names)), (F.col("s_suppkey") % 4).cast("int")).alias("label"), (F.col("s_suppkey") % 61).cast("int").alias("zone"), F.when(F.col("s_suppkey") % 3 == 0, "N").otherwise("S").alias("hemisphere"))
    family = crs.datum_family(F.col("label"))
    return rows.select("k", family.alias("family"), crs.utm_epsg(family, F.col("zone"), F.col("hemisphere")).cast("long").alias("epsg"), crs.central_meridian(F.col("zone")).cast("long").alias("meridian"), crs.zone_of_longitude(F.col("zone") * 1.0 - 60).cast("long").alias("zone_of"), crs.hemisphere_of_northing(F.col("zone") * 200000.0).alias("side"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 5).cast("long").alias("document"), F.col("page_id").alias("page"), F.length("html").alias("size"))
    k = F.col("page")
    return p.select("document", "page", F.when(k % 7 == 0, 5).when(k % 7 == 1, 90).otherwise(F.col("size")).alias("chars"), (k % 3).cast("int").alias("images"), ((k % 10) / 10).alias("coverage"), (k % 11 * 60).alias("vectors"), F.when(k % 4 == 0, 1).otherwise(0).alias("tables"))


def page_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.triage(_pages(spark, sf_dir)).select("page", "kind", "relevance", "needs_ocr", "is_data")


def document_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.document_profile(extraction.triage(_pages(spark, sf_dir)))


def number_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's prices as tokens, in the way of printing that the order's number tells, a few otherwise."""
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")
    whole, rest = F.floor(cents / 100).cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    token = F.when(F.col("l_orderkey") % 4 == 0, F.concat(whole, F.lit("."), rest)).when(F.col("l_orderkey") % 4 == 1, F.concat(whole, F.lit(","), rest)).when(F.col("l_orderkey") % 4 == 2, whole).otherwise(F.concat(whole, F.when(F.col("l_linenumber") % 2 == 0, ".").otherwise(","), rest))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), (F.col("l_linenumber") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"), token.alias("token"))
    return extraction.number_convention(rows)


def consensus_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("document"), F.lit("area").alias("field"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").alias("value"))
    return extraction.consensus(rows).select("document", "value", "confidence", F.size("rivals").alias("rivals"))


def stitched_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("page_key"), (F.col("o_orderkey") % 3).alias("columns"), (F.col("o_orderkey") % 20 + 3).alias("rows"), (F.col("o_orderkey") % 5 == 0).alias("has_header"))
    pages = orders.withColumn("page", F.row_number().over(Window.partitionBy("document").orderBy("page_key")))
    pages = pages.withColumn("columns", F.floor(F.col("page") / 3)).withColumn("page", F.col("page") + F.when(F.col("page") > 6, 1).otherwise(0))
    return extraction.stitch_pages(pages)


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each document laid out on pages of 60: three to a row, with jitter; every seventh stands 8 to the right of its column, and the first of a page far out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), F.posexplode(F.split("text", "\\s+")).alias("at", "text"))
    words = docs.select("document", (F.floor(F.col("at") / 60) + 1).cast("int").alias("page"), (F.col("at") % 60).cast("int").alias("k"), "text")
    x0 = F.when(F.col("k") == 0, 950.0).otherwise(F.col("k") % 3 * 100.0 + F.when(F.col("k") % 7 == 0, 8.0).otherwise(0.0) + F.col("document") % 4)
    return words.select("document", "page", x0.alias("x0"), (F.floor(F.col("k") / 3) * 14.0 + F.col("k") % 3).alias("top"), "text")


def word_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.page_grid(_words(spark, sf_dir)).select("document", "page", F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column"), "text")


def column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir).drop("text")
    edges = exploded(extraction.page_edges(extraction.word_pages(words)), ["document", "page"], F.col("edges")).select("document", "page", "x.*")
    return edges.select("document", "page", F.floor(F.col("boundary") * 1000 + 0.5).cast("long").alias("boundary_m"), "support")


def nearest_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of words by edges closer to one another than their reach: the nearest counts, not the last."""
    words = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document"), F.lit(1).alias("page"), (F.col("p_partkey") % 60).cast("double").alias("x0"))
    edges = words.select("document", "page", F.explode(F.array(*[F.lit(float(x)) for x in (0, 10, 18, 40, 51)])).alias("boundary"))
    return extraction.assign_columns(words, edges).select("document", F.col("column").cast("long").alias("column"))


def header_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers of printed tables, and what tells of them."""
    maps = extraction.map_headers(table_cells(spark, sf_dir), ["document"])
    return maps.select("document", F.col("row").cast("long").alias("row"), "two_rows", "fields", F.floor(F.col("confidence") * 1000 + 0.5).cast("long").alias("confidence_m"), "code_is_pair", "has_coordinates", F.explode("columns").alias("field", "column")).withColumn("column", F.col("column").cast("long"))


def late_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in the tenth row are data, however many fields they name."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("document"), F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("column"), F.lit(t).alias("text")) for r, c, t in ((1, 0, "Vértice"), (1, 1, "Rumo"), (9, 0, "Lado"), (9, 1, "Divisa"), (9, 2, "Matrícula"))])).alias("x")).select("document", "x.*")
    maps = extraction.map_headers(rows, ["document"], two_rows=False)
    return maps.select("document", F.col("row").cast("long").alias("row"), F.array_join(F.array_sort(F.map_keys("columns")), ",").alias("fields"), "has_coordinates")


def parcels_from_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From printed tables to vertices and sides; numbers as printed, in whole units."""
    cells = table_cells(spark, sf_dir)
    # of the rings themselves: of cells it would make all tables once more
    told = vertices_a(spark, sf_dir).filter("idx = 0").select(F.col("pair").alias("document"), F.when(F.col("pair") % 2 == 0, "br").otherwise("ambiguous").alias("convention"))
    p = parcels.parcels(cells, told, ["document"])
    u = lambda c, k: F.floor(F.col(c) * k + 0.5).cast("long")
    return p.select("document", F.col("idx").cast("long").alias("idx"), "code", u("e", 1000).alias("e_mm"), u("n", 1000).alias("n_mm"), "convention", u("declared_azimuth", 3600).alias("azimuth_s"), u("distance", 100).alias("distance_cm"), u("radius", 100).alias("radius_cm"), u("development", 100).alias("development_cm"), u("central_angle", 3600).alias("central_s"), "neighbour", F.col("to_idx").cast("long").alias("to_idx"))


def context_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the suppliers' pages say of their parcels; half of them have a northing besides."""
    pages = text_pages(spark, sf_dir)
    northings = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("document"), F.lit(7394000.0).alias("northing"))
    c = context.contexts(settled(context.matches(pages)), northings)
    u = lambda x, k: F.floor(F.col(x) * k + 0.5).cast("long")
    return c.select("document", "convention", "family", F.col("zone").cast("long").alias("zone"), "hemisphere", F.col("epsg").cast("long").alias("epsg"), u("area", 10000).alias("area_u"), u("area_hw", 1e6).alias("area_hw_u"), "area_confidence", F.size("area_rivals").cast("long").alias("area_rivals"), u("perimeter", 100).alias("perimeter_cm"), "perimeter_confidence", "registration", "registration_confidence")


def area_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = text_pages(spark, sf_dir)
    found = settled(context.matches(pages))
    cited = extraction.citations(context.measures(found, context.conventions(found)))
    return cited.select("document", "field", F.col("ordinal").cast("long").alias("ordinal"), F.floor(F.col("value") * 10000 + 0.5).cast("long").alias("value_u"), "confidence")


def word_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of words with two tables among prose, of as many rows as the supplier's key tells."""
    k = F.col("s_suppkey")
    data = lambda n: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.array(F.concat(F.lit("P"), i.cast("string")), F.lit("7.394.250,12"), F.lit("333.123,45")))
    fixed = lambda *rows: F.array(*[F.array(*map(F.lit, r)) for r in rows])
    rows = F.concat(fixed(["texto", "corrido"], ["Vértice", "Norte", "Este"]), data(k % 4 + 1), fixed(["mais", "texto"], ["Azimute", "Distância"], ["Coordenada", "N", "Coordenada", "E"]), data(k % 3 + 1), fixed(["Total", "12"], ["fim"]))
    words = table(spark, sf_dir, "supplier").select(k.alias("document"), F.posexplode(rows).alias("row", "tokens"))
    return extraction.table_bands(words, ["document"]).select("document", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


def content_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.addressed(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


def observation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vertices_a(spark, sf_dir).withColumn("code", F.when(F.col("idx") != 2, F.col("code")))
    w = store.from_observations(store.to_observations(v, "pair"), "pair")
    return w.select("pair", "idx", "code", F.floor(F.col("e") * 1000 + 0.5).cast("long").alias("e_mm"), F.floor(F.col("n") * 1000 + 0.5).cast("long").alias("n_mm"))


def corrected_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = store.to_observations(vertices_a(spark, sf_dir), "pair").filter("field = 'easting'").withColumn("confidence", F.lit(0.7))
    edits = vertices_a(spark, sf_dir).filter("pair % 10 = 0 AND idx = 1")
    edits = edits.select("pair", (F.col("idx") * 3 + 1).alias("ordinal"), F.explode(F.array(*[F.struct(F.lit(k).alias("at"), (F.col("e") + k).alias("value_num"), F.lit(f"u{k}").alias("by")) for k in (1, 2)])).alias("x")).select("pair", "ordinal", "x.*")
    c = store.corrected(o, edits, "pair")
    return c.select("pair", "idx", F.floor(F.col("value_num") * 1000 + 0.5).cast("long").alias("value_mm"), "edited", "confidence", F.coalesce("edited_by", F.lit("—")).alias("edited_by"))


def tax_id_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents a nation: customers' numbers in A, and in B those of keys not divisible by seven; weak where divisible by eleven."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("pair"), F.col("c_custkey").cast("string").alias("digits"), F.when(F.col("c_custkey") % 11 == 0, 0.55).otherwise(1.0).alias("confidence"), F.col("c_custkey").alias("k"))
    rows = c.withColumn("role", F.lit("A")).unionByName(c.filter("k % 7 <> 0 OR pair = 3").withColumn("role", F.lit("B"))).withColumn("ordinal", F.col("k"))
    return rules.tax_ids_between(rows.drop("k")).select("pair", "rule", "severity", "subject", "scope")


def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.depth(table(spark, sf_dir, "events"), ["click", "view", "purchase", "refund_missing"], "event_type")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(k.alias("job"), F.get(F.array(*map(F.lit, queue.STATES)), (k % 4).cast("int")).alias("status"), F.col("ts").alias("run_at"), (k % 4).cast("int").alias("attempts"), F.col("ts").alias("locked_at"), (k % 3 != 0).alias("ok"))


def due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.due(_jobs(spark, sf_dir), F.lit("2024-01-03 00:00:00").cast("timestamp"), 50).select("job", "status")


def jobs_after_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return queue.after_run(_jobs(spark, sf_dir), now).select("job", "status", "attempts", (F.col("run_at") > now).alias("later"))


def released_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.release_stale(_jobs(spark, sf_dir), F.lit("2030-01-01 00:00:00").cast("timestamp")).select("job", "status", F.col("locked_at").isNull().alias("free"))


def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.newest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 50, 20).select("o_orderkey")


QUERIES = {f.__name__: f for f in (parsed_numbers, parsed_angles, normalized_labels, normalized_codes, tax_numbers, utm_codes, page_triage, document_profiles, number_conventions, consensus_values, stitched_tables, word_grid, column_edges, nearest_columns, header_maps, late_headers, parcels_from_cells, context_fields, area_citations, word_bands, content_addresses, observation_round_trip, corrected_observations, tax_id_findings, queue_depth, due_jobs, jobs_after_run, released_jobs, history_page)}

_KIND = """CASE WHEN chars < 20 THEN CASE WHEN coverage >= 0.55 OR images > 0 THEN 'scanned' WHEN vectors >= 400 THEN 'vector_cad' ELSE 'empty' END
  WHEN chars <= 120 AND coverage >= 0.55 THEN 'hybrid' WHEN vectors >= 400 THEN 'vector_cad' ELSE 'digital' END"""
_PAGES = f"""pg AS (SELECT *, {_KIND} AS kind FROM (SELECT page_id // 5 AS document, page_id AS page, CASE WHEN page_id % 7 = 0 THEN 5 WHEN page_id % 7 = 1 THEN 90 ELSE length(html) END AS chars,
  page_id % 3 AS images, (page_id % 10) / 10 AS coverage, page_id % 11 * 60 AS vectors, CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END AS tables FROM pages)),
tri AS (SELECT *, kind IN ('scanned', 'hybrid') AS needs_ocr, relevance <> 'likely_drawing' AND kind <> 'empty' AS is_data FROM (
  SELECT *, CASE WHEN kind = 'empty' THEN 'unknown' WHEN tables > 0 OR chars > 400 THEN 'likely_data' WHEN vectors > 400 AND chars < 400 THEN 'likely_drawing' ELSE 'unknown' END AS relevance FROM pg))"""

_LAID = """w AS (SELECT *, CASE WHEN k = 0 THEN 950.0::DOUBLE ELSE k % 3 * 100.0::DOUBLE + CASE WHEN k % 7 = 0 THEN 8.0::DOUBLE ELSE 0 END + document % 4 END AS x0 FROM (
    SELECT document, text, CAST(nth // 60 + 1 AS INT) AS page, nth % 60 AS k FROM (
      SELECT doc_id AS document, unnest(regexp_split_to_array(text, '\\s+')) AS text, generate_subscripts(regexp_split_to_array(text, '\\s+'), 1) - 1 AS nth FROM documents))),
  n AS (SELECT document, page, count(DISTINCT k // 3) AS rows FROM w GROUP BY ALL),
  edge AS (SELECT w.document, w.page, avg(x0) AS boundary, count(*) AS support FROM w JOIN n ON w.document = n.document AND w.page = n.page GROUP BY w.document, w.page, CASE WHEN k = 0 THEN 9 ELSE k % 3 END, rows
    HAVING count(*) >= greatest(2, rows // 3))"""

SQL = {
    "parsed_numbers": """WITH c AS (SELECT DISTINCT CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents FROM lineitem)
        SELECT cents, 1 AS form, cents * 10 AS value_m, 2 AS decimals FROM c UNION ALL SELECT cents, 2, cents * 10, 2 FROM c
        UNION ALL SELECT cents, 3, -(cents % 1000 * 1000 + 125) * 1000, 0 FROM c UNION ALL SELECT cents, 4, -(cents % 1000 * 1000 + 125), 3 FROM c""",
    "parsed_angles": """WITH p AS (SELECT p_partkey AS k, p_partkey % 90 + (p_partkey % 60) / 60 + (p_partkey % 59 + 0.5::DOUBLE) / 3600 AS d FROM part)
        SELECT k, CAST(floor(d * 1e7 + 0.5) AS BIGINT) AS degrees_u, 1 AS precision_u,
          CAST(floor(CASE k % 4 WHEN 0 THEN d WHEN 1 THEN 180 - d WHEN 2 THEN 180 + d ELSE d END * 1e7 + 0.5) AS BIGINT) AS azimuth_u,
          printf('%d°%02d''%02d,%02d"', h // 360000, h // 6000 % 60, h // 100 % 60, h % 100) AS shown,
          CASE WHEN b <= 90 THEN 'NE' WHEN b <= 180 THEN 'SE' WHEN b <= 270 THEN 'SW' ELSE 'NW' END AS quadrant,
          CASE WHEN (540 - 2 * k % 360) % 360 = 0 THEN 180000 ELSE ((540 - 2 * k % 360) % 360 - 180) * 1000 END AS difference_u
        FROM (SELECT *, k * 4500 AS h, (k * 0.37::DOUBLE) % 360 AS b FROM p)""",
    "normalized_labels": r"""SELECT doc_id, CAST(i - 1 AS INT) AS line, trim(regexp_replace(regexp_replace(lower(strip_accents(raw)), '[.\-_/\\|()\[\]:;,]+', ' ', 'g'), '\s+', ' ', 'g')) AS label
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""",
    "normalized_codes": "SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'V' WHEN 1 THEN 'BRSPM' ELSE '' END || p_partkey AS code FROM part",
    "tax_numbers": """WITH n AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS nine FROM customer),
        a AS (SELECT *, list_sum([CAST(nine[i] AS INT) * (11 - i) for i in range(1, 10)]) % 11 AS r FROM n), b AS (SELECT *, nine || CASE WHEN r < 2 THEN 0 ELSE 11 - r END AS ten FROM a),
        c AS (SELECT *, list_sum([CAST(ten[i] AS INT) * (12 - i) for i in range(1, 11)]) % 11 AS s FROM b), d AS (SELECT *, CASE WHEN s < 2 THEN 0 ELSE 11 - s END AS d2 FROM c),
        e AS (SELECT c_custkey, ten || CASE WHEN c_custkey % 5 = 0 THEN (d2 + 1) % 10 ELSE d2 END AS digits FROM d)
        SELECT c_custkey, digits, c_custkey % 5 <> 0 AS valid, digits[1:3] || '.' || digits[4:6] || '.' || digits[7:9] || '-' || digits[10:11] AS shown FROM e""",
    "utm_codes": """WITH s AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'SIRGAS2000' WHEN 1 THEN 'SAD69' WHEN 2 THEN 'CORREGO_ALEGRE' ELSE 'WGS84' END AS family, s_suppkey % 61 AS zone, s_suppkey % 3 = 0 AS north FROM supplier)
        SELECT k, family, CASE WHEN family = 'SIRGAS2000' AND NOT north AND zone BETWEEN 17 AND 25 THEN 31960 + zone WHEN family = 'SIRGAS2000' AND north AND zone BETWEEN 11 AND 22 THEN 31954 + zone
          WHEN family = 'SAD69' AND NOT north AND zone BETWEEN 18 AND 25 THEN 29170 + zone WHEN family = 'CORREGO_ALEGRE' AND NOT north AND zone BETWEEN 21 AND 25 THEN 22500 + zone
          WHEN family = 'WGS84' AND zone BETWEEN 1 AND 60 THEN CASE WHEN north THEN 32600 ELSE 32700 END + zone END AS epsg, zone * 6 - 183 AS meridian, CAST(floor((zone + 120) / 6) + 1 AS BIGINT) AS zone_of,
          CASE WHEN zone * 200000 BETWEEN 5000000 AND 10000000 THEN 'S' WHEN zone * 200000 BETWEEN 0 AND 1500000 THEN 'N' END AS side FROM s""",
    "page_triage": f"WITH {_PAGES} SELECT page, kind, relevance, needs_ocr, is_data FROM tri",
    "document_profiles": f"""WITH {_PAGES}, k AS (SELECT document, kind, count(*) AS n, min(page) AS f FROM tri GROUP BY ALL)
        SELECT t.document, count(*) AS pages, bool_or(needs_ocr) AS needs_ocr, count(*) FILTER (WHERE is_data) AS data_pages, any_value(dominant) AS dominant
        FROM tri t JOIN (SELECT document, arg_max(kind, (n, -f)) AS dominant FROM k GROUP BY document) d ON t.document = d.document GROUP BY t.document""",
    "number_conventions": """WITH v AS (SELECT l_orderkey AS document, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS pos, CASE l_orderkey % 4 WHEN 0 THEN 'us' WHEN 1 THEN 'br' WHEN 3 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'us' ELSE 'br' END END AS vote FROM lineitem),
        n AS (SELECT document, vote, count(*) AS n, min(pos) AS f FROM v WHERE vote IS NOT NULL GROUP BY ALL)
        SELECT o.document, coalesce(convention, 'ambiguous') AS convention FROM (SELECT DISTINCT l_orderkey AS document FROM lineitem) o LEFT JOIN (SELECT document, arg_max(vote, (n, -f)) AS convention FROM n GROUP BY document) c ON o.document = c.document""",
    "consensus_values": """WITH n AS (SELECT l_suppkey AS document, l_quantity AS value, count(*) AS n, min(l_orderkey * 100 + l_linenumber) AS f FROM lineitem GROUP BY ALL)
        SELECT document, arg_max(value, (n, -f, -value)) AS value, CASE WHEN count(*) = 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence, CAST(count(*) - 1 AS INT) AS rivals FROM n GROUP BY document""",
    "stitched_tables": """WITH p AS (SELECT o_custkey AS document, o_orderkey % 20 + 3 AS rows, o_orderkey % 5 = 0 AS has_header, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
        q AS (SELECT *, k // 3 AS columns, k + CASE WHEN k > 6 THEN 1 ELSE 0 END AS page FROM p),
        m AS (SELECT *, CASE WHEN page = lag(page) OVER w + 1 AND columns = lag(columns) OVER w AND NOT has_header THEN 0 ELSE 1 END AS starts FROM q WINDOW w AS (PARTITION BY document ORDER BY page)),
        i AS (SELECT *, sum(starts) OVER (PARTITION BY document ORDER BY page) AS island FROM m)
        SELECT document, page, island, coalesce(sum(rows) OVER (PARTITION BY document, island ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS row_offset FROM i""",
    # on a page of n words, a column of c has an edge if it is met twice and in a third of the rows; the far word has none
    "word_grid": f"""WITH {_LAID}
        SELECT document, page, k // 3 AS row, (SELECT count(*) FROM edge e WHERE e.document = w.document AND e.page = w.page AND e.boundary < (SELECT arg_min(f.boundary, (abs(f.boundary - w.x0), f.boundary)) FROM edge f WHERE f.document = w.document AND f.page = w.page AND f.boundary <= w.x0 + 12)) AS column, text
        FROM w WHERE (document, page) IN (SELECT (document, page) FROM edge)""",
    "column_edges": f"WITH {_LAID} SELECT document, page, CAST(floor(boundary * 1000 + 0.5) AS BIGINT) AS boundary_m, support FROM edge",
    "nearest_columns": """SELECT p_partkey AS document, CASE WHEN p_partkey % 60 <= 5 THEN 0 WHEN p_partkey % 60 <= 14 THEN 1 WHEN p_partkey % 60 < 29 THEN 2 WHEN p_partkey % 60 = 29 THEN 2 WHEN p_partkey % 60 <= 45 THEN 3 ELSE 4 END AS column FROM part""",
    "header_maps": f"""WITH {VA}, d AS (SELECT DISTINCT pair FROM va), f AS (SELECT * FROM (VALUES ('vertex_code', 0), ('northing', 1), ('easting', 2), ('azimuth', 3), ('distance', 4), ('interior_angle', 5), ('confrontant', 6)) t(field, c))
        SELECT pair AS document, CASE pair % 3 WHEN 0 THEN 0 ELSE 2 END AS row, pair % 3 = 1 AS two_rows, 7 AS fields, 1000 AS confidence_m, pair % 3 = 1 AS code_is_pair, true AS has_coordinates, field, CASE pair % 3 WHEN 2 THEN 6 - c ELSE c END AS column FROM d, f""",
    "late_headers": "SELECT s_suppkey AS document, 1 AS row, 'azimuth,vertex_code' AS fields, false AS has_coordinates FROM supplier",
    "parcels_from_cells": f"""WITH {VA}, {SIDES} SELECT pair AS document, idx, code, CAST(floor(e * 1000 + 0.5) AS BIGINT) AS e_mm, CAST(floor(n * 1000 + 0.5) AS BIGINT) AS n_mm, CASE WHEN pair % 4 = 3 THEN 'trailing' ELSE 'leading' END AS convention,
        CAST(floor(azimuth * 3600 + 0.5) AS BIGINT) % 1296000 AS azimuth_s, CASE WHEN NOT arc THEN CAST(floor(length * 100 + 0.5) AS BIGINT) END AS distance_cm, CASE WHEN arc THEN 750 END AS radius_cm, CASE WHEN arc THEN 910 END AS development_cm, CASE WHEN arc THEN 250272 END AS central_s,
        'Lote ' || idx AS neighbour, (idx + 1) % size AS to_idx FROM (SELECT *, pair % 5 = 2 AND idx = 1 AS arc FROM sa)""",
    "context_fields": """WITH s AS (SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'SIRGAS2000' WHEN 1 THEN 'WGS84' WHEN 2 THEN 'SAD69' WHEN 3 THEN 'CORREGO_ALEGRE' END AS family, CASE WHEN s_suppkey % 3 = 2 THEN 23 ELSE 22 END AS zone,
          CASE WHEN s_suppkey % 3 <> 1 OR s_suppkey % 2 = 0 THEN 'S' END AS hemisphere, s_suppkey % 4 = 0 AS ha FROM supplier)
        SELECT k AS document, CASE WHEN k % 7 = 6 THEN 'us' ELSE 'br' END AS convention, family, zone, hemisphere,
          CASE WHEN hemisphere IS NULL THEN CASE family WHEN 'SIRGAS2000' THEN 4674 WHEN 'WGS84' THEN 4326 WHEN 'SAD69' THEN 4618 WHEN 'CORREGO_ALEGRE' THEN 4225 END
            ELSE CASE family WHEN 'SIRGAS2000' THEN 31960 WHEN 'WGS84' THEN 32700 WHEN 'SAD69' THEN 29170 WHEN 'CORREGO_ALEGRE' THEN 22500 END + zone END AS epsg,
          CASE WHEN ha THEN (120000 + k % 1000) * 10000 ELSE (100050 + k % 1000 * 100) * 100 END AS area_u, CASE WHEN ha THEN 500000 ELSE 5000 END AS area_hw_u, CASE WHEN k % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS area_confidence, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS area_rivals,
          45678 + k AS perimeter_cm, 1.0::DOUBLE AS perimeter_confidence, CAST(10000 + k AS VARCHAR) AS registration, CASE WHEN k % 6 = 5 THEN 0.5 ELSE 1.0 END::DOUBLE AS registration_confidence FROM s""",
    "area_citations": """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN (120000 + s_suppkey % 1000) * 10000 ELSE (100050 + s_suppkey % 1000 * 100) * 100 END AS a FROM supplier)
        SELECT k AS document, 'area' AS field, 1 AS ordinal, a AS value_u, 1.0::DOUBLE AS confidence FROM s UNION ALL SELECT k, 'area', 2, 7777700, 0.5 FROM s WHERE k % 3 = 0 UNION ALL SELECT k, 'perimeter', 1, (45678 + k) * 100, 1.0 FROM s""",
    "word_bands": """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 + 1 AS a, s_suppkey % 3 + 1 AS b FROM supplier)
        SELECT k AS document, 1 AS first, 1 + a AS last FROM s WHERE a >= 2 UNION ALL SELECT k, 3 + a, 5 + a + b FROM s""",
    "content_addresses": "SELECT sha256(text) AS sha256, min(doc_id) AS first, count(*) AS copies, 'blobs/' || substr(sha256(text), 1, 2) || '/' || sha256(text) AS blob_path FROM documents GROUP BY sha256(text)",
    "observation_round_trip": f"WITH {VA} SELECT pair, idx, CASE WHEN idx = 2 THEN '#3' ELSE code END AS code, CAST(floor(e * 1000 + 0.5) AS BIGINT) AS e_mm, CAST(floor(n * 1000 + 0.5) AS BIGINT) AS n_mm FROM va",
    "corrected_observations": f"""WITH {VA} SELECT pair, idx, CAST(floor((e + CASE WHEN hit THEN 2 ELSE 0 END) * 1000 + 0.5) AS BIGINT) AS value_mm, hit AS edited, CASE WHEN hit THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence,
        CASE WHEN hit THEN 'u2' ELSE '—' END AS edited_by FROM (SELECT *, pair % 10 = 0 AND idx = 1 AS hit FROM va)""",
    "tax_id_findings": """WITH c AS (SELECT c_nationkey AS pair, c_custkey AS k, c_custkey % 7 <> 0 OR c_nationkey = 3 AS b FROM customer)
        SELECT pair, 'R26' AS rule, 'info' AS severity, 'tax ids' AS subject, 'AB' AS scope FROM c GROUP BY pair HAVING bool_and(b)
        UNION ALL SELECT pair, 'R27', 'error', CAST(k AS VARCHAR), 'A' FROM c WHERE NOT b UNION ALL SELECT pair, 'R28', 'warning', CAST(k AS VARCHAR), 'A' FROM c WHERE k % 11 = 0
        UNION ALL SELECT pair, 'R28', 'warning', CAST(k AS VARCHAR), 'B' FROM c WHERE k % 11 = 0 AND b""",
    "queue_depth": "SELECT t AS event_type, count(event_id) AS jobs FROM (SELECT unnest(['click', 'view', 'purchase', 'refund_missing']) AS t) LEFT JOIN events ON event_type = t GROUP BY t",
    "due_jobs": "SELECT event_id AS job, 'queued' AS status FROM (SELECT * FROM events WHERE event_id % 4 = 0 AND ts <= TIMESTAMP '2024-01-03 00:00:00' ORDER BY ts, event_id LIMIT 50)",
    "jobs_after_run": "SELECT event_id AS job, CASE WHEN event_id % 3 <> 0 THEN 'done' WHEN event_id % 4 + 1 < 3 THEN 'queued' ELSE 'failed' END AS status, CAST(event_id % 4 + 1 AS INT) AS attempts, event_id % 3 = 0 AND event_id % 4 + 1 < 3 AS later FROM events",
    "released_jobs": "SELECT event_id AS job, CASE event_id % 4 WHEN 1 THEN 'queued' WHEN 0 THEN 'queued' WHEN 2 THEN 'done' ELSE 'failed' END AS status, event_id % 4 = 1 AS free FROM events",
    "history_page": "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20",
}
