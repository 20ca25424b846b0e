"""Queries on single functions and on what stands around a comparison: tables, blobs, observations, queue, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.functions import angles, crs, numbers, text
from parcelwise.functions.let import exploded
from parcelwise.operators import extraction, rules
from parcelwise.plans import compare
from parcelwise.queries.tables import VA, table, vertices_a
from parcelwise.sources import store
from parcelwise.streaming import queue


def _units(x, k):
    return F.floor(x * k + 0.5).cast("long")


def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells cleaned, spaced letters joined, places told, values printed and their printed precision."""
    k = F.col("p_partkey")
    n = numbers.parse_number(numbers.format_br(k / 8, 3))
    return table(spark, sf_dir, "part").select(
        k.alias("k"),
        text.clean_cell(F.concat(F.lit("  a\n\tb  "), k.cast("string"), F.lit(" \n"))).alias("cell"),
        text.collapse_spaced_letters(F.when(k % 2 == 0, "A Z I M").when(k % 3 == 0, "A Z").otherwise("AZ I M")).alias("joined"),
        text.provenance_label(F.when(k % 5 > 0, k % 5), F.when(k % 2 == 0, k % 3), k % 7, F.when(k % 4 > 0, k % 4)).alias("place"),
        text.value_text(F.when(k % 9 > 0, k / 16)).alias("value"),
        numbers.format_br(k / 8, 3).alias("shown"), _units(n["halfwidth"], 1e6).alias("halfwidth_u"), numbers.decimals_of(n["halfwidth"]).cast("long").alias("decimals"),
    )


def company_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies' numbers from each customer's key with their check digits (one in five wrong), masked, beside a person's number that stands within and one that does not."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, F.lpad((k * 104729 % 1000000000000).cast("string"), 12, "0").alias("twelve"))
    rows = rows.withColumn("thirteen", F.concat("twelve", text._check_digit(F.col("twelve"), text.CNPJ_WEIGHTS[0]).cast("string")))
    rows = rows.withColumn("last", text._check_digit(F.col("thirteen"), text.CNPJ_WEIGHTS[1]))
    digits = F.concat("thirteen", F.when(k % 5 == 0, (F.col("last") + 1) % 10).otherwise(F.col("last")).cast("string"))
    rows = rows.withColumn("digits", digits)
    printed = rows.select("c_custkey", F.concat(F.lit("CNPJ "), text.mask_tax_id(F.col("digits")), F.lit(" e CPF "), F.substring("digits", 2, 11), F.lit("; CPF 111.111.111-11.")).alias("printed"))
    found = exploded(printed, ["c_custkey"], text.tax_ids(F.col("printed")))
    return found.select("c_custkey", "x.*").select("c_custkey", "digits", "valid", "confidence", text.mask_tax_id(F.col("digits")).alias("shown"))


def angle_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal degrees with and without a side, signs, degrees and minutes alone, and seconds of arc."""
    k = F.col("p_partkey")
    d = F.concat((k % 80).cast("string"), F.lit(","), F.lpad((k % 100).cast("string"), 2, "0"))
    raw = F.when(k % 4 == 0, d).when(k % 4 == 1, F.concat(d, F.lit(" S"))).when(k % 4 == 2, F.concat(F.lit("-"), (k % 80).cast("string"), F.lit("°"), (k % 60).cast("string"), F.lit("'"))).otherwise(F.concat((k % 80).cast("string"), F.lit("° "), (k % 60).cast("string"), F.lit("' "), (k % 59).cast("string"), F.lit("\" W")))
    rows = table(spark, sf_dir, "part").select(k.alias("k"), angles.parse_angle(raw).alias("a"))
    return rows.select("k", _units(F.col("a.degrees"), 1e7).alias("degrees_u"), _units(F.col("a.precision"), 100).alias("precision_u"), _units(angles.from_arcsec(angles.to_arcsec(F.col("k") / 7)), 1e6).alias("same_u"))


def covered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image coverage from areas, and what Brazil's box holds."""
    k = F.col("page_id")
    areas = F.array((k % 5 * 100.0), (k % 3 * -50.0), F.lit(20.0))
    return table(spark, sf_dir, "pages").select(k.alias("page"), _units(extraction.image_coverage(areas, F.lit(20.0), k % 40 + 10), 1e6).alias("coverage_u"), crs.within_brazil(-(k % 90).cast("double"), (k % 50 - 40).cast("double")).alias("in_brazil"))


def data_page_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells are read on data pages only, or on the single page of a document."""
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 3).cast("long").alias("document"), F.col("page_id").alias("page"), (F.col("page_id") % 4 != 1).alias("is_data"))
    return extraction.data_cells(pages.select("document", "page", F.lit("x").alias("text")), pages).select("document", "page")


def chosen_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a supplier's tables: large enough, once by their box, up to the first strategy that found coordinates, the best by score."""
    k = F.col("l_suppkey")
    t = table(spark, sf_dir, "lineitem").groupBy(k.alias("document"), F.col("l_linenumber").alias("index")).agg(F.count(F.lit(1)).alias("n"))
    i = F.col("index")
    t = t.select("document", F.lit(1).alias("page"), i.cast("int").alias("index"), (i % 3 * 10.2).alias("x0"), (i % 2 * 5.0).alias("top"), F.lit(100.0).alias("x1"), F.lit(200.0).alias("bottom"), (i + 1).alias("rows"), F.lit(4).alias("columns"), ((F.col("document") + i) % 4 == 0).alias("has_coordinates"), (i / 3).cast("int").alias("rank"), (F.col("document") * i % 5).alias("fields"))
    scored = extraction.first_success(extraction.distinct_tables(t)).withColumn("score", F.col("fields") + F.col("rows") / 100 + F.when(F.col("has_coordinates"), 10.0).otherwise(0.0))
    return extraction.best_table(scored).select("document", F.col("index").cast("long").alias("index"), _units(F.col("score"), 100).alias("score_c"))


def word_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber")
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), (k * 10.0).alias("x0"), (k * 3.0).alias("top"), (k * 10.0 + F.col("l_quantity")).alias("x1"), (k * 3.0 + 2).alias("bottom"))
    return extraction.hull(boxes, ["document"], 3.0)


def continued_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose columns go on in magnitude: orders' lines after the first against the first ones."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("k"), (F.col("l_extendedprice") * 0.5).alias("value"))
    return extraction.magnitudes_agree(lines.filter("k <= 2").select("document", F.lit(1).alias("column"), "value"), lines.filter("k > 2").select("document", F.lit(1).alias("column"), "value"), ["document"])


def first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands first in a document, and the first table of each page."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("document"), F.lit("datum").alias("field"), F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"), F.col("l_partkey").alias("value"))
    return extraction.first_hits(v).select("document", "value")


def first_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("document"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("index"), "l_partkey")
    return store.kept_first(v, ["document", "page"], ["index", "l_partkey"]).select("document", "page", "index")


def blob_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose blob is missing or differs."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), F.sha2(F.concat(F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")), 256).alias("sha256"))
    blobs = docs.filter("document % 7 <> 0").select("sha256", F.when(F.col("document") % 11 == 0, "spoiled").otherwise(F.col("sha256")).alias("actual"))
    return store.verify_blobs(docs, blobs)


def parcel_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices, sides and totals to observations, in order, and back."""
    v = vertices_a(spark, sf_dir).withColumns({"distance": F.when(F.col("idx") != 1, F.col("n") / 100), "neighbour": F.concat(F.lit("Lote "), "idx"), "confidence": F.when(F.col("idx") % 2 == 0, 0.95).otherwise(0.7)})
    totals = v.groupBy("pair").agg(F.sum("e").alias("area"), F.max("confidence").alias("confidence"))
    long = store.parcel_observations(v, totals.withColumn("perimeter", F.lit(None).cast("double")).withColumn("registration", F.concat(F.lit("M"), "pair")), "pair")
    back = store.from_parcel_observations(long, "pair")
    return back.select("pair", "idx", "code", _units(F.col("e"), 1000).alias("e_mm"), _units(F.col("distance"), 100).alias("distance_cm"), "neighbour", F.col("vertices").cast("long").alias("vertices"), F.col("least_confidence").alias("least_confidence"), "registration", _units(F.col("area"), 10).alias("area_d"))


def ordered_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first observations by document and ordinal (a page of the review)."""
    long = store.to_observations(vertices_a(spark, sf_dir), "pair")
    return store.page_of(long, ["pair", "ordinal"], 100, 50).select("pair", F.col("ordinal").cast("long").alias("ordinal"), "field")


def enqueued_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    jobs = queue.enqueued(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.when(F.col("o_orderkey") % 2 == 0, "recompare").otherwise("compare").alias("kind"), (F.col("o_orderkey") % 90).cast("int").alias("delay")), now)
    return jobs.select("job", "status", "attempts", "max_attempts", F.unix_timestamp("run_at").alias("run_s"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), F.concat(F.lit("R"), (k % 30 + 1).cast("string")).alias("rule"), pick(rules.KINDS, k).alias("kind"), pick(rules.SEVERITIES, F.col("l_suppkey")).alias("severity"), F.lit("easting").alias("field"), F.concat(F.lit("P"), F.col("l_linenumber").cast("string")).alias("subject"), F.lit("AB").alias("scope"), F.col("l_quantity").alias("value_a"), F.lit(None).cast("double").alias("value_b"), F.lit(None).cast("double").alias("delta"))


def report_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair's findings by kind, kinds in the order of the report."""
    g = compare.grouped_report(_found(spark, sf_dir))
    return g.select("pair", "kind", F.col("kind_rank").cast("long").alias("kind_rank"), F.size("findings").cast("long").alias("findings"), F.get("findings", F.lit(0))["subject"].alias("first_subject"))


def severe_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a severity or worse."""
    return compare.at_least(_found(spark, sf_dir), "warning").groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))


def reviewed_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that hold a text in what was read, field or subject."""
    o = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text"), F.when(F.col("doc_id") % 9 == 0, "Perimeter").otherwise("easting").alias("field"), F.lit("P1").alias("subject"))
    return compare.review_filter(o, "PERI").select("doc_id")


def report_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses whose report can be made."""
    k = F.col("o_orderkey")
    return compare.ready(table(spark, sf_dir, "orders").select(k.alias("analysis"), F.get(F.array(*map(F.lit, ["pending", "extracting", "compared", "awaiting_review", "failed"])), (k % 5).cast("int")).alias("status"), F.when(k % 3 > 0, F.current_timestamp()).alias("compared_at"))).select("analysis")


QUERIES = {f.__name__: f for f in (cell_texts, company_numbers, angle_notations, covered_pages, data_page_cells, chosen_tables, word_hulls, continued_columns, first_values, first_tables, blob_problems, parcel_round_trip, ordered_observations, enqueued_jobs, report_groups, severe_findings, reviewed_observations, report_ready)}

SQL = {
    "cell_texts": """WITH p AS (SELECT p_partkey AS k, p_partkey * 125 AS m FROM part)
        SELECT k, 'a b ' || k AS cell, CASE WHEN k % 2 = 0 THEN 'AZIM' WHEN k % 3 = 0 THEN 'A Z' ELSE 'AZ I M' END AS joined,
          'p. ' || CASE WHEN k % 5 > 0 THEN CAST(k % 5 AS VARCHAR) ELSE '?' END || CASE WHEN k % 2 = 0 THEN ' · tabela ' || (k % 3 + 1) || ', linha ' || (k % 7 + 1) || ', col. ' || CASE WHEN k % 4 > 0 THEN CAST(k % 4 + 1 AS VARCHAR) ELSE '?' END ELSE '' END AS place,
          CASE WHEN k % 9 > 0 THEN regexp_replace(printf('%.6f', k / 16), '\\.?0+$', '') END AS value,
          CASE WHEN m >= 1000000 THEN (m // 1000000) || '.' || lpad(CAST(m // 1000 % 1000 AS VARCHAR), 3, '0') ELSE CAST(m // 1000 AS VARCHAR) END || ',' || lpad(CAST(m % 1000 AS VARCHAR), 3, '0') AS shown, 500 AS halfwidth_u, 3 AS decimals FROM p""",
    "company_numbers": """WITH n AS (SELECT c_custkey, lpad(CAST(c_custkey * 104729 % 1000000000000 AS VARCHAR), 12, '0') AS t FROM customer),
        a AS (SELECT *, list_sum([CAST(t[i] AS INT) * [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2][i] for i in range(1, 13)]) % 11 AS r FROM n), b AS (SELECT *, t || CASE WHEN r < 2 THEN 0 ELSE 11 - r END AS u FROM a),
        c AS (SELECT *, list_sum([CAST(u[i] AS INT) * [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2][i] for i in range(1, 14)]) % 11 AS s FROM b), d AS (SELECT *, CASE WHEN s < 2 THEN 0 ELSE 11 - s END AS z FROM c),
        e AS (SELECT c_custkey, u || CASE WHEN c_custkey % 5 = 0 THEN (z + 1) % 10 ELSE z END AS g FROM d)
        SELECT c_custkey, g AS digits, c_custkey % 5 <> 0 AS valid, CASE WHEN c_custkey % 5 <> 0 THEN 1.0 ELSE 0.55 END::DOUBLE AS confidence, g[1:2] || '.' || g[3:5] || '.' || g[6:8] || '/' || g[9:12] || '-' || g[13:14] AS shown FROM e
        UNION ALL SELECT c_custkey, '11111111111', false, 0.55, '111.111.111-11' FROM e""",
    "angle_notations": """WITH p AS (SELECT p_partkey AS k FROM part)
        SELECT k, CAST(floor(CASE k % 4 WHEN 0 THEN k % 80 + (k % 100) / 100 WHEN 1 THEN -(k % 80 + (k % 100) / 100) WHEN 2 THEN -(k % 80 + (k % 60) / 60) ELSE -(k % 80 + (k % 60) / 60 + (k % 59) / 3600) END * 1e7 + 0.5) AS BIGINT) AS degrees_u,
          CASE k % 4 WHEN 0 THEN 3600 WHEN 1 THEN 3600 WHEN 2 THEN 6000 ELSE 100 END AS precision_u, CAST(floor(k / 7 * 1e6 + 0.5) AS BIGINT) AS same_u FROM p""",
    "covered_pages": """SELECT page_id AS page, CAST(floor(least(1.0::DOUBLE, (page_id % 5 * 100 + page_id % 3 * 50 + 20) / (20.0::DOUBLE * (page_id % 40 + 10))) * 1e6 + 0.5) AS BIGINT) AS coverage_u, page_id % 90 BETWEEN 33 AND 74 AND page_id % 50 - 40 BETWEEN -34 AND 6 AS in_brazil FROM pages""",
    "data_page_cells": "WITH p AS (SELECT page_id // 3 AS document, page_id AS page, page_id % 4 <> 1 AS d, count(*) OVER (PARTITION BY page_id // 3) AS n FROM pages) SELECT document, page FROM p WHERE d OR n = 1",
    "chosen_tables": """WITH t AS (SELECT DISTINCT l_suppkey AS document, CAST(l_linenumber AS BIGINT) AS i FROM lineitem), large AS (SELECT *, (document + i) % 4 = 0 AS has, i // 3 AS r, document * i % 5 + (i + 1) / 100 + 10 AS score FROM t WHERE i + 1 >= 3),
        once AS (SELECT * FROM large QUALIFY row_number() OVER (PARTITION BY document, i % 3, i % 2 ORDER BY i) = 1), upto AS (SELECT * FROM once QUALIFY r <= min(r) FILTER (WHERE has) OVER (PARTITION BY document))
        SELECT document, i AS index, CAST(floor(score * 100 + 0.5) AS BIGINT) AS score_c FROM upto WHERE has QUALIFY row_number() OVER (PARTITION BY document ORDER BY score DESC, i) = 1""",
    "word_hulls": "SELECT l_orderkey AS document, min(l_linenumber * 10.0::DOUBLE) - 3 AS x0, min(l_linenumber * 3.0::DOUBLE) - 3 AS top, max(l_linenumber * 10.0::DOUBLE + l_quantity) + 3 AS x1, max(l_linenumber * 3.0::DOUBLE + 2) + 3 AS bottom FROM lineitem GROUP BY l_orderkey",
    "continued_columns": """WITH a AS (SELECT l_orderkey AS d, avg(l_extendedprice * 0.5::DOUBLE) AS m FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey), b AS (SELECT l_orderkey AS d, l_extendedprice * 0.5::DOUBLE AS v FROM lineitem WHERE l_linenumber > 2)
        SELECT a.d AS document FROM a JOIN b ON a.d = b.d GROUP BY a.d, m HAVING max(abs(v - m)) <= greatest(5000, 0.02 * greatest(abs(m), 1))""",
    "first_values": "SELECT l_suppkey AS document, arg_min(l_partkey, (l_orderkey, l_linenumber * 1000000 + l_partkey)) AS value FROM lineitem GROUP BY l_suppkey",
    "first_tables": "SELECT l_suppkey AS document, l_linenumber AS page, min(l_orderkey) AS index FROM lineitem GROUP BY ALL",
    "blob_problems": "SELECT doc_id AS document, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0",
    "parcel_round_trip": f"""WITH {VA}, t AS (SELECT pair, sum(e) AS area FROM va GROUP BY pair) SELECT v.pair, idx, code, CAST(floor(e * 1000 + 0.5) AS BIGINT) AS e_mm, CASE WHEN idx <> 1 THEN CAST(floor(n / 100 * 100 + 0.5) AS BIGINT) END AS distance_cm, 'Lote ' || idx AS neighbour,
        size AS vertices, 0.7::DOUBLE AS least_confidence, 'M' || v.pair AS registration, CAST(floor(area * 10 + 0.5) AS BIGINT) AS area_d FROM va v JOIN t ON v.pair = t.pair""",
    "ordered_observations": f"WITH {VA} SELECT pair, idx * 3 + k AS ordinal, ['vertex_code', 'easting', 'northing'][k + 1] AS field FROM va, (SELECT unnest([0, 1, 2]) AS k) ORDER BY pair, ordinal LIMIT 100 OFFSET 50",
    "enqueued_jobs": "SELECT o_orderkey AS job, 'queued' AS status, 0 AS attempts, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END AS max_attempts, CAST(epoch(TIMESTAMP '2024-01-01 00:00:00') AS BIGINT) + o_orderkey % 90 AS run_s FROM orders",
    "report_groups": """WITH f AS (SELECT l_orderkey AS pair, l_partkey % 6 AS k, l_suppkey % 3 AS s, 'P' || l_linenumber AS subject FROM lineitem)
        SELECT pair, ['systematic', 'data_gap', 'structural', 'inter_document', 'internal', 'low_confidence'][k + 1] AS kind, k AS kind_rank, count(*) AS findings, arg_min(subject, (s, subject)) AS first_subject FROM f GROUP BY pair, k""",
    "severe_findings": "SELECT ['error', 'warning'][l_suppkey % 3 + 1] AS severity, count(*) AS findings FROM lineitem WHERE l_suppkey % 3 < 2 GROUP BY ALL",
    "reviewed_observations": "SELECT doc_id FROM documents WHERE doc_id % 9 = 0 OR contains(lower(text), 'peri')",
    "report_ready": "SELECT o_orderkey AS analysis FROM orders WHERE o_orderkey % 5 >= 2 AND o_orderkey % 3 > 0",
}
