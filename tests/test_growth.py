"""What keeps queries from growing faster than their input."""

import re

from pyspark.sql import functions as F

from parcelwise.functions import angles, numbers
from parcelwise.functions.let import exploded
from parcelwise.functions.text import normalize_label
from parcelwise.operators import context, extraction, matching, parcels, rules
from parcelwise.queries import details, documents, extractions, pipeline, survey, tables
from parcelwise.sources import relational


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_elements_of_a_computed_array_are_computed_once(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "k int, text string")
    made = rows.withColumn("upper", F.upper("text")).select("k", F.transform(F.split("upper", " "), lambda x: F.concat(x, F.col("upper"))).alias("all"))
    assert optimized(made.select("k", F.explode("all"))).count("upper(") > 1
    got = exploded(made, ["k"], F.col("all"), position="at")
    assert optimized(got).count("upper(") == 1
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, "AA B"), (1, 1, "BA B"), (3, 0, "CC")]


def test_company_numbers_are_made_once(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    assert optimized(details.company_numbers(spark, str(tmp_path))).count("104729") == 1


def test_rows_of_data_are_told_without_their_labels(spark):
    rows = [["P-01", "7.394.250,12", "333.123,45"], ["Vértice", "Norte", "Este"], ["sem", "número"], ["COORD.", "N", "Azimute"], ["n", "1"], ["Total", "12"], ["12,.5", "345"], ["− 1 234", "x987,"], []]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, tokens array<string>")
    got = df.select("k", extraction.row_fields(F.col("tokens")).alias("fields"), extraction.is_data_row(F.col("tokens")).alias("data")).orderBy("k").collect()
    assert [sorted(r.fields) for r in got] == [[], ["easting", "northing", "vertex_code"], [], ["azimuth", "northing"], ["northing"], [], [], [], []]
    assert [r.data for r in got] == [True, False, False, False, False, True, True, True, False]


def test_lines_of_words_are_folded_once(spark):
    words = spark.createDataFrame([(1, 1, 0.0, 1.0, "a"), (1, 1, 9.0, 2.0, "b"), (1, 1, 0.0, 20.0, "c")], "document int, page int, x0 double, top double, text string")
    got = extraction.cluster_rows(words)
    assert optimized(got).count("aggregate(") == 1
    assert sorted((r.text, r.row) for r in got.collect()) == [("a", 0), ("b", 0), ("c", 1)]


def test_votes_are_those_of_all_matches(spark):
    pages = spark.createDataFrame([(1, 1, "Área de 1.234,50 m² e 12,5 ou 1,234.50"), (1, 2, None), (2, 1, "sem número")], "document int, page int, text string")
    rows = lambda df: sorted(tuple(r) for r in df.select("document", "page", "k", F.coalesce("raw", F.lit("")), "n").collect())
    assert rows(context.votes(pages)) == rows(context.matches(pages).filter("field = 'vote'"))
    assert "matr" not in optimized(context.votes(pages))


def test_tax_numbers_are_made_once(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    assert optimized(documents.tax_numbers(spark, str(tmp_path))).count("7919") == 1


def test_rules_read_their_rows_once(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 0.0)], "pair long, a double").withColumn("root", F.sqrt("a"))
    found = rules.emit(rows, (F.col("root") > 1, rules.finding("R6", "internal", "warning", "distance", F.lit("1"), a=F.col("root"))))
    assert optimized(found).lower().count("sqrt(") == 1
    assert [(r.pair, r.rule) for r in found.collect()] == [(1, "R6")]


def test_cells_of_printed_tables_come_from_one_pass(spark):
    got = tables.table_cells(spark, "/root/testdata/sf0.001")
    assert optimized(got).count("Relation [") == 1


def test_rows_are_read_once_into_vertices(spark):
    """No filter reads the numbers again below the projection that reads them, and whole rings and others share one branch."""
    cells = spark.createDataFrame([(1, r, c, t) for r, row in enumerate([["Vértice", "N", "E"], ["P1", "10,5", "20"], ["x", "", ""], ["P2", "11", "21,25"], ["P3", "12", "20"]]) for c, t in enumerate(row)], "document int, row int, column int, text string")
    headers = spark.createDataFrame([(1, 0, {"vertex_code": 0, "northing": 1, "easting": 2}, False)], "document int, row int, columns map<string,int>, code_is_pair boolean")
    got = parcels.headed_parcels(cells, headers, spark.createDataFrame([(1, "br")], "document int, convention string"), ["document"])
    assert "Union" not in optimized(got)
    assert not [line for line in optimized(got).splitlines() if "Filter" in line and "\\d[" in line]
    assert [(r.idx, r.code, r.e, r.n, r.to_idx) for r in got.orderBy("idx").collect()] == [(0, "P1", 20.0, 10.5, 1), (1, "P2", 21.25, 11.0, 2), (2, "P3", 20.0, 12.0, 0)]


def test_what_stands_before_a_registration_needs_no_look_behind(spark):
    long_ = "x" * 200
    texts = ["matrícula nº 123", "Matricula 1.234-5, MATRÍCULA 777; e ainda matr\u00edcula nº 999", f"{long_} imóvel, matrícula 123/4 {long_}\n matricula 555", "sem", None, "é" * 89 + "matrícula 1000", "é" * 95 + "matrícula 1000" + "matrícula 100" * 12]
    pages = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "document int, page int, text string")
    got = context.matches(pages).filter("field = 'registration'")
    plan = optimized(context.matches(pages))
    assert "(?<=" not in plan
    want = [(k, n, m.group(1), t[max(0, m.start() - 90) : m.start()]) for k, t in enumerate(texts) for n, m in enumerate(re.finditer(f"(?i){context.REGISTRATION}", t or ""))]
    assert len(want) == 20 and sorted((r.document, r.k, r.raw, r.extra) for r in got.collect()) == want


def test_plain_numbers_and_angles_are_read_as_others_are(spark):
    """With a blank in front a text is none of the plain ones, and says the same."""
    texts = ["7", "0012", "123,45", "1.234,5", "333.123,450", "12,345", "1234,5678", "1.2,3", "12.345", "7.394.250,12", "1234567890123456", "1,", ",5", "-3,5", "10°00'00\"", "7°5'9\"", "359°59'59\"", "10°00'", None, ""]
    df = spark.createDataFrame([(k, t, None if t is None else f" {t}") for k, t in enumerate(texts)], "k int, text string, other string")
    for parse in (numbers.parse_number, angles.parse_angle):
        for convention in ("br", "us", "ambiguous"):
            rows = df.select("text", parse(F.col("text"), convention).alias("a"), parse(F.col("other"), convention).alias("b")).collect()
            assert [r.a for r in rows] == [r.b for r in rows] and sum(r.a is not None for r in rows) > 10


def test_rows_are_gathered_before_they_meet_their_header(spark):
    """Cells are not joined with headers one by one, and rows that can't be footers get no label."""
    cells = spark.createDataFrame([(1, r, c, t) for r, row in enumerate([["Vértice", "N", "E"], ["P1", "10,5", "20"], ["P2", "", " "], ["TOTAL", "11", "21,25"], ["(Área)", "12", "20"], ["T-1", "13", "20"]]) for c, t in enumerate(row)] + [(1, 1, 1, "10,7")], "document int, row int, column int, text string")
    headers = spark.createDataFrame([(1, 0, {"vertex_code": 0, "northing": 1, "easting": 2}, False)], "document int, row int, columns map<string,int>, code_is_pair boolean")
    rows = parcels.field_rows(cells, headers, ["document"])
    plan = optimized(rows)
    assert plan.index("Join") < plan.index("Aggregate") and "max(CASE" not in plan
    assert [(r.row, r.joined, r.vertex_code, r.northing, r.easting, r.azimuth) for r in rows.orderBy("row").collect()][:2] == [(1, "P1 10,5 10,7 20", "P1", "10,7", "20", None), (2, "P2   ", "P2", None, None, None)]
    known = rows.withColumn("convention", F.lit("br"))
    assert sorted(r.code for r in parcels.vertex_rows(known, ["document"]).collect()) == ["P1", "T-1"]
    texts = ["total", " (Total", "..ÁREA", "\u00e1rea", "a\u0301rea", "S\u00f3ma", "\u2460", "Perímetro", "Fe", "t", "", "P-01", "12,5", "Lote", "to", "p 1", "x", "_Tx"]
    told = spark.createDataFrame([(t,) for t in texts], "t string").select("t", extraction.begins_as_footer(F.col("t")).alias("may"), extraction.is_footer(normalize_label(F.col("t"))).alias("is")).collect()
    assert all(r.may for r in told if r["is"]) and [r.t for r in told if not r.may] == ["P-01", "12,5", "Lote", "p 1", "x", "_Tx"] and sum(r["is"] for r in told) == 7


def test_conventions_print_no_tables(spark):
    """Tables are printed for headers and for rows, and not a third time."""
    assert optimized(documents.parcels_from_cells(spark, "/root/testdata/sf0.001")).count("MEMORIAL") == 2


def test_headers_read_with_numbers_below_them_are_one_text(spark, monkeypatch):
    monkeypatch.setattr(extraction, "BROADCAST_BYTES", 200)
    texts = [f"Azimute {k}°{k % 7}'" for k in range(40)] + ["Norte 7.394.250,12", "12,5", "N", "Vértice Vértice 3", "de 2", None]
    cells = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "document int, column int, text string")
    got = extraction.header_fields(cells, ["document"])
    assert "strategy=broadcast" in optimized(got)
    rows = got.orderBy("document").collect()
    assert [r.text for r in rows] == texts and [r.field for r in rows] == ["azimuth"] * 40 + ["northing", None, "northing", "vertex_code", None, None]


def ring(spark, *codes):
    return spark.createDataFrame([(1, k, c, 10.0 * k, float(k * k)) for k, c in enumerate(codes)], "pair long, idx int, code string, e double, n double")


def test_a_pair_goes_through_all_methods_as_one_row(spark):
    a, b = ring(spark, "P-1", "P-2", "P-3", "P-4", "P-4"), ring(spark, "P-1", "P-2", "P-3", "Q-1", None)
    got = matching.match_vertices(a, b)
    assert "Join" not in optimized(got)
    rows = sorted((r.idx_a, r.idx_b, r.method, r.residual, r.turn) for r in got.collect())
    assert rows == [(k, k, "code" if k < 3 else "code+geometric", 0.0, None) for k in range(5)]


def test_codes_are_grouped_in_a_hash_table(spark):
    got = matching.match_by_code(ring(spark, "P-1", "P-2", "P-2"), ring(spark, "P-02", "P-1", "P-3"))
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.idx_a, r.idx_b, r.ea, r.na, r.eb, r.nb) for r in got.collect()) == [(0, 1, 0.0, 0.0, 10.0, 1.0), (1, 0, 10.0, 1.0, 0.0, 0.0)]


def test_vertices_without_partner_are_told_without_a_join(spark):
    assert "Join" not in optimized(survey.unmatched_vertices(spark, "/root/testdata/sf0.001"))
    rows = matching.with_partners(ring(spark, "P-1", "P-1", "P-2", None), ring(spark, "P-3", "P-2", "P-2", "P-01")).collect()
    assert sorted((r.side, r.idx) for r in rows if r.matched) == [("a", 0), ("b", 3)]
    assert [(r.idx_b, r.eb, r.nb) for r in rows if r.matched and r.side == "a"] == [(3, 30.0, 9.0)]


def test_geodesics_pass_over_steps_that_move_nothing(spark):
    got = pipeline.geodesic_ways(spark, "/root/testdata/sf0.001")
    assert "moved = 0.0" in optimized(got) and optimized(got).count("aggregate(") == 1


def test_pages_of_words_are_laid_out_as_one_row(spark):
    for made in (documents.word_grid, documents.column_edges):
        plan = optimized(made(spark, "/root/testdata/sf0.001"))
        assert "Join" not in plan and "Window" not in plan and plan.count("collect_list(") == 1
    rows = [(1, 1, x, top, t) for top, line in enumerate(["ab", "cd", "ef"]) for x, t in zip((0.0 + top, 50.0), line)] + [(1, 1, 900.0, 0.0, "z"), (2, 1, 5.0, 0.0, "q")]
    words = spark.createDataFrame([(d, p, x, 20.0 * top, t) for d, p, x, top, t in rows], "document int, page int, x0 double, top double, text string")
    by_rows = extraction.cluster_rows(words)
    want = extraction.assign_columns(by_rows, extraction.column_boundaries(by_rows))
    got = extraction.page_grid(words)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())) and got.count() == 7
    assert sorted(map(tuple, extraction.in_columns(by_rows).select(got.columns).collect())) == sorted(map(tuple, got.collect()))
    edges = extraction.page_edges(extraction.word_pages(words)).select("document", "page", F.inline("edges"))
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, extraction.column_boundaries(by_rows).select(edges.columns).collect()))


def test_a_store_has_buckets_by_its_rows(spark, monkeypatch):
    assert [relational.buckets_of(n) for n in (0, 32_000_000, 32_000_001)] == [8, 8, 9]
    given, save = [], relational.save
    monkeypatch.setattr(relational, "BUCKET_ROWS", 2000)
    monkeypatch.setattr(relational, "save", lambda tables, name, folder, buckets: (given.append((tables["observations"].count(), buckets)), save(tables, name, folder, buckets)))
    assert pipeline.analysis_overview(spark, "/root/testdata/sf0.001").count() > 0
    (rows, buckets), = given
    assert buckets == -(-rows // 2000) > 8


def test_stored_values_are_dealt_by_document_once(spark):
    """Only the source table is shuffled: neither the union of all values nor what is rebuilt from it."""
    plan = extractions.rebuilt_vertices(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan and all("document" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
