import pytest
from pyspark.sql import functions as F

from parcelwise.operators import extraction, matching
from parcelwise.plans import pipeline

HEAD = ["Vértice", "Norte", "Este", "Azimute", "Distância", "Confrontante"]
CELLS = "document long, page int, index int, row int, column int, text string"


def line(k, n=7_394_000.0, e=333_000.0, **other):
    show = lambda x: f"{x:,.2f}".translate(str.maketrans(",.", ".,"))
    row = [f"P-{k:02d}", show(n + 10 * k), show(e + 5 * k), "10°00'00\"", "11,18", f"Lote {k}"]
    return [other.get(h, x) for h, x in zip(("code", "n", "e", "az", "d", "next"), row)]


def cells_of(tables):
    """tables: (document, page, index) -> rows of texts."""
    return [(*at, r, c, text) for at, rows in tables.items() for r, texts in enumerate(rows) for c, text in enumerate(texts)]


def runs_of(spark, tables, conventions=()):
    cells = spark.createDataFrame(cells_of(tables), CELLS).cache()
    headers = extraction.map_headers(cells, pipeline.TABLE)
    told = spark.createDataFrame(list(conventions), "document long, convention string")
    runs = extraction.continuations(cells, pipeline.chosen_tables(cells, headers), headers, told)
    return cells, runs


def test_a_table_goes_on_page_after_page(spark):
    first = [HEAD, line(1), line(2), line(3)]
    tables = {
        (1, 1, 0): first, (1, 2, 0): [line(4), line(5)], (1, 3, 0): [line(6)], (1, 5, 0): [line(7)],
        (2, 1, 0): first, (2, 2, 0): [line(4, n=7_194_000.0)], (2, 3, 0): [line(5)],
        (3, 1, 0): first, (3, 2, 0): [line(4)[:5]], (3, 3, 0): [line(5)],
        (4, 2, 0): first, (4, 1, 0): [line(9)], (4, 3, 0): [HEAD, line(4)],
        (5, 1, 0): first, (5, 2, 0): [line(4, e=400_000.0)], (5, 2, 1): [line(4)], (5, 2, 2): [line(5)],
        (6, 1, 0): first, (6, 2, 0): [["P-04", "sem", "333.020,00", "", "", ""]],
        (7, 1, 0): [["a", "b"], ["c", "d"]],
        (8, 3, 1): first, (8, 3, 0): [line(8)], (8, 4, 0): [line(4)],
    }
    cells, runs = runs_of(spark, tables)
    got = {}
    for r in runs.collect():
        got.setdefault(r.document, []).append((r.page, r["index"], r.row_offset))
    assert {d: sorted(x) for d, x in got.items()} == {1: [(1, 0, 0), (2, 0, 4), (3, 0, 6)], 2: [(1, 0, 0)], 3: [(1, 0, 0)], 4: [(2, 0, 0)], 5: [(1, 0, 0), (2, 1, 4)], 6: [(1, 0, 0)], 8: [(3, 1, 0), (4, 0, 4)]}
    stitched = extraction.stitched_cells(cells, runs).filter("document = 1 AND column = 0").orderBy("row").collect()
    assert [(r.row, r.text, r.page, r.source_row) for r in stitched] == [(0, "Vértice", 1, 0), *[(k, f"P-{k:02d}", 1, k) for k in (1, 2, 3)], (4, "P-04", 2, 0), (5, "P-05", 2, 1), (6, "P-06", 3, 0)]


def test_magnitudes_are_read_by_the_convention(spark):
    us = lambda k, n: [f"P-{k}", f"{n + 10 * k:,.2f}", f"{333000 + 5 * k:,.2f}", "", "", ""]
    tables = {(d, p, 0): ([HEAD] if p == 1 else []) + [us(3 * p + k, 7394000) for k in range(3)] for d in (1, 2) for p in (1, 2)}
    _, runs = runs_of(spark, tables, [(1, "us")])
    assert sorted((r.document, r.page) for r in runs.collect())[:2] == [(1, 1), (1, 2)]


def test_boxes_half_a_point_apart_are_two_tables(spark):
    rows = [(1, 1, k, 10.0 + x, 20.0, 50.0, 60.0, 3, 2) for k, x in enumerate([0.0, 0.04, 0.5])] + [(1, 2, 0, 10.0, 20.0, 50.0, 60.0, 2, 2)]
    kept = extraction.distinct_tables(spark.createDataFrame(rows, "document int, page int, index int, x0 double, top double, x1 double, bottom double, rows int, columns int"))
    assert sorted((r.page, r["index"]) for r in kept.collect()) == [(1, 0), (1, 2)]


RING = [(0.0, 0.0), (100.0, 0.0), (130.0, 70.0), (40.0, 90.0)]


def ring(spark, rows):
    return spark.createDataFrame(rows, "pair long, idx int, code string, e double, n double")


def test_notes_tell_how_vertices_were_matched(spark):
    a, b = [], []
    for pair in range(5):
        for i, (e, n) in enumerate(RING):
            a.append((pair, i, f"P{i}", e, n))
            j = i
            code, x, y = f"P{i}", e, n
            if pair == 1 and i == 3:
                code = "Z9"
            if pair == 2:
                code, x = f"Q{i}", e + 1000.0
            if pair == 3:  # turned by a quarter about a point far away, with another start
                code, x, y, j = f"Q{i}", 5000.0 - 3 * n, 3 * e, (i + 1) % 4
            if pair == 4:
                code, x, y, j = f"Q{i}", 5000.0 - n, e, (i + 1) % 4
            b.append((pair, j, code, x, y))
    b += [(0, 4, "P0", 1.0, 1.0)]
    a_, b_ = ring(spark, a), ring(spark, b)
    notes = {}
    for r in matching.match_notes(a_, b_, matching.match_vertices(a_, b_)).collect():
        notes.setdefault(r.pair, []).append(r.note)
    assert notes[0][0].startswith("repeated codes: P") and notes[0][1] == "1 vertices without a common code matched by their place"
    assert notes[1] == ["1 vertices without a common code matched by their place"]
    assert notes[2] == ["codes cover 0 % of the vertices only: matched by geometry", "geometric matching after a mean shift of 1000.000 m"]
    assert notes[4][1] == "cyclic alignment: shift 1, same direction, mean error 0.000 m"
    bare = matching.match_notes(a_, b_, matching.match_by_code(a_, b_), placed=False).filter("pair = 1").collect()
    assert [r.note for r in bare] == ["no geometric matching: projected coordinates are missing"]


def test_documents_without_tables_or_partners(spark):
    text = "MEMORIAL DESCRITIVO do imóvel objeto da matrícula nº 12345. Datum: SIRGAS 2000; UTM 23S. Área de 10,00 m²."
    cells = spark.createDataFrame(cells_of({(1, 1, 0): [HEAD, line(1), line(2, e=333_900.0), line(3)], (2, 1, 0): [["a", "b"], ["c", None]]}), CELLS)
    pages = spark.createDataFrame([(1, 1, text), (2, 1, text), (3, 1, None), (4, 1, "")], "document long, page int, text string")
    documents = spark.createDataFrame([(1, 10, "A", False, None, "ocr"), (2, 10, "B", None, 700.0, None), (3, 11, "A", False, None, "x"), (4, 12, "B", True, None, "vision")], "document long, pair long, role string, ground boolean, height double, source string")
    got = pipeline.survey(cells, pages, documents).collect()
    rules = sorted({(r.pair, r.rule, r.scope) for r in got})
    assert (10, "R8", "A") in rules and (10, "R32", "A") in rules and not any(r.rule in ("R17", "R18") for r in got)
    assert {(p, s) for p, r, s in rules if r == "R1"} >= {(11, "A"), (12, "B")}


def test_empty_tables(spark):
    cells, pages = spark.createDataFrame([], CELLS), spark.createDataFrame([], "document long, page int, text string")
    documents = spark.createDataFrame([], "document long, pair long, role string, ground boolean, height double, source string")
    assert pipeline.survey(cells, pages, documents).count() == 0


WORDS = "document long, page int, x0 double, x1 double, top double, bottom double, text string"


def words_of(document, page, lines, top=0.0):
    """lines: rows of words, each at 120 points from the one before; a word may be (x0, text)."""
    out = []
    for k, line_ in enumerate(lines):
        for c, w in enumerate(line_):
            x0, text = w if isinstance(w, tuple) else (100.0 + 120 * c, w)
            out.append((document, page, x0, x0 + 30.0, top + 14.0 * k + (k + c) % 3, top + 14.0 * k + 10, text))
    return out


def test_pages_go_to_a_later_strategy_only_if_no_earlier_one_told_them(spark):
    head, data = ["Vértice", "Norte", "Este"], lambda k: [f"P{k}", f"7.394.{k:03d},00", f"333.{k:03d},00"]
    plain = [["Azimute", "Distância", "x"], ["100,000", "200,000", "a"], ["100,000", "300,000", "b"]]
    words = [
        *words_of(1, 1, [head, data(1), data(2), data(3)]),  # told by lines
        *words_of(1, 2, [*plain, ["prosa", "aqui"], head, data(1), data(2), ["mais", "prosa"], head, data(7), data(8)]),
        *words_of(2, 1, [head, ["folha", "1"], data(1), data(2)]),
        *words_of(3, 1, [["só"], ["uma"], ["palavra"], ["por", "linha"]]),
        *words_of(4, 1, [head, [(100.0, "P1"), (108.0, "b"), (221.0, "7.394.001,00"), (341.0, "333.001,00")], data(2), data(3)]),
    ]
    ruled = cells_of({(1, 1, 0): [head, data(1), data(2)], (2, 1, 3): [["a", "b"], ["c", "d"]]})
    got = {}
    for r in extraction.cells_from_words(spark.createDataFrame(words, WORDS), spark.createDataFrame(ruled, CELLS)).collect():
        got.setdefault((r.document, r.page, r["index"], r.strategy), {})[r.row, r.column] = r.text
    assert set(got) == {(1, 1, 0, "ruled"), (2, 1, 3, "ruled"), (1, 2, 90, "band"), (1, 2, 91, "band"), (2, 1, extraction.PAGE_INDEX, "page"), (4, 1, 90, "band")}
    assert [got[1, 2, 91, "band"][r, 0] for r in range(3)] == ["Vértice", "P1", "P2"]  # the band after it is not searched
    assert got[2, 1, extraction.PAGE_INDEX, "page"][1, 0] == "folha" and got[2, 1, extraction.PAGE_INDEX, "page"][1, 2] == ""
    assert got[4, 1, 90, "band"][1, 0] == "P1 b"


def test_no_words(spark):
    assert extraction.cells_from_words(spark.createDataFrame([], WORDS), spark.createDataFrame([], CELLS)).count() == 0


def test_lines_follow_a_running_mean(spark):
    tops = [10.0, 13.0, 15.5, 16.0, 30.0, 33.9, 36.1, 50.0, 54.1]
    rows = extraction.cluster_rows(spark.createDataFrame([(1, 1, float(k), 0.0, t, 0.0, f"w{k}") for k, t in enumerate(tops)] + [(2, 1, 5.0, 0.0, 1.0, 0.0, None)], WORDS))
    want, row, mean = {}, -1, None
    for k, t in enumerate(tops):
        row, mean = (row + 1, t) if mean is None or abs(t - mean) > 4.0 else (row, (mean + t) / 2)
        want[f"w{k}"] = row
    assert {r.text: r.row for r in rows.filter("document = 1").collect()} == want and rows.filter("document = 2").count() == 1
