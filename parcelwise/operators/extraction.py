"""From pages, words and cells to observations: triage, votes, consensus, header mapping, table stitching, rows and columns of words.

Inputs are tables of page profiles, words, cells and number tokens (a PDF parser is an upstream producer). Ties go to
what comes first on the page; every operator carries that place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.functions.angles import angular_difference
from parcelwise.functions.let import exploded, let
from parcelwise.functions.numbers import convention_vote, parse_number
from parcelwise.functions.text import clean_cell, collapse_spaced_letters, normalize_label
from parcelwise.operators.rings import preceding
from parcelwise.sources.lineage import settled

#: Limits of the triage: characters, image coverage, vectors; coverage of a page by text that marks data.
FEW_CHARS, HYBRID_CHARS, MOST_COVERED, MANY_VECTORS, DATA_CHARS = 20, 120, 0.55, 400, 400
PAGE_CLASSES = ["digital", "scanned", "hybrid", "vector_cad", "empty"]
#: Confidence by where a value comes from.
SOURCE_CONFIDENCE = {"table_cell": 1.0, "text_span": 0.95, "ocr": 0.70, "vision": 0.60}
#: Labels of rows below a table, and of header groups that are no field themselves.
FOOTERS = ["total", "totais", "perimetro", "soma", "area", "fechamento", "somatorio"]
TABLE_FOOTERS = ["total", "totais", "perimetro", "soma", "fechamento", "somatorio"]
GROUPS = ["coordenadas", "coordenadas utm", "coordenadas planas", "coordenadas geograficas", "coordenadas geodesicas"]
#: Header labels of each field, as normalised labels, the specific before the general.
HEADERS = {
    "vertex_code": ["vertice", "vert", "codigo do vertice", "cod vertice", "ponto", "estaca", "est", "marco", "identificacao", "id", "de", "de para", "vertice inicial", "origem"],
    "northing": ["coordenada n", "coord n", "utm n", "n utm", "utm norte", "norte", "northing", "n m", "y", "n"],
    "easting": ["coordenada e", "coord e", "utm e", "e utm", "utm este", "este", "leste", "easting", "e m", "x", "e"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "long", "lon"],
    "azimuth": ["azimute plano", "azimute verdadeiro", "azimute", "az", "rumo", "orientacao"],
    "distance": ["distancia plana", "distancia horizontal", "distancia", "dist", "extensao", "lado", "comprimento"],
    "interior_angle": ["angulo interno", "ang interno", "angulo", "deflexao"],
    "confrontant": ["confrontante", "confrontacao", "confronta", "limite", "divisa", "lindeiro"],
    "registration": ["matricula", "matr", "transcricao"],
}


def image_coverage(areas: Column, width: Column, height: Column) -> Column:
    """Share of the page under images, from an array of their areas."""
    return F.least(F.lit(1.0), F.aggregate(areas, F.lit(0.0), lambda t, x: t + F.abs(x)) / (width * height))


def page_class(chars: Column, images: Column, coverage: Column, vectors: Column) -> Column:
    few = F.when((coverage >= MOST_COVERED) | (images > 0), "scanned").when(vectors >= MANY_VECTORS, "vector_cad").otherwise("empty")
    return F.when(chars < FEW_CHARS, few).when((chars <= HYBRID_CHARS) & (coverage >= MOST_COVERED), "hybrid").when(vectors >= MANY_VECTORS, "vector_cad").otherwise("digital")


def page_relevance(kind: Column, tables: Column, chars: Column, vectors: Column) -> Column:
    return F.when(kind == "empty", "unknown").when((tables > 0) | (chars > DATA_CHARS), "likely_data").when((vectors > MANY_VECTORS) & (chars < DATA_CHARS), "likely_drawing").otherwise("unknown")


def triage(pages: DataFrame) -> DataFrame:
    """pages (document, page, chars, images, coverage, vectors, tables) with kind, relevance, needs_ocr and is_data."""
    kind = page_class(F.col("chars"), F.col("images"), F.col("coverage"), F.col("vectors"))
    rows = pages.withColumn("kind", kind)
    rows = rows.withColumn("relevance", page_relevance(F.col("kind"), F.col("tables"), F.col("chars"), F.col("vectors")))
    return rows.withColumns({"needs_ocr": F.col("kind").isin("scanned", "hybrid"), "is_data": (F.col("relevance") != "likely_drawing") & (F.col("kind") != "empty")})


def data_cells(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """Cells (document, page) of data pages; a document of a single page is read whatever its page is."""
    read = pages.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("document"))).filter("is_data OR _n = 1")
    return cells.join(read.select("document", "page"), ["document", "page"], "left_semi")


def document_profile(pages: DataFrame) -> DataFrame:
    """document, pages, dominant (most frequent kind, of equals the one seen first), needs_ocr, data_pages from triaged pages."""
    kinds = pages.groupBy("document", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("first"))
    dominant = kinds.groupBy("document").agg(F.max_by("kind", F.struct(F.col("n"), -F.col("first"))).alias("dominant"))
    return pages.groupBy("document").agg(F.count(F.lit(1)).alias("pages"), F.bool_or("needs_ocr").alias("needs_ocr"), F.count_if("is_data").alias("data_pages")).join(dominant, "document")


def class_counts(pages: DataFrame) -> DataFrame:
    """document, kind, pages: how many triaged pages of each class a document has, zeros included."""
    counts = pages.groupBy("document").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in PAGE_CLASSES])
    return counts.select("document", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("pages")) for k in PAGE_CLASSES])))


def number_convention(tokens: DataFrame) -> DataFrame:
    """document, convention: the majority of votes of rows of document, pos, token; of equals the one cast first; 'ambiguous' without votes."""
    votes = tokens.select("document", "pos", convention_vote(F.col("token")).alias("vote"))
    counts = votes.groupBy("document", "vote").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    best = F.min_by("vote", F.struct(-F.when(F.col("vote").isNotNull(), F.col("n")).otherwise(0), F.col("first")))
    return counts.groupBy("document").agg(F.coalesce(best, F.lit("ambiguous")).alias("convention"))


def consensus(values: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """document, field, value, confidence, rivals from rows of document, field, pos, value: the most repeated value, of equals the first; 1.0 if unanimous, else 0.5. also: columns given as where the value stands first."""
    counts = values.groupBy("document", "field", "value").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), *[F.min_by(c, "pos").alias(c) for c in also])
    ranked = counts.groupBy("document", "field").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "first", "value", *also))).alias("all"))
    best = F.get("all", F.lit(0))
    return ranked.select("document", "field", best["value"].alias("value"), *[best[c].alias(c) for c in also], F.when(F.size("all") == 1, 1.0).otherwise(0.5).alias("confidence"), F.transform(F.slice("all", F.lit(2), F.size("all")), lambda x: x["value"]).alias("rivals"))


def citations(values: DataFrame) -> DataFrame:
    """document, field, ordinal, value, confidence: each distinct value by its first place; the one of consensus() is sure (1.0), the others are disputed (0.5)."""
    counts = values.groupBy("document", "field", "value").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"), F.min_by("halfwidth", "pos").alias("halfwidth"))
    w = Window.partitionBy("document", "field")
    first = F.row_number().over(w.orderBy(F.desc("n"), "pos")) == 1
    return counts.select("document", "field", F.row_number().over(w.orderBy("pos")).alias("ordinal"), "value", "halfwidth", F.when(first, 1.0).otherwise(0.5).alias("confidence"))


def first_hits(values: DataFrame) -> DataFrame:
    """document, field, value: what stands first, by page and place."""
    return values.groupBy("document", "field").agg(F.min_by("value", F.struct("page", "pos")).alias("value"))


#: Labels of a side's two ends, which a cell may hold together.
PAIR_LABELS = ["vertice vertice", "de para", "origem destino", "inicial final", "ponto ponto", "estaca estaca"]
#: Rows that are scanned for a header; a header's second row stands under one of them.
HEADER_ROWS = 5


#: Bytes of the distinct texts that name a field, up to which they are broadcast.
BROADCAST_BYTES = 8_000_000


def header_fields(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells (keys, column, text) with field and label (digits in a row as one 0) where the text names one: exact labels, then those that contain or begin with a field's label of three letters or more, in the order of HEADERS.

    No field's label has a digit, so texts that differ in digits alone name the same: a header read with the numbers below it is one text, not one a table.
    """
    spark = cells.sparkSession
    names = spark.createDataFrame([(field, alias, k) for k, (field, alias) in enumerate((f, a) for f, all_ in HEADERS.items() for a in all_)], "field string, alias string, rank int")
    # headers recur: texts are made distinct before they are normalised, and only what names some field is compared; most cells of the first rows are data
    cells = cells.withColumn("_text", F.regexp_replace("text", "[0-9]+", "0"))
    lettered = F.col("_text").rlike("\\p{L}")
    texts = cells.filter(lettered).select("_text").distinct().withColumn("label", normalize_label(F.col("_text")))
    long_, short = ("|".join(a for all_ in HEADERS.values() for a in all_ if (len(a) >= 3) == is_long) for is_long in (True, False))
    texts = settled(texts).filter(F.col("label").rlike(f"^(?:{long_})|(?<= )(?:{long_})(?= |$)|^(?:{short})$") & ~F.col("label").isin(GROUPS))
    contained = F.contains(F.concat(F.lit(" "), "label", F.lit(" ")), F.concat(F.lit(" "), "alias", F.lit(" ")))
    hits = texts.join(F.broadcast(names), (F.col("label") == F.col("alias")) | ((F.length("alias") >= 3) & (contained | F.startswith("label", F.col("alias")))))
    known = settled(hits.groupBy("_text", "label").agg(F.min_by("field", F.struct((F.col("label") != F.col("alias")).alias("inexact"), "rank")).alias("field")))
    # a few hundred texts that recur: measured, and broadcast if they are small; else cells without a letter, which name nothing, are spread by their table
    size = known.agg(F.coalesce(F.sum(F.octet_length("_text") + F.octet_length("label")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return cells.join(F.broadcast(known), "_text", "left").drop("_text")
    spread = cells.withColumn("_text", F.when(lettered, F.col("_text")).otherwise(F.concat(F.lit(" "), F.xxhash64(*keys).cast("string"))))
    return spread.join(known, "_text", "left").drop("_text")


def header_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """What each of the first rows would be as a header, alone or read with the row below: keys, row (the last header row), two_rows, columns (field -> column), fields, confidence, code_is_pair, has_coordinates."""
    first = cells.filter(F.col("row") < HEADER_ROWS).select(*keys, "row", "column", F.coalesce("text", F.lit("")).alias("text"))
    w, last = Window.partitionBy(*keys, "column").orderBy("row"), F.max("row").over(Window.partitionBy(*keys))
    around = first.withColumns({"last": last, "below": F.when(F.lead("row").over(w) == F.col("row") + 1, F.lead("text").over(w)).otherwise(""), "alone": F.coalesce(F.lag("row").over(w) != F.col("row") - 1, F.lit(True))})
    # a row's cell by itself, with the one below it, and under a row that lacks its column
    part = lambda held, at, two_rows, text: F.when(held, F.struct(at.alias("at"), F.lit(two_rows).alias("two_rows"), F.trim(text).alias("text")))
    parts = F.array(part(F.lit(True), F.col("row"), False, F.col("text")), part(F.col("row") < F.col("last"), F.col("row") + 1, True, F.concat("text", F.lit(" "), "below")), part((F.col("row") > 0) & F.col("alone"), F.col("row"), True, F.col("text")))
    merged = around.select(*keys, "column", F.explode(parts).alias("p")).filter("p IS NOT NULL").select(*keys, "column", "p.*")
    told = header_fields(merged, [*keys, "at", "two_rows"])
    pair = F.exists(F.lit(PAIR_LABELS), lambda x: F.array_join(F.slice(F.split("label", " "), -F.least(F.lit(2), F.size(F.split("label", " "))), 2), " ") == x)
    # a row has few named cells: gathered in one aggregation, of a field the first column counts
    named = F.when(F.col("field").isNotNull(), F.struct("field", "column", F.when(F.col("field") == "vertex_code", pair).alias("pair")))
    rows = told.groupBy(*keys, "at", "two_rows").agg(F.array_sort(F.collect_list(named)).alias("all"), F.count_if(F.trim("text") != "").alias("filled")).filter("size(all) > 0")
    rows = rows.withColumn("once", F.filter("all", lambda x, k: (k == 0) | (F.get("all", k - 1)["field"] != x["field"])))
    rows = rows.select(
        *keys, "at", "two_rows",
        F.map_from_entries(F.transform("once", lambda x: F.struct(x["field"].alias("field"), x["column"].alias("column")))).alias("columns"),
        F.size("once").cast("long").alias("fields"),
        (F.size("once") / F.greatest(F.col("filled"), F.lit(1))).alias("confidence"),
        F.coalesce(F.exists("once", lambda x: (x["field"] == "vertex_code") & F.coalesce(x["pair"], F.lit(False))), F.lit(False)).alias("code_is_pair"),
    )
    has = lambda *names: F.size(F.array_except(F.array(*map(F.lit, names)), F.map_keys("columns"))) == 0
    return rows.withColumnRenamed("at", "row").withColumn("has_coordinates", has("easting", "northing") | has("latitude", "longitude"))


def map_headers(cells: DataFrame, keys: list[str], two_rows: bool = True) -> DataFrame:
    """The header of each table, as a row of header_rows(): of single rows the one with most fields, the first of equals;
    two rows read together replace it if they are richer, in coordinates first and in number of fields then."""
    rows = header_rows(cells, keys)
    if not two_rows:
        rows = rows.filter("NOT two_rows")
    value = lambda *order: F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order))
    of_kind = rows.groupBy(*keys, "two_rows").agg(F.when(F.col("two_rows"), value("has_coordinates", "fields", -F.col("row"))).otherwise(value("fields", -F.col("row"))).alias("h"))
    best = of_kind.groupBy(*keys).agg(F.max_by("h", F.struct("h.has_coordinates", "h.fields", ~F.col("h.two_rows"))).alias("h"))
    return best.select(*keys, "h.*")


def is_footer(label: Column) -> Column:
    return label.rlike("^(" + "|".join(FOOTERS) + ")")


def begins_as_footer(text: Column) -> Column:
    """Whether the text's label may be or begin with a footer's: false where its first two signs, told without making a label, are those of none. Signs beyond ASCII may become any."""
    space, starts = "\\t-\\r .\\-_/\\\\|()\\[\\]:;,", sorted({x[:2] for x in FOOTERS})
    either = lambda chars: "".join(sorted({y for x in chars for y in (x, x.upper())}))
    first, second = either(x[0] for x in starts), either(x[1] for x in starts)
    return ~text.rlike(f"^[{space}]*+(?:(?![{first}])[!-~]|[!-~](?:[{space}]|(?![{second}])[!-~]))")


def is_data_row(tokens: Column) -> Column:
    """Whether a row of words holds data: a footer's label in front, or two words or more with a number and three digits in all."""
    numbers = F.filter(tokens, lambda t: F.length(F.regexp_replace(t, "\\D", "")) >= 3)  # parse_number reads any text with a digit
    return (F.size(tokens) > 0) & (normalize_label(F.get(tokens, F.lit(0))).isin(TABLE_FOOTERS) | (F.size(numbers) >= 2))


def row_fields(tokens: Column) -> Column:
    """The fields that a row of words names: one to three words in a row are taken as a label."""
    tests = [(field, alias) for field, all_ in HEADERS.items() for alias in all_]
    exact = F.create_map(*[F.lit(x) for field, alias in reversed(tests) for x in (alias, field)])

    def field(label: Column) -> Column:
        near = F.coalesce(*[F.when(label.startswith(a) | F.contains(F.concat(F.lit(" "), label, F.lit(" ")), F.lit(f" {a} ")), f) for f, a in tests if len(a) >= 3])
        return F.when((label != "") & ~label.isin(GROUPS), F.coalesce(F.try_element_at(exact, label), near))

    def windows(n: int) -> Column:
        labels = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda k: normalize_label(F.array_join(F.slice(tokens, k, n), " ")))
        return F.when(F.size(tokens) >= n, labels).otherwise(F.array().cast("array<string>"))

    labels = F.concat(windows(3), windows(2), windows(1))
    # most rows are data: their label as a whole tells that no label of its words begins with, holds or is a field's
    long_, short = ("|".join(a for _, a in tests if (len(a) >= 3) == is_long) for is_long in (True, False))
    some = normalize_label(F.array_join(tokens, " ")).rlike(f"(?:^| )(?:(?:{long_})|(?:{short})(?= |$))")
    return F.when(some, F.array_distinct(F.filter(F.transform(labels, field), lambda x: x.isNotNull()))).otherwise(F.array().cast("array<string>"))


def table_bands(rows: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """keys, first, last (places): word rows (keys, row, tokens) that begin with a header of one or two rows (two fields or more in each), go on with data and have least rows or more; of overlapping ones the first."""
    w = Window.partitionBy(*keys).orderBy("row")
    told = rows.select(*keys, (F.row_number().over(w) - 1).alias("at"), (F.size(row_fields(F.col("tokens"))) >= 2).alias("header"), is_data_row(F.col("tokens")).alias("data"))
    w = Window.partitionBy(*keys).orderBy("at")
    told = told.withColumns({"stop": F.min(F.when(~F.col("data"), F.col("at"))).over(w.rowsBetween(0, Window.unboundedFollowing)), "rows": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    second = F.coalesce(F.lead("header").over(w), F.lit(False))
    told = told.withColumn("end", F.coalesce(F.when(second, F.lead("stop", 2).over(w)).otherwise(F.lead("stop").over(w)), F.col("rows")))
    found = told.filter(F.col("header") & (F.col("end") - F.col("at") >= least)).groupBy(*keys)
    found = found.agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("first"), (F.col("end") - 1).cast("int").alias("last")))).alias("all"))
    apart = F.aggregate("all", F.slice("all", 1, 1), lambda kept, x: F.when(F.element_at(kept, -1)["last"] < x["first"], F.concat(kept, F.array(x))).otherwise(kept))
    return exploded(found, keys, apart).select(*keys, "x.*")


def hull(boxes: DataFrame, keys: list[str], padding: float = 0.0) -> DataFrame:
    """keys, x0, top, x1, bottom around the boxes of each key."""
    return boxes.groupBy(*keys).agg((F.min("x0") - padding).alias("x0"), (F.min("top") - padding).alias("top"), (F.max("x1") + padding).alias("x1"), (F.max("bottom") + padding).alias("bottom"))


def distinct_tables(tables: DataFrame) -> DataFrame:
    """Tables (document, page, index, x0, top, x1, bottom, rows, columns) of three rows and two columns or more; of those whose boxes are the same to one decimal, the first."""
    box = [F.round(F.col(c) * 10).cast("long").alias(f"_{c}") for c in ("x0", "top", "x1", "bottom")]
    large = tables.filter("rows >= 3 AND columns >= 2").select("*", *box)
    first = Window.partitionBy("document", "page", "_x0", "_top", "_x1", "_bottom").orderBy("index")
    return large.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k", "_x0", "_top", "_x1", "_bottom")


def first_success(tables: DataFrame) -> DataFrame:
    """Tables of each page up to the first strategy (by its rank) that found coordinates; all where none did."""
    w = Window.partitionBy("document", "page")
    least = F.min(F.when(F.col("has_coordinates"), F.col("rank"))).over(w)
    return tables.withColumn("_least", least).filter("_least IS NULL OR rank <= _least").drop("_least")


def best_table(tables: DataFrame, score: str = "score") -> DataFrame:
    """The table of highest score with coordinates of each document, the first of equals (page, index)."""
    w = Window.partitionBy("document").orderBy(F.desc(score), "page", "index")
    return tables.filter("has_coordinates").withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def magnitudes_agree(anchors: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys whose samples (keys, column, value) lie in the columns of the anchors, within 5 km or 2 % of each column's mean."""
    mean = anchors.groupBy(*keys, "column").agg(F.avg("value").alias("mean"))
    both = mean.join(samples.groupBy(*keys, "column").agg(F.collect_list("value").alias("values")), [*keys, "column"], "full")
    far = F.exists("values", lambda v: F.abs(v - F.col("mean")) > F.greatest(F.lit(5000.0), 0.02 * F.greatest(F.abs("mean"), F.lit(1.0))))
    return both.groupBy(*keys).agg(F.bool_and(F.coalesce(~far, F.lit(False))).alias("agree")).filter("agree").select(*keys)


def stitch_pages(tables: DataFrame) -> DataFrame:
    """document, page, island, row_offset from rows of document, page, columns, rows, has_header: tables continued on following pages.

    A page continues the one before if it is the next, has as many columns and no header of its own.
    """
    w = Window.partitionBy("document").orderBy("page")
    follows = (F.col("page") == F.lag("page").over(w) + 1) & (F.col("columns") == F.lag("columns").over(w)) & ~F.col("has_header")
    marked = tables.withColumn("starts", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("starts").over(w))
    before = Window.partitionBy("document", "island").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return islands.select("document", "page", "island", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_offset"))


#: What tells a column's magnitude: rows that are read, and how far values may lie from the anchor's mean, in metres and as a part of it.
SAMPLE_ROWS, NEAR, NEAR_PART = 12, 5000.0, 0.02
COORDINATES = ["easting", "northing", "longitude", "latitude"]


def continuations(cells: DataFrame, chosen: DataFrame, headers: DataFrame, conventions: DataFrame) -> DataFrame:
    """document, page, index, row_offset: the chosen table of each document and what continues it, page after page.

    cells: document, page, index, row, column, text. chosen: document, page, index, row (the last of its header), columns (field -> column). headers: document,
    page, index, has_coordinates. conventions: document, convention. A table continues the chosen one on a later page if it has as many columns, no header of
    coordinates, and numbers in the same coordinate columns, all near the mean of the chosen one's first rows; of several on a page the first does. The run of such pages
    starts right behind the chosen page and ends at the first one without: what lies beyond it belongs to another parcel, however alike.
    """
    keys = ["document", "page", "index"]
    at = chosen.select("document", F.col("page").alias("page0"), F.col("index").alias("index0"), F.col("row").alias("header_row"), F.array_compact(F.array(*[F.try_element_at("columns", F.lit(c)) for c in COORDINATES])).alias("wanted"))
    at = at.join(conventions.select("document", "convention"), "document", "left")
    own = (F.col("page") == F.col("page0")) & (F.col("index") == F.col("index0"))
    sampled = F.array_contains("wanted", F.col("column")) & F.when(own, F.col("row").between(F.col("header_row") + 1, F.col("header_row") + SAMPLE_ROWS)).otherwise(F.col("row") < SAMPLE_ROWS)
    # one row a column of each table, then one a table: all of a document's tables are weighed in one partitioning by document
    later = cells.join(at, "document").filter(own | (F.col("page") > F.col("page0")))
    number = F.when(sampled, parse_number(F.col("text"), F.when(F.col("convention") == "us", "us").otherwise("br"))["value"])
    columns = later.groupBy(*keys, "column").agg(F.max("row").alias("row"), F.min(number).alias("least"), F.max(number).alias("most"), F.avg(number).alias("mean"), F.first("page0").alias("page0"), F.first("index0").alias("index0"))
    held = F.collect_list(F.when(F.col("mean").isNotNull(), F.struct("column", "least", "most", "mean")))
    tables = columns.groupBy(*keys).agg((F.max("row") + 1).alias("rows"), (F.max("column") + 1).alias("width"), F.array_sort(held).alias("samples"), F.first("page0").alias("page0"), F.first("index0").alias("index0"))
    known = headers.filter("has_coordinates").select(*keys, F.lit(True).alias("headed"))
    whole = Window.partitionBy("document")
    anchor = F.first(F.when(own, F.struct("width", "samples")), ignorenulls=True).over(whole)
    tables = tables.join(known, keys, "left").withColumn("anchor", anchor)
    column_of = lambda c: F.transform(c, lambda x: x["column"])
    reach = lambda a: F.greatest(F.lit(NEAR), NEAR_PART * F.greatest(F.abs(a["mean"]), F.lit(1.0)))
    near = F.forall(F.arrays_zip(F.col("samples").alias("s"), F.col("anchor.samples").alias("a")), lambda x: F.greatest(x["s"]["most"] - x["a"]["mean"], x["a"]["mean"] - x["s"]["least"]) <= reach(x["a"]))
    goes_on = ~own & F.col("headed").isNull() & (F.col("width") == F.col("anchor.width")) & (F.size("samples") > 0) & (column_of(F.col("samples")) == column_of(F.col("anchor.samples"))) & near
    told = tables.select(*keys, "rows", "page0", own.alias("own"), F.coalesce(goes_on, F.lit(False)).alias("goes_on")).filter("own OR goes_on")
    first = told.withColumn("k", F.row_number().over(Window.partitionBy("document", "page").orderBy(F.desc("own"), "index"))).filter("k = 1")
    by_page = Window.partitionBy("document").orderBy("page")
    # pages in a row from the chosen one on: the n-th of them is n - 1 pages behind it
    run = first.withColumn("nth", F.row_number().over(by_page) - 1).filter(F.col("page") - F.col("page0") == F.col("nth"))
    return run.select(*keys, F.coalesce(F.sum("rows").over(by_page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("row_offset"))


def stitched_cells(cells: DataFrame, runs: DataFrame) -> DataFrame:
    """document, row, column, text, page, index, source_row: the cells of continuations(), those of later pages below the chosen table's."""
    return cells.join(runs, ["document", "page", "index"]).select("document", (F.col("row") + F.col("row_offset")).alias("row"), "column", "text", "page", "index", F.col("row").alias("source_row"))


def _edge_clusters(words: DataFrame, gap: float, keys: tuple[str, ...], *held: Column) -> DataFrame:
    """keys, boundary, support, is_edge (see column_boundaries) of each cluster of left edges, with what held gathers of its words. All goes by the page: no join, which would make the words anew on its other side."""
    w = Window.partitionBy(*keys).orderBy("x0")
    new = F.when(F.col("x0") - F.lag("x0").over(w) > gap, 1).otherwise(0)
    clusters = words.withColumn("new", new).withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = clusters.groupBy(*keys, "cluster").agg(F.avg("x0").alias("boundary"), F.count(F.lit(1)).alias("support"), F.collect_set("row").alias("_rows"), *held)
    rows = F.size(F.array_distinct(F.flatten(F.collect_list("_rows").over(Window.partitionBy(*keys)))))
    return found.withColumn("is_edge", F.col("support") >= F.greatest(F.lit(2), F.floor(rows / 3))).drop("cluster", "_rows")


def column_boundaries(words: DataFrame, gap: float = 12.0, keys: tuple[str, ...] = ("document", "page")) -> DataFrame:
    """keys, boundary, support: clusters of left edges (x0) parted by gaps over gap, met twice or more and in a third of the rows (words have row)."""
    return _edge_clusters(words, gap, keys).filter("is_edge").drop("is_edge")


def _in_edges(words: DataFrame, reach: float) -> DataFrame:
    """words with column and width from edges, their page's boundaries in order."""
    near = F.transform("edges", lambda b, k: F.struct(F.when(b <= F.col("x0") + reach, F.abs(F.col("x0") - b)).otherwise(F.lit(float("inf"))).alias("distance"), k.alias("k")))
    return words.withColumns({"column": F.array_min(near)["k"], "width": F.size("edges")}).drop("edges")


def assign_columns(words: DataFrame, boundaries: DataFrame, reach: float = 12.0, keys: tuple[str, ...] = ("document", "page")) -> DataFrame:
    """words with column, and width, the number of columns: the nearest boundary at or left of the word, give or take reach, the first of equals. A page has few boundaries, gathered in one array."""
    lists = boundaries.groupBy(*keys).agg(F.array_sort(F.collect_list("boundary")).alias("edges"))
    return _in_edges(words.join(lists, list(keys)), reach)


def in_columns(words: DataFrame, gap: float = 12.0, reach: float = 12.0, keys: tuple[str, ...] = ("document", "page")) -> DataFrame:
    """assign_columns() by the words' own column_boundaries(), in one pass: a cluster keeps its words while the page's edges are gathered."""
    kept = [c for c in words.columns if c not in keys]
    found = _edge_clusters(words, gap, keys, F.collect_list(F.struct(*kept)).alias("_words"))
    edges = F.array_sort(F.collect_list(F.when(F.col("is_edge"), F.col("boundary"))).over(Window.partitionBy(*keys)))
    pages = found.withColumn("edges", edges).filter("size(edges) > 0")
    return _in_edges(exploded(pages, [*keys, "edges"], F.col("_words")).select(*[F.col(c) if c in keys else F.col(f"x.{c}") for c in words.columns], "edges"), reach)


def word_pages(words: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """document, page, all (the page's words in order, as structs) and starts, the places in all where lines begin: by a running mean of the top edge, a recurrence that no window frame expresses.

    The fold keeps where lines begin only; a page's words are in one row of the plan, so memory is that of the largest page.
    """
    keys, rest = ["document", "page"], [c for c in words.columns if c not in ("document", "page", "top", "x0")]
    pages = words.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("top", "x0", *rest))).alias("all"))
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("mean"), F.array().cast("array<int>").alias("starts"))

    def add(state, word):
        top = word["top"].cast("double")
        new = state["mean"].isNull() | (F.abs(top - state["mean"]) > tolerance)
        return F.struct((state["n"] + 1).alias("n"), F.when(new, top).otherwise((state["mean"] + top) / 2).alias("mean"), F.when(new, F.concat(state["starts"], F.array(state["n"]))).otherwise(state["starts"]).alias("starts"))

    return pages.select(*keys, "all", F.aggregate("all", start, add)["starts"].alias("starts"))


def _lines(more: str | None = None) -> Column:
    """The lines of a page of word_pages() as struct<row, words>, with a column of the page besides."""
    of = [F.col(more)] if more else []
    return F.transform("starts", lambda s, k: F.struct(k.alias("row"), F.slice("all", s + 1, F.coalesce(F.get("starts", k + 1), F.size("all")) - s).alias("words"), *of))


def cluster_rows(words: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """words with row: the lines of word_pages()."""
    keys = ["document", "page"]
    rows = exploded(word_pages(words, tolerance), keys, _lines(), "line").select(*keys, F.col("line.row").alias("row"), F.explode("line.words").alias("word"))
    return rows.select(*[F.col(c) if c in keys else F.col(f"word.{c}").alias(c) for c in words.columns], "row")


def page_edges(pages: DataFrame, gap: float = 12.0) -> DataFrame:
    """pages (of word_pages) with edges: column_boundaries() of the page's words as array<struct<boundary, support>>, in order, by a fold over its left edges on the page's own row."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<boundary:double,support:bigint>>").alias("done"))
    closed = lambda state: F.concat(state["done"], F.array(F.struct((state["sum"] / state["n"]).alias("boundary"), state["n"].alias("support"))))

    def add(state, x):
        new = F.coalesce(x - state["last"] > gap, F.lit(False))
        return F.struct(x.alias("last"), F.when(new, x).otherwise(state["sum"] + x).alias("sum"), F.when(new, F.lit(1)).otherwise(state["n"] + 1).cast("long").alias("n"), F.when(new, closed(state)).otherwise(state["done"]).alias("done"))

    found = F.aggregate(F.sort_array(F.transform("all", lambda w: w["x0"].cast("double"))), start, add, closed)
    return pages.withColumn("edges", let(F.greatest(F.lit(2), F.floor(F.size("starts") / 3)), lambda least: F.filter(found, lambda e: e["support"] >= least)))


def page_grid(words: DataFrame, reach: float = 12.0) -> DataFrame:
    """words with row, column and width: cluster_rows() laid out by their own column_boundaries(), a page as one row until it has all."""
    keys, pages = ["document", "page"], page_edges(word_pages(words))
    pages = pages.withColumn("edges", F.transform("edges", lambda e: e["boundary"]))
    # no filter on edges: below the projection that makes them it would make them again
    lines = exploded(pages, keys, F.when(F.size("edges") > 0, _lines("edges")), "line").select(*keys, "line.row", "line.edges", F.explode("line.words").alias("word"))
    return _in_edges(lines.select(*[F.col(c) if c in keys else F.col(f"word.{c}").alias(c) for c in words.columns], "row", "edges"), reach)


def cells_from_rows(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, column, text of tables laid out by words (keys, row, x0, text): of rows with two words or more, where there are three such rows and two columns or more.

    Rows are numbered anew from 0 on; a column without a word in a row has an empty text there.
    """
    row = Window.partitionBy(*keys, "row")
    kept = words.withColumn("words", F.count(F.lit(1)).over(row)).filter("words >= 2").drop("words")
    place = Window.partitionBy(*keys).orderBy("row")
    kept = kept.withColumn("row", F.dense_rank().over(place) - 1)
    kept = kept.withColumn("rows", F.max("row").over(Window.partitionBy(*keys)) + 1).filter("rows >= 3").drop("rows")
    placed = in_columns(kept, keys=tuple(keys)).filter("width >= 2")
    held = placed.groupBy(*keys, "row", "column").agg(F.first("width").alias("width"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("text"))
    text = collapse_spaced_letters(clean_cell(F.col("text")))
    lines = held.groupBy(*keys, "row").agg(F.first("width").alias("width"), F.map_from_entries(F.collect_list(F.struct("column", text.alias("text")))).alias("texts"))
    whole = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.coalesce(F.try_element_at("texts", k), F.lit("")))
    return exploded(lines, [*keys, "row"], whole, "text", "column")


def told_pages(cells: DataFrame) -> DataFrame:
    """document, page, index of the tables (three rows and two columns or more) whose header has coordinates."""
    keys = ["document", "page", "index"]
    large = cells.groupBy(*keys).agg(F.max("row").alias("_r"), F.max("column").alias("_c")).filter("_r >= 2 AND _c >= 1").select(*keys)
    return map_headers(cells.join(large, keys, "left_semi"), keys, two_rows=False).filter("has_coordinates").select(*keys)


#: Numbers of tables that are laid out by words: those in bands from the first on, and that of a whole page.
BAND_INDEX, PAGE_INDEX = 90, 10_000


def cells_from_words(words: DataFrame, ruled: DataFrame, settle=lambda df: df) -> DataFrame:
    """document, page, index, row, column, text, strategy: tables of each page by the first strategy that finds coordinates.

    words: document, page, x0, x1, top, bottom, text. ruled: cells (document, page, index, row, column, text) that an upstream reader took from drawn lines, kept as they are.
    A page that these don't tell is searched for bands of rows that look like a table; its bands up to the first one with coordinates are laid out
    in columns. A page that bands don't tell either is laid out as a whole. A page goes to a later strategy only if no earlier one told it (an anti-join);
    settle is called on what several steps read.
    """
    page = ["document", "page"]
    pages = lambda told: told.select(*page).distinct()
    columns = [*page, "index", "row", "column", "text"]
    by_line = pages(told_pages(ruled))
    rows = settle(cluster_rows(words.join(by_line, page, "left_anti")))
    lines = rows.groupBy(*page, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]).alias("tokens"))
    bands = table_bands(lines, page).groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("bands"))
    # the band of each row, by its interval: a page has few, in one array
    inside = F.filter(F.transform("bands", lambda b, k: F.struct(k.alias("k"), b.alias("b"))), lambda x: F.col("row").between(x["b"]["first"], x["b"]["last"]))
    banded = rows.join(bands, page).withColumn("index", BAND_INDEX + F.get(inside, F.lit(0))["k"]).filter("index IS NOT NULL").drop("bands")
    banded = settle(cells_from_rows(banded, [*page, "index"]))
    told = settle(told_pages(banded))
    last = told.groupBy(*page).agg(F.min("index").alias("last"))
    banded = banded.join(last, page, "left").filter("last IS NULL OR index <= last").drop("last")
    whole = cells_from_rows(rows.join(pages(told), page, "left_anti"), page).withColumn("index", F.lit(PAGE_INDEX))
    named = lambda df, name: df.select(*columns, F.lit(name).alias("strategy"))
    return named(ruled, "ruled").unionByName(named(banded, "band")).unionByName(named(whole, "page"))


def side_convention(rows: DataFrame, keys: list[str], declared: str = "declared") -> DataFrame:
    """rows (keys, idx, azimuth as computed, declared) with convention: whether a row's side leaves its vertex or leads to it.

    'trailing' iff the mean difference one row earlier is under half of that at the row itself, over two values or more.
    """
    w = Window.partitionBy(*keys)
    gap = lambda x: F.abs(angular_difference(F.col(declared), x))
    both = rows.withColumn("_back", preceding("azimuth", keys))
    leading, trailing, n = F.avg(gap(F.col("azimuth"))).over(w), F.avg(gap(F.col("_back"))).over(w), F.count(declared).over(w)
    return both.withColumn("convention", F.when((n >= 2) & (trailing < 0.5 * leading), "trailing").otherwise("leading")).drop("_back")
