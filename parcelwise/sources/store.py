"""Documents, observations, corrections and findings at rest: content addressing, integrity, long and wide forms, replacement."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.sources.lineage import settled

#: A number nearer than this to the primary one is no alternate.
ALTERNATE_EPS = 1e-6
FIELDS = ["easting", "northing", "longitude", "latitude", "vertex_code"]


def read_uploads(spark: SparkSession, path: str, max_bytes: int = 200 * 1024 * 1024) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected files: path, length, sha256 (accepted) or reason. An upload is a non-empty PDF within the size cap; Spark's file sources pass over empty files, which are thus in neither table."""
    files = spark.read.format("binaryFile").load(path)
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > max_bytes, "too large").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "not a PDF")
    checked = files.select("path", "length", F.sha2("content", 256).alias("sha256"), reason.alias("reason"))
    return checked.filter("reason IS NULL").drop("reason"), checked.filter("reason IS NOT NULL").drop("sha256")


def addressed(contents: DataFrame, content: Column, order: str) -> DataFrame:
    """sha256, first (the least order), copies, blob_path of each distinct content."""
    sha = F.sha2(content.cast("binary"), 256)
    g = contents.select(sha.alias("sha256"), order).groupBy("sha256").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
    return g.withColumn("blob_path", F.concat_ws("/", F.lit("blobs"), F.substring("sha256", 1, 2), "sha256"))


def verify_blobs(documents: DataFrame, blobs: DataFrame) -> DataFrame:
    """document, problem of documents (document, sha256) whose blob (sha256 as stored, actual) is missing or differs."""
    joined = documents.join(blobs.withColumn("found", F.lit(True)), "sha256", "left")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("actual") != F.col("sha256"), "changed")
    return joined.withColumn("problem", problem).filter("problem IS NOT NULL").select("document", "problem")


def to_observations(vertices: DataFrame, key: str) -> DataFrame:
    """Long form of rows of key, idx, code, e, n: key, ordinal, idx, field, value_num, value_text, in the order of emission."""
    part = lambda k, field, number, words: F.struct(F.lit(k).alias("k"), F.lit(field).alias("field"), number.cast("double").alias("value_num"), words.cast("string").alias("value_text"))
    none = F.lit(None)
    parts = F.array(part(0, "vertex_code", none, F.col("code")), part(1, "easting", F.col("e"), none), part(2, "northing", F.col("n"), none))
    long = vertices.select(key, "idx", F.inline(parts))
    return long.select(key, (F.col("idx") * 3 + F.col("k")).alias("ordinal"), "idx", "field", "value_num", "value_text")


def from_observations(observations: DataFrame, key: str) -> DataFrame:
    """Wide form: key, idx, code, e, n. A vertex without a code is called by its number."""
    g = observations.groupBy(key, "idx").pivot("field", ["vertex_code", "easting", "northing"]).agg(F.first(F.struct("value_num", "value_text")))
    return g.select(key, "idx", F.coalesce(F.col("vertex_code.value_text"), F.concat(F.lit("#"), (F.col("idx") + 1).cast("string"))).alias("code"), F.col("easting.value_num").alias("e"), F.col("northing.value_num").alias("n"))


#: Fields of a vertex or the side that leaves it, and of the whole parcel, in the order of emission; those that hold text.
VERTEX_FIELDS = {"vertex_code": "code", "easting": "e", "northing": "n", "azimuth": "declared_azimuth", "distance": "distance", "confrontant": "neighbour"}
TOTAL_FIELDS, TEXT_FIELDS = ["area", "perimeter", "registration"], ["vertex_code", "confrontant", "registration"]


def _long(rows: DataFrame, key: str, columns: dict[str, str], idx: Column, first: Column) -> DataFrame:
    def part(k: int, field: str, column: str) -> Column:
        held = F.col(column) if column in rows.columns else F.lit(None)
        width = F.col(f"{column}_hw") if f"{column}_hw" in rows.columns else F.lit(None)
        number, words = (F.lit(None), held) if field in TEXT_FIELDS else (held, F.lit(None))
        return F.struct(F.lit(k).alias("k"), F.lit(field).alias("field"), number.cast("double").alias("value_num"), words.cast("string").alias("value_text"), width.cast("double").alias("halfwidth"))

    parts = F.filter(F.array(*[part(k, f, c) for k, (f, c) in enumerate(columns.items())]), lambda x: x["value_num"].isNotNull() | x["value_text"].isNotNull())
    long = rows.select(key, idx.cast("int").alias("idx"), first.alias("first"), F.col("confidence").cast("double").alias("confidence"), F.inline(parts))
    return long.select(key, (F.col("first") + F.col("k")).cast("long").alias("ordinal"), "idx", "field", "value_num", "value_text", "halfwidth", "confidence", F.lit(False).alias("edited"))


def parcel_observations(vertices: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Every value of a parcel as a row: key, ordinal, idx (null for totals), field, value_num or value_text, halfwidth, confidence, edited.

    vertices: key, idx, confidence and any columns of VERTEX_FIELDS with half-widths in _hw; totals: key, confidence and any of TOTAL_FIELDS. Nulls have no row.
    """
    n = len(VERTEX_FIELDS)
    sides = _long(vertices, key, VERTEX_FIELDS, F.col("idx"), F.col("idx") * n + len(TOTAL_FIELDS))
    return _long(totals, key, {f: f for f in TOTAL_FIELDS}, F.lit(None), F.lit(0)).unionByName(sides)


def from_parcel_observations(observations: DataFrame, key: str) -> DataFrame:
    """Vertices (key, idx, the columns of VERTEX_FIELDS) with their parcel's totals, vertices (their number) and least_confidence; a vertex without a code is called by its number."""
    value = lambda f, c: F.first(F.when(F.col("field") == f, F.col("value_text" if f in TEXT_FIELDS else "value_num")), ignorenulls=True).alias(c)
    of = observations.filter("idx IS NOT NULL").groupBy(key, "idx").agg(*[value(f, c) for f, c in VERTEX_FIELDS.items()])
    w = Window.partitionBy(key)
    totals = observations.groupBy(key).agg(*[value(f, f) for f in TOTAL_FIELDS], F.min("confidence").alias("least_confidence"), F.max("halfwidth").alias("widest"))
    named = F.coalesce("code", F.concat(F.lit("#"), (F.col("idx") + 1).cast("string")))
    return of.withColumns({"code": named, "vertices": F.count(F.lit(1)).over(w)}).join(totals, key)


def alternates(observations: DataFrame, key: str) -> DataFrame:
    """observations without later rows that repeat the primary one of the same field and place, the first by ordinal (numbers that differ by less than a millionth, or the same text)."""
    w = Window.partitionBy(key, "idx", "field").orderBy("ordinal")
    first = lambda c: F.first(c).over(w)
    again = F.when(F.col("value_num").isNotNull(), F.abs(F.col("value_num") - first("value_num")) < ALTERNATE_EPS).otherwise(F.col("value_text").eqNullSafe(first("value_text")))
    kept = observations.withColumns({"_first": F.row_number().over(w) == 1, "_again": again})
    return kept.filter(F.col("_first") | ~F.coalesce("_again", F.lit(False))).drop("_first", "_again")


def page_of(rows: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(max(offset, 0)).limit(limit)


def corrected(observations: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """observations with the last correction (key, ordinal, at, value_num, by) of each applied: value_num, original_num, edited, confidence, edited_by."""
    last = corrections.groupBy(key, "ordinal").agg(F.max_by(F.struct(F.col("value_num").alias("new"), F.col("by").alias("edited_by")), "at").alias("c")).select(key, "ordinal", "c.*", F.lit(True).alias("touched"))
    joined = observations.join(last, [key, "ordinal"], "left")
    edited = F.coalesce("touched", F.lit(False))
    return joined.withColumns({"original_num": F.when(edited, F.col("value_num")), "value_num": F.when(edited, F.col("new")).otherwise(F.col("value_num")), "edited": edited, "confidence": F.when(edited, 1.0).otherwise(F.col("confidence"))}).drop("new", "touched")


def changed_keys(corrections: DataFrame, key: str) -> DataFrame:
    """What an incremental recomparison has to read again."""
    return corrections.select(key).distinct()


def replace_findings(findings: DataFrame, compared: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Write findings so that those of all compared keys are replaced, and others stay; a key whose new run found nothing loses its old ones.

    Keys are spread over a fixed number of folders by their hash, not one folder a key. Only folders that hold a compared key
    are rewritten, each with what stays of it.
    """
    spark = findings.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    keys = compared.select(key).distinct().withColumn("bucket", bucket)
    new = findings.join(keys.select(key), key, "left_semi").withColumn("bucket", bucket)
    none = new.limit(0)
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except AnalysisException:
        old = none
    stays = old.join(F.broadcast(keys.select("bucket").distinct()), "bucket", "left_semi").join(keys.select(key), key, "left_anti").select(*new.columns)
    rows = stays.unionByName(new)
    held = rows.select("bucket").distinct()
    # a folder that is to be left empty gets a row without a key, which the reader passes over
    empty = keys.select("bucket").distinct().join(held, "bucket", "left_anti")
    blank = empty.select(*[F.col("bucket") if c == "bucket" else F.lit(None).cast(t).alias(c) for c, t in new.dtypes])
    # what is read is not overwritten while it is read
    settled(rows.unionByName(blank)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_findings(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col(key).isNotNull()).drop("bucket")


def append_audit(entries: DataFrame, path: str) -> None:
    entries.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def newest(rows: DataFrame, time: str, tie: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of the history, newest first; limit within 1 and 200."""
    return rows.orderBy(F.desc(time), tie).offset(max(offset, 0)).limit(min(max(limit, 1), 200))


def kept_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
