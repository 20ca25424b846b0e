"""Removal of lines that spread over many sites.

Every line (trimmed, of MIN_WORDS words or more) is known by a 128-bit hash. One grouped aggregation makes a HyperLogLog
sketch of each line's sites; sketches merge by aggregation. Lines whose estimate lies clear of the threshold are decided
by it; those within the sketch's error of the threshold get an exact distinct count. A line found on MIN_SITES sites
is boilerplate: it stays in the document of least doc_id that has it, so that no content vanishes from the corpus, and goes from
all others. DataFrame functions only. Lines are split and hashed once and written; the spread ones, a small part of all, are counted and
broadcast up to BROADCAST_ROWS, so that no line is shuffled to find them, however hot; beyond it, the join on hashes can be split by AQE.

A null text stays null; blank and short lines stay; a null source is no site. A document that loses all its lines
stays as a row with an empty text. Rows that share doc_id count as one document. A null doc_id comes last. An empty
table gives an empty one. All columns of the input are returned, whatever their names, but for one of the name of count_col, which the
count replaces; own columns carry the prefix ``_line_dedup_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import cut_lineage, quoted, remove, small, stored, without_column

MIN_SITES, MIN_WORDS = 10, 3
#: log2 of a sketch's cells, and how far from the threshold, in parts of it, an estimate decides: over three standard errors.
LOG_CELLS, BAND = 10, 0.12
P = "_line_dedup_"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _exploded(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_words: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc"), F.col(site_col).cast("string").alias("site"), F.xxhash64(text_col).alias("row"), F.posexplode(_lines(F.col(text_col))).alias("at", "line"))
    trimmed = F.trim(F.col("line"), F.lit(" \t\r"))
    rows = rows.select("doc", "site", "row", "at", trimmed.alias("line")).filter(F.size(F.split("line", "[ \t]+")) >= min_words)
    return rows.select("doc", "site", "row", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


def spread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """h1, h2, keeper (the least doc_id) of each line on min_sites sites or more, from rows of doc, site, h1, h2."""
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LOG_CELLS)).alias("sketch"), F.min("doc").alias("keeper"))
    sketches = sketches.withColumn("estimate", F.hll_sketch_estimate("sketch")).filter(F.col("estimate") >= min_sites * (1 - BAND) - 1)
    sketches = cut_lineage(sketches.select("h1", "h2", "keeper", "estimate"))
    near = F.col("estimate") <= min_sites * (1 + BAND) + 1
    exact = lines.join(small(sketches.filter(near).select("h1", "h2")), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites"))
    exact = exact.filter(F.col("sites") >= min_sites).select("h1", "h2")
    return sketches.filter(~near).select("h1", "h2", "keeper").unionByName(sketches.join(exact, ["h1", "h2"]).select("h1", "h2", "keeper"))


def remove_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", count_col: str | None = None) -> DataFrame:
    """docs with text_col rewritten; with count_col, a further column of that name holds the number of removed lines."""
    docs = docs.select(*[quoted(c) for c in without_column(docs.columns, count_col)])
    lines, path = stored(_exploded(docs, id_col, text_col, site_col, min_words))
    spread = cut_lineage(spread_lines(lines, min_sites))
    removed = lines.join(small(spread), ["h1", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("keeper")))
    removed = cut_lineage(removed.groupBy("doc", "row").agg(F.collect_set("at").alias("gone")))
    remove(docs.sparkSession, path)
    removed = removed.select(F.col("doc").alias(P + "doc"), F.col("row").alias(P + "row"), F.col("gone").alias(P + "gone"))
    joined = docs.join(removed, F.col(id_col).eqNullSafe(F.col(P + "doc")) & (F.xxhash64(F.col(text_col)) == F.col(P + "row")), "left")
    lines_of = _lines(F.col(text_col))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines_of) - 1), F.col(P + "gone"))
    text = F.when(F.col(P + "gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda k: F.get(lines_of, k)), "\n"))
    columns = [text.alias(c) if c == text_col else quoted(c) for c in docs.columns]
    if count_col:
        columns.append(F.coalesce(F.size(P + "gone"), F.lit(0)).cast("long").alias(count_col))
    return joined.select(*columns)


#: The same over the table documents, by exact counts.
SQL = f"""
WITH lines AS (
  SELECT doc_id, source, trim(line, ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)
), spread AS (
  SELECT line, min(doc_id) AS keeper FROM lines
  WHERE len(regexp_split_to_array(line, '[ \t]+')) >= {MIN_WORDS}
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), numbered AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents
), marked AS (
  SELECT n.doc_id, n.raw, n.k, (s.line IS NOT NULL AND s.keeper <> n.doc_id) AS gone
  FROM numbered n LEFT JOIN spread s ON trim(n.raw, ' ' || chr(9) || chr(13)) = s.line
)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text,
       count(*) FILTER (WHERE gone) AS removed_lines
FROM marked GROUP BY doc_id
"""
