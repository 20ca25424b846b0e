"""Filter interaction audit by the Walsh-Hadamard transform.

Each document's failures of five filters are a mask of five bits. Per part and label, 32 sums of the signs (-1)^|s & mask|, one for
each parity set s, are aggregated; the transform is its own inverse up to 1/32, so the exact count of each mask (a cell) comes
back from them. Every order of the filters and every step is then a sum over cells, and the Shapley value has the closed form of
120 / failures for each document that fails the filter.

Only digests and masks are shuffled, never texts. Equal texts fail the same filters but for E, so what goes to E's test is one
row for each text, part and pair of labels. The sums combine before their shuffle; a part may hold any share of all rows.

A null text is an empty one, a null part is "". Rows that share a doc_id and a text count each, and none of them makes the
others fail E; a null doc_id neither fails E nor makes others fail it. A document has a label if any of its rows in labels has it; null
labels are none. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import cut_lineage, remove, stored, text_of

FILTERS = "ABCDE"
#: Least words; least distinct words and most upper-case letters in a hundred; signs of markup.
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, MARKUP = 50, 65, 5, "[#$%&*|]"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LABELS = ["all", "good", "toxic"]


def failures(text: Column) -> Column:
    """Bits of the filters A to D that the text fails."""
    words = F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != "")

    def mask(w: Column) -> Column:
        n = F.size(w)
        upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
        tests = [n < MIN_WORDS, 100 * F.size(F.array_distinct(w)) < MIN_DISTINCT * n, 100 * upper > MAX_UPPER * F.length(text), text.rlike(MARKUP)]
        return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))

    # the words are bound once, as the argument of a lambda
    return F.get(F.transform(F.array(words), mask), F.lit(0)).cast("int")


def text_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each text (digest), part and labels: the mask of A to D, documents n, the least doc_id, documents with it and without any."""
    known = labels.groupBy(F.col("doc_id").alias("doc")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    text = text_of(text_col)
    told = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("mask"))
    told = told.join(known, "doc", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    group = ["digest", "part", "good", "toxic"]
    # rows of one text and label are counted apart by doc_id first, so that no key holds more than repeated rows
    by_doc = told.groupBy(*group, "doc").agg(F.count(F.lit(1)).alias("n"), F.min("mask").alias("mask"))
    return by_doc.groupBy(*group).agg(
        F.min("mask").alias("mask"), F.min("doc").alias("least"), F.sum("n").alias("n"), F.sum(F.when(F.col("doc").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min_by("n", "doc").alias("at_least")
    )


def masks(cells: DataFrame) -> DataFrame:
    """part, good, toxic, mask, n: documents of each whole mask, the test for equal texts included, from text_cells."""
    first = cells.groupBy("digest").agg(F.min("least").alias("first"))
    cells = cells.join(first, "digest")
    passing = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), passing.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passing).alias("n")))
    return cells.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.mask", "x.n").filter("n > 0")


def sign(s: Column | int, mask: Column) -> Column:
    """-1 if an odd number of the bits of s is set in the mask, else 1."""
    return (1 - 2 * (F.bit_count((F.lit(s) if isinstance(s, int) else s).bitwiseAND(mask)) % 2)).cast("long")


def parity_sums(found: DataFrame) -> DataFrame:
    """part, label, sums: the 32 signed sums."""
    labelled = F.array(F.lit("all"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic"))
    rows = found.select("part", "mask", "n", F.explode(F.array_compact(labelled)).alias("label"))
    sums = rows.groupBy("part", "label").agg(*[F.sum(sign(s, F.col("mask")) * F.col("n")).alias(f"w{s}") for s in range(MASKS)])
    return sums.select("part", "label", F.array(*[f"w{s}" for s in range(MASKS)]).alias("sums"))


def cells_of(sums: DataFrame) -> DataFrame:
    """part and an array of 32 counts for each label."""
    numbers = F.sequence(F.lit(0), F.lit(MASKS - 1))

    def count(mask: Column) -> Column:
        return F.aggregate(numbers, F.lit(0).cast("long"), lambda total, s: total + F.get(F.col("sums"), s) * sign(s, mask))

    cells = sums.select("part", "label", F.transform(numbers, lambda m: F.floor(count(m) / MASKS).cast("long")).alias("cells"))
    none = F.array_repeat(F.lit(0).cast("long"), MASKS)
    return cells.groupBy("part").agg(*[F.coalesce(F.max(F.when(F.col("label") == x, F.col("cells"))), none).alias(x) for x in LABELS])


def steps() -> Column:
    """Each filter after each set of earlier filters, with the orders and steps that meet it."""
    met: dict = {}
    for order in ORDERS:
        for k, name in enumerate(order):
            met.setdefault((FILTERS.index(name), sum(1 << FILTERS.index(x) for x in order[:k])), []).append((order, k + 1))
    at = [F.struct(F.lit(f).alias("f"), F.lit(p).alias("p"), F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step")) for o, k in orders]).alias("orders")) for (f, p), orders in met.items()]
    return F.array(*at)


def evaluate(cells: DataFrame) -> DataFrame:
    """part, filter_order, step and what the step does, for all 120 orders."""
    met = cells.select("*", F.explode(steps()).alias("s")).select("*", "s.f", "s.p", "s.orders")
    fails = F.expr("shiftleft(1, f)")

    def total(label: str, where, weight=None) -> Column:
        def add(sum_: Column, m: Column) -> Column:
            n = F.get(F.col(label), m)
            return sum_ + F.when(where(m), n * weight(m) if weight else n).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long"), add)

    here = lambda m: (m.bitwiseAND(fails) != 0) & (m.bitwiseAND(F.col("p")) == 0)
    counts = {
        "kept": total("all", lambda m: m.bitwiseAND(fails.bitwiseOR(F.col("p"))) == 0),
        "removed": total("all", here),
        "redundant": total("all", lambda m: (m.bitwiseAND(fails) != 0) & (m.bitwiseAND(F.col("p")) != 0)),
        "unique_fails": F.get(F.col("all"), fails),
        "good_lost": total("good", here),
        "toxic_lost": total("toxic", here),
        "shapley": total("all", lambda m: m.bitwiseAND(fails) != 0, lambda m: F.floor(F.lit(120) / F.greatest(F.bit_count(m), F.lit(1))).cast("long")),
    }
    told = met.select("part", "orders", *[c.alias(name) for name, c in counts.items()])
    return told.select("part", F.explode("orders").alias("o"), *counts).select("part", "o.filter_order", "o.step", *counts)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """For each part, order and step, what the step does. Texts are read once: their narrow cells are stored while the sums are made, a few rows a part."""
    cells, path = stored(text_cells(docs, labels, id_col, text_col, part_col))
    sums = cut_lineage(parity_sums(masks(cells)))
    remove(docs.sparkSession, path)
    return evaluate(cells_of(sums))


#: The same by counting documents directly for every order and step.
SQL = f"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents
), fails AS (
  SELECT w.part, [len(ws) < {MIN_WORDS}, 100 * len(list_distinct(ws)) < {MIN_DISTINCT} * len(ws), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_UPPER} * len(text),
    regexp_matches(text, '{MARKUP}'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)] AS f,
    coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM words w LEFT JOIN (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id) l ON w.doc_id = l.doc_id
), counts AS (
  SELECT part, f, len(list_filter(f, lambda x: x)) AS failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM fails GROUP BY part, f
), names AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM names a JOIN names b ON b.x <> a.x JOIN names c ON c.x NOT IN (a.x, b.x) JOIN names d ON d.x NOT IN (a.x, b.x, c.x) JOIN names e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), met AS (
  SELECT c.*, o, k, f[ascii(o[k]) - 64] AS fails_here, len(list_filter(range(1, k), lambda j: f[ascii(o[j]) - 64])) > 0 AS gone
  FROM counts c, orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS k)
)
SELECT part, o AS filter_order, k AS step,
  CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails_here), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND fails_here), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE gone AND fails_here), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (WHERE fails_here AND failed = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (WHERE NOT gone AND fails_here), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails_here), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(120 * n // greatest(failed, 1)) FILTER (WHERE fails_here), 0) AS BIGINT) AS shapley
FROM met GROUP BY part, o, k
"""
