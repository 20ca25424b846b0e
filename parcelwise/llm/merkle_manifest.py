"""Merkle manifest of a dataset: a digest for each row, a tree for each group, one root, and a checked proof for each row.

Ranks come from a radix trie of counts: histograms of the ids without their last DIGIT bits, of those without their last two digits, and so
on until one prefix is left; each prefix starts where its parent starts and the smaller siblings end. Windows thus span the digits of one prefix or the rows of one,
never a group as a whole. The digits of a rank key the tree: all nodes that share a rank but for its last DIGIT bits are one block, reduced to one
node at a time, so a tree of n leaves takes log n / DIGIT rounds. On the way down each block is given the path above it.

Equal rows (all columns) are counted first and stay one row until their blocks are formed. Rows that share an id, but not all columns,
are ordered by their digest. Null ids come first and are ordered by digest, whose leading bits stand for the id. A null group comes
first, other groups follow bytewise. Any column may be null; an empty table gives no rows. Only the named columns are read; a text of any length is hashed in the JVM.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import remove, stored

#: Bits of a digit of ids and of ranks; a block has up to 2 ** DIGIT nodes. Nodes have two children.
DIGIT = 12
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
NODES = "g string, idx long, node string, n long"
PATHS = "g string, idx long, path array<string>, subroot string, root string"
PROVEN = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def record(columns: list[Column]) -> Column:
    """Each value as its length in UTF-8 bytes, a colon and itself, or - if it is null."""
    return F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns])


def leaves(docs: DataFrame) -> DataFrame:
    """g, f, r (what rows are ranked by: f tells null ids, r is the id), doc_id, leaf, tampered (null if the row is not), n."""
    at = {c: F.col(c) for c in COLUMNS}
    at["doc_id"] = at["doc_id"].cast("long")
    more = at | {"n_chars": at["n_chars"].cast("decimal(38,0)") + 1}
    hit = (F.crc32(at["doc_id"].cast("string")) % 7 == 0) & at["n_chars"].isNotNull()
    told = docs.select(
        F.coalesce(F.concat(F.lit("."), F.col("lang").cast("string")), F.lit("")).alias("g"), at["doc_id"].alias("doc_id"), F.sha2(record(list(at.values())), 256).alias("leaf"), F.when(hit, F.sha2(record(list(more.values())), 256)).alias("tampered")
    )
    by_digest = F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")
    told = told.select("g", F.col("doc_id").isNotNull().cast("int").alias("f"), F.coalesce("doc_id", by_digest).alias("r"), "doc_id", "leaf", "tampered")
    return told.groupBy(*told.columns).agg(F.count(F.lit(1)).alias("n"))


def _before(*partition: str) -> Window:
    return Window.partitionBy(*partition).rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(window: Window) -> Column:
    return F.coalesce(F.sum("n").over(window), F.lit(0))


def starts(counts: DataFrame, most: int, digit: int, kept: list[str]) -> DataFrame:
    """g, f, p, start, size: the first rank of each prefix p and the rows of its group, from rows of g, f, p, n; p lies from 0 to most. Histograms are stored, their paths go to kept."""
    levels = [counts]
    while most:
        most >>= digit
        levels[-1], path = stored(levels[-1])
        kept.append(path)
        levels.append(levels[-1].groupBy("g", "f", F.shiftright("p", digit).alias("p")).agg(F.sum("n").alias("n")))
    # one prefix is left for each group and f
    found = levels.pop().select("g", "f", "p", _sum_before(_before("g").orderBy("f")).alias("start"), F.sum("n").over(Window.partitionBy("g")).alias("size"))
    for level in reversed(levels):
        found, path = stored(found)
        kept.append(path)
        parents = found.select("g", "f", F.col("p").alias("parent"), F.col("start").alias("first"), "size")
        inner = level.withColumn("parent", F.shiftright("p", digit)).join(parents, ["g", "f", "parent"])
        found = inner.select("g", "f", "p", (F.col("first") + _sum_before(_before("g", "f", "parent").orderBy("p"))).alias("start"), "size")
    return found


def ranked(told: DataFrame, digit: int, kept: list[str]) -> DataFrame:
    """g, idx, block, reps, doc_id, leaf, tampered, n from stored leaves: rows of equal values are split where blocks end; n is the rows of the group."""
    digits = told.withColumn("p", F.shiftright("r", digit))
    least, most = digits.agg(F.min("p"), F.max("p")).first()
    if least is None:
        return told.select("g", F.lit(0).cast("long").alias("idx"), F.lit(0).cast("long").alias("block"), F.lit(0).alias("reps"), "doc_id", "leaf", "tampered", "n")
    digits = digits.withColumn("p", F.col("p") - least)  # from 0 on, as shifts of negative numbers never come to 0
    first = starts(digits.groupBy("g", "f", "p").agg(F.sum("n").alias("n")), most - least, digit, kept)
    rows = digits.join(first, ["g", "f", "p"]).withColumn("from", F.col("start") + _sum_before(_before("g", "f", "p").orderBy("r", "leaf")))
    rows = rows.withColumn("to", F.col("from") + F.col("n"))
    rows = rows.select("*", F.explode(F.sequence(F.shiftright("from", digit), F.shiftright(F.col("to") - 1, digit))).alias("block"))
    idx = F.greatest(F.col("from"), F.col("block") * (1 << digit))
    reps = F.least(F.col("to"), (F.col("block") + 1) * (1 << digit)) - idx
    return rows.select("g", idx.alias("idx"), "block", reps.cast("int").alias("reps"), "doc_id", "leaf", "tampered", F.col("size").alias("n"))


def subtree(nodes: list[str], n: int, digit: int) -> list[list[str]]:
    """The levels of a block over its nodes, themselves included, in a group of n nodes; the last one has one node."""
    levels = [nodes]
    for _ in range(digit if n > 1 << digit else (n - 1).bit_length()):
        below = levels[-1]
        levels.append([_hash("".join(below[k : k + 2])) for k in range(0, len(below), 2)])
    return levels


def _sorted(table: pa.Table, columns: list[str]) -> list[tuple]:
    """Rows of the named columns in order of idx, each as often as reps says."""
    table = table.sort_by("idx")
    rows = zip(*[table.column(c).to_pylist() for c in columns])
    if "reps" not in table.column_names:
        return list(rows)
    return [row for row, reps in zip(rows, table.column("reps").to_pylist()) for _ in range(reps)]


def reduce_blocks(nodes: DataFrame, digit: int, node: str = "node") -> DataFrame:
    """NODES of the next round: one for each block."""

    def up(table: pa.Table) -> pa.Table:
        g, block, n = (table.column(c)[0].as_py() for c in ("g", "block", "n"))
        levels = subtree([x for (x,) in _sorted(table, [node])], n, digit)
        left = -(-n // (1 << len(levels) - 1))
        return pa.table({"g": [g], "idx": pa.array([block], pa.int64()), "node": [levels[-1][0]], "n": pa.array([left], pa.int64())})

    return nodes.groupBy("g", "block").applyInArrow(up, NODES)


def blocked(nodes: DataFrame, digit: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("idx", digit))


def sibling_path(levels: list[list[str]], k: int) -> list[str]:
    """Of node k of the first level: the sibling at each level, after < if it stands left and > if right, or empty if there is none."""
    path = []
    for level in levels[:-1]:
        other = k ^ 1
        path.append("" if other >= len(level) else ("<" if other < k else ">") + level[other])
        k >>= 1
    return path


def fold(leaf: str, path: list[str]) -> str:
    for step in path:
        leaf = _hash(step[1:] + leaf if step[:1] == "<" else leaf + step[1:])
    return leaf


def _down(nodes: DataFrame, above: DataFrame, function, schema: str) -> DataFrame:
    """function(block's table, path above it, subroot, root) on each block."""

    def run(block: pa.Table, path: pa.Table) -> pa.Table:
        return function(block, path.column("path")[0].as_py(), path.column("subroot")[0].as_py(), path.column("root")[0].as_py())

    return nodes.groupBy("g", "block").cogroup(above.withColumnRenamed("idx", "block").groupBy("g", "block")).applyInArrow(run, schema)


def paths(nodes: DataFrame, above: DataFrame, digit: int) -> DataFrame:
    """PATHS of nodes (NODES with block) from those of the blocks above them."""

    def run(block: pa.Table, path: list[str], subroot: str | None, root: str) -> pa.Table:
        rows, n = _sorted(block, ["g", "idx", "node"]), block.column("n")[0].as_py()
        levels = subtree([r[2] for r in rows], n, digit)
        out = [sibling_path(levels, k) + path for k in range(len(rows))]
        return pa.table({"g": [r[0] for r in rows], "idx": pa.array([r[1] for r in rows], pa.int64()), "path": pa.array(out, pa.list_(pa.string())), "subroot": pa.array([subroot] * len(rows), pa.string()), "root": [root] * len(rows)})

    return _down(nodes, above, run, PATHS)


def proofs(rows: DataFrame, above: DataFrame, digit: int) -> DataFrame:
    """PROVEN of ranked rows: the digest of the siblings up to the root, and the root that they and the leaf as it is now give."""

    def run(block: pa.Table, path: list[str], subroot: str, root: str) -> pa.Table:
        held = _sorted(block, ["doc_id", "leaf", "tampered"])
        levels, out = subtree([r[1] for r in held], block.column("n")[0].as_py(), digit), []
        for k, (doc_id, leaf, tampered) in enumerate(held):
            way = sibling_path(levels, k) + path
            folded = fold(tampered or leaf, way)
            out.append((doc_id, leaf, subroot, root, _hash("".join(step[1:] for step in way)), folded, folded == root))
        columns = list(zip(*out))
        return pa.table({"doc_id": pa.array(columns[0], pa.int64()), **{name: pa.array(c, pa.string()) for name, c in zip(["leaf", "subroot", "root", "proof_sha256", "folded_root"], columns[1:6])}, "verified": pa.array(columns[6], pa.bool_())})

    return _down(rows, above, run, PROVEN)


def _positions(groups: DataFrame) -> tuple[DataFrame, str]:
    """groups (of distinct g) with idx, their place in bytewise order, and n; stored. Sorted by ranges, so no task sees all; counts of the ranges alone are summed in one."""
    parts, path = stored(groups.repartitionByRange("g").sortWithinPartitions("g").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("part", _sum_before(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("first"), F.sum("n").over(Window.partitionBy()).alias("all"))
    found = parts.drop("n").join(sizes, "part").withColumn("idx", F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy("g")) - 1)
    out = stored(found.select(F.lit("").alias("g"), "idx", "node", F.col("all").alias("n"), F.col("g").alias("of")))
    remove(groups.sparkSession, path)
    return out


def _rounds(nodes: DataFrame, digit: int, kept: list[str]) -> list[DataFrame]:
    """nodes (with block) and the rounds above them, the last of which has one node a group; their paths go to kept."""
    rounds = [nodes]
    while rounds[-1].filter("n > 1").limit(1).count():
        above, path = stored(reduce_blocks(rounds[-1], digit))
        kept.append(path)
        rounds.append(blocked(above, digit))
    return rounds


def manifest(docs: DataFrame, digit: int = DIGIT) -> DataFrame:
    """PROVEN of each row. Two stored tables of digests, and the nodes above them, serve the result and stay with it."""
    spark, kept = docs.sparkSession, []
    told, path = stored(leaves(docs))
    kept.append(path)
    rows, _ = stored(ranked(told, digit, kept))
    nodes, path = stored(reduce_blocks(rows, digit, "leaf"))
    kept.append(path)
    trees = _rounds(blocked(nodes, digit), digit, kept)
    subroots, path = _positions(trees[-1].select("g", "node"))
    kept.append(path)
    tops = _rounds(blocked(subroots, digit), digit, kept)
    above = tops[-1].select("g", "idx", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    for level in reversed(tops[:-1]):
        above = paths(level, above, digit)
    above = above.drop("g", "subroot").join(subroots.select("idx", F.col("of").alias("g"), F.col("node").alias("subroot")), "idx").select("g", F.lit(0).cast("long").alias("idx"), "path", "subroot", "root")
    for level in reversed(trees[:-1]):
        above = paths(level, above, digit)
    above, _ = stored(above)
    for path in kept:
        remove(spark, path)
    return proofs(rows, above, digit)


def _sql_record(n_chars: str) -> str:
    names = ["doc_id", "source", "lang", n_chars, "text"]
    return " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in names)


#: The same over the table documents: levels by recursion, CRC-32 bit by bit.
SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce('.' || lang, '') AS g, sha256({_sql_record("n_chars")}) AS leaf, sha256({_sql_record("(n_chars + 1)")}) AS tampered,
    coalesce(xor(list_reduce([4294967295] || list_transform(range(1, 1 + length(CAST(doc_id AS VARCHAR))), lambda k: CAST(ascii(CAST(doc_id AS VARCHAR)[k]) AS BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 7 = 0, false) AS hit
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM base
), tree(g, level, idx, node, n) AS (
  SELECT g, 0, idx, leaf, n FROM ranked
  UNION ALL
  SELECT g, level + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, level, idx // 2, n
), subroots AS (
  SELECT g, node, level AS height, row_number() OVER (ORDER BY encode(g)) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1
), top(level, idx, node, n) AS (
  SELECT 0, idx, node, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, idx // 2, n
), steps AS (
  SELECT r.g, r.idx, t.level AS k, t.node, t.idx < (r.idx >> t.level) AS before
  FROM ranked r JOIN subroots s ON s.g = r.g JOIN tree t ON t.g = r.g AND t.level < s.height AND t.idx = xor(r.idx >> t.level, 1)
  UNION ALL
  SELECT r.g, r.idx, s.height + t.level, t.node, t.idx < (s.idx >> t.level)
  FROM ranked r JOIN subroots s ON s.g = r.g JOIN top t ON t.n > 1 AND t.idx = xor(s.idx >> t.level, 1)
), folds(g, idx, k, h, height) AS (
  SELECT r.g, r.idx, 0, CASE WHEN hit THEN tampered ELSE leaf END, s.height + (SELECT max(level) FROM top)
  FROM ranked r JOIN subroots s ON s.g = r.g
  UNION ALL
  SELECT f.g, f.idx, f.k + 1, sha256(CASE WHEN t.before THEN t.node || f.h ELSE f.h || coalesce(t.node, '') END), f.height
  FROM folds f LEFT JOIN steps t ON t.g = f.g AND t.idx = f.idx AND t.k = f.k WHERE f.k < f.height
)
SELECT r.doc_id, r.leaf, s.node AS subroot, (SELECT node FROM top WHERE n = 1) AS root,
  sha256(coalesce(p.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = (SELECT node FROM top WHERE n = 1) AS verified
FROM ranked r JOIN subroots s ON s.g = r.g JOIN folds f ON f.g = r.g AND f.idx = r.idx AND f.k = f.height
LEFT JOIN (SELECT g, idx, string_agg(node, '' ORDER BY k) AS proof FROM steps GROUP BY g, idx) p ON p.g = r.g AND p.idx = r.idx
"""
