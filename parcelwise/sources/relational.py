"""The relational store: analyses, extractions, observations and findings as tables bucketed and sorted by their pair.

All four have the same number of buckets, so joins and aggregations by pair read bucket by bucket: no table is shuffled again. The number of buckets is chosen
once for the store (a bucket should fit a task's memory: bytes of the largest table by 128 MB), and a pair's rows are few, so no bucket is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["analyses", "extractions", "observations", "findings"]
#: Rows of the largest table to a bucket, and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 4_000_000, 8


def buckets_of(rows: int) -> int:
    """How many buckets a store has whose largest table has so many rows: what a task reads stays the same as tables grow."""
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def save(tables: dict[str, DataFrame], name: str, folder: str, buckets: int, key: str = "pair") -> None:
    """Write the tables as name_analyses and so on into folder. Each is shuffled once, into as many partitions as buckets, so that a bucket is one file."""
    for table in TABLES:
        df = tables[table]
        df.repartition(buckets, key).write.format("parquet").mode("overwrite").option("path", f"{folder}/{table}").bucketBy(buckets, key).sortBy(key).saveAsTable(f"{name}_{table}")


def load(spark: SparkSession, name: str) -> dict[str, DataFrame]:
    return {table: spark.table(f"{name}_{table}") for table in TABLES}


def overview(tables: dict[str, DataFrame], key: str = "pair") -> DataFrame:
    """A row for each analysis with its columns: documents, observations, unsure (those under the review threshold), findings, errors. Analyses without rows elsewhere have zeros."""
    count = lambda c: F.count(F.lit(1)).alias(c)
    parts = [
        tables["extractions"].groupBy(key).agg(count("documents")),
        tables["observations"].groupBy(key).agg(count("observations"), F.count_if((F.col("confidence") < 0.8) & ~F.col("edited")).alias("unsure")),
        tables["findings"].groupBy(key).agg(count("findings"), F.count_if(F.col("severity") == "error").alias("errors")),
    ]
    out = tables["analyses"]
    for part in parts:
        out = out.join(part.hint("merge"), key, "left")
    return out.na.fill(0, ["documents", "observations", "unsure", "findings", "errors"])


def with_finding(tables: dict[str, DataFrame], rules: list[str], key: str = "pair") -> DataFrame:
    """Analyses that have a finding of one of the rules."""
    return tables["analyses"].join(tables["findings"].filter(F.col("rule").isin(rules)).hint("merge"), key, "left_semi")
