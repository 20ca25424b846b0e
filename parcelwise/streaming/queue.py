"""The job queue: due jobs, retries and stale locks as batch transformations, and as a Structured Streaming job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

#: Seconds until a failed job runs again, until a held one counts as lost; attempts of a job.
RETRY_SECONDS, TIMEOUT_SECONDS, MAX_ATTEMPTS = 30, 1800, 3
STATES = ["queued", "running", "done", "failed"]


def depth(jobs: DataFrame, kinds: list[str] | None = None, column: str = "status") -> DataFrame:
    """Number of jobs by state, zero where there is none."""
    all_ = jobs.sparkSession.createDataFrame([(k,) for k in kinds or STATES], f"{column} string")
    return all_.join(jobs.groupBy(column).agg(F.count(F.lit(1)).alias("jobs")), column, "left").na.fill(0, ["jobs"])


def enqueued(jobs: DataFrame, now: Column) -> DataFrame:
    """New jobs (job, kind, delay in seconds) as rows of the queue; a recomparison has two attempts, others MAX_ATTEMPTS."""
    most = F.when(F.col("kind") == "recompare", 2).otherwise(MAX_ATTEMPTS)
    none = F.lit(None).cast("timestamp")
    return jobs.select("job", "kind", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), most.alias("max_attempts"), (now + F.make_dt_interval(secs=F.col("delay"))).alias("run_at"), none.alias("locked_at"))


def due(jobs: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Queued jobs whose time has come, oldest first."""
    rows = jobs.filter((F.col("status") == "queued") & (F.col("run_at") <= now)).orderBy("run_at", "job")
    return rows.limit(limit) if limit else rows


def after_run(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs (with ok: whether the run succeeded) as they stand after it: done, queued again later, or failed for good."""
    attempts = F.col("attempts") + 1
    status = F.when(F.col("ok"), "done").when(attempts < MAX_ATTEMPTS, "queued").otherwise("failed")
    again = F.when(~F.col("ok") & (attempts < MAX_ATTEMPTS), now + F.expr(f"INTERVAL {RETRY_SECONDS} SECONDS")).otherwise(F.col("run_at"))
    return jobs.withColumns({"status": status, "run_at": again, "attempts": attempts})


def release_stale(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs with lost locks released: queued again, or failed if no attempt is left."""
    stale = (F.col("status") == "running") & (F.col("locked_at") < now - F.expr(f"INTERVAL {TIMEOUT_SECONDS} SECONDS"))
    status = F.when(stale & (F.col("attempts") >= MAX_ATTEMPTS), "failed").when(stale, "queued").otherwise(F.col("status"))
    return jobs.withColumns({"status": status, "locked_at": F.when(stale, F.lit(None)).otherwise(F.col("locked_at"))})


def run_stream(spark: SparkSession, path: str, schema: StructType, checkpoint: str, process: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Job files of a folder in micro-batches: each job belongs to one batch, and process must replace what it writes, so that a repeated batch does no harm."""
    writer = spark.readStream.schema(schema).json(path).writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()
