"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Entries a worker keeps of any of its word caches before it starts anew; bytes of text that a function gets at once;
#: rows (of a few numbers each) up to which a table is broadcast.
CACHE_ENTRIES, SLICE_BYTES, BROADCAST_ROWS = 200_000, 8 << 20, 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a local session gets one of its own; a cluster is refused."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as written to the shared folder: a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again, with its path."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete what stored() wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def slices(batch: pa.RecordBatch, at_once: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in parts of about at_once bytes or a single row, so that what Python makes of one is bounded whatever the rows' length."""
    step = max(1, batch.num_rows * at_once // max(batch.nbytes, 1))
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)


def small(df: DataFrame) -> DataFrame:
    """df, which is stored, marked for broadcast if it has BROADCAST_ROWS rows at most (it is counted); else Spark shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, at_once: int = SLICE_BYTES) -> DataFrame:
    """function on slices (of about at_once bytes) of each Arrow batch of df; it may return None for no rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at_once):
                if (out := function(part)) is not None:
                    yield out

    return df.mapInArrow(each, schema)


def map_rows(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: StructType) -> DataFrame:
    """map_batches for functions that pass df's columns on, by their place: Python is given the names _0, _1 and so on, as it takes no dots in names."""
    return map_batches(df.toDF(*[f"_{k}" for k in range(len(df.columns))]), function, StructType([StructField(f"_{k}", f.dataType, f.nullable) for k, f in enumerate(schema)])).toDF(*schema.names)


def quoted(name: str) -> Column:
    """The column of that name, whatever signs the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def without_column(columns: list[str], name: str | None) -> list[str]:
    """columns but the one that an own result column of that name replaces (Spark tells names without their case)."""
    return [c for c in columns if name is None or c.lower() != name.lower()]


def texts_utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts as UTF-8, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def texts_str(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


_cache: dict = {}


def worker_cache(key, make: Callable[[], object]):
    """What make() returned in this Python worker for key. A worker serves many stages; it holds the cache of the last one only."""
    if key not in _cache:
        _cache.clear()
        _cache[key] = make()
    return _cache[key]


def forget_caches() -> None:
    """Free what worker_cache() holds in this worker: for stages that need none of it and memory of their own."""
    _cache.clear()


class HashedWords(dict):
    """word (bytes) -> 64-bit hash of its normal form, the same in every process; holds CACHE_ENTRIES words at most."""

    def __init__(self, normal: Callable[[bytes], bytes]) -> None:
        self.normal = normal

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(self.normal(word))
        return value
