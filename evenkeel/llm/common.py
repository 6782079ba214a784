"""Tables of a run, intermediate tables in the shared folder and Arrow helpers of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..frames import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Bytes of a batch that are worked on together.
PIECE = 1 << 22


def register(name: str, sql: str | None = None):
    """Register ``build(spark, sf_dir) -> DataFrame``, with the SQL that gives the same rows if there is one."""
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows written once to the shared folder and read back, so a lost executor costs no recomputation; and their path."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def with_fields(schema: T.StructType, fields: str, drop: str = "") -> T.StructType:
    """A new schema with more fields, in DDL, and without one."""
    return T.StructType([f for f in schema.fields if f.name != drop] + T.StructType.fromDDL(fields).fields)


#: What workers keep between tasks, by the function that makes it.
_KEPT: list = []


def kept_by_workers(size: int):
    """An ``lru_cache`` that a worker holds for tasks of the same module; a task of another one drops it."""
    def keep(make):
        _KEPT.append(lru_cache(maxsize=size)(make))
        return _KEPT[-1]

    return keep


def drop_kept(module: str) -> None:
    """Drop what tasks of other modules left in this worker: workers live on through later stages."""
    for cache in _KEPT:
        if cache.__module__ != module:
            cache.cache_clear()
    give_back()


def give_back() -> None:
    """Free memory goes back to the system, Arrow's and, where the C library can do it, that of Python and numpy."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def limit_batches(spark: SparkSession) -> None:
    """From now on Spark ends an Arrow batch of this session at ``PIECE`` bytes, so neither the executor nor its worker holds a larger one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{PIECE}b")


def map_batches(df: DataFrame, build: Callable[[pa.RecordBatch], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """Apply ``build`` to pieces of Arrow batches of about ``PIECE`` bytes; it yields dicts of columns, which take the declared types.

    A batch may hold thousands of long texts; what ``build`` makes of them is held for one piece at a time.
    """
    limit_batches(df.sparkSession)
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow, module = to_arrow_schema(out), build.__module__

    def run(batches):
        drop_kept(module)
        for piece in (piece for batch in batches for piece in _pieces(batch)):
            for columns in build(piece):
                arrays = [_typed(columns[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        # The worker stays for later tasks; what this one no longer needs goes back to the system.
        give_back()

    return df.mapInArrow(run, out)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = max(1, batch.num_rows * PIECE // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _typed(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)
