"""Small frame utilities used by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, from ``spark.checkpoint.dir``.

    Only a local master may run without the setting: there a temporary folder is the shared one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="evenkeel-")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else writes to."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """The same rows, computed once and stored reliably: later stages do not recompute them."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stack_rows(df: DataFrame, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn each input row into one output row per dict; used to list the measures of one aggregate row."""
    structs = [F.struct(*[value.alias(name) for name, value in row.items()]) for row in rows]
    return df.select(F.inline(F.array(*structs)))


def side_by_side(src_row: DataFrame, tgt_row: DataFrame) -> DataFrame:
    """Join two one-row frames into one row ``src_*, tgt_*`` with a union, so no join is planned."""
    src_names, tgt_names = src_row.columns, tgt_row.columns
    both = src_row.select(*[F.col(n).alias(f"src_{n}") for n in src_names]).unionByName(
        tgt_row.select(*[F.col(n).alias(f"tgt_{n}") for n in tgt_names]), allowMissingColumns=True
    )
    return both.agg(*[F.max(n).alias(n) for n in both.columns])


def passed(condition: Column) -> Column:
    return F.when(condition, "Passed").otherwise("Failed")
