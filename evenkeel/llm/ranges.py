"""Rows cut into key ranges: chunks that one task sorts, and what each chunk takes over from the chunks before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

CHUNK = "__chunk"


def chunked(df: DataFrame, order: Sequence[str], label: str) -> tuple[DataFrame, str]:
    """The rows with ``__chunk``, the number of their key range, written once; and the path of the table.

    Chunks ascend with ``order``, nulls first. The last column of ``order`` must tell equal rows apart, so that rows of one
    key can be cut into several chunks too.
    """
    return stored(df.repartitionByRange(*[F.col(c) for c in order]).withColumn(CHUNK, F.spark_partition_id()), label)


def ranked(df: DataFrame, group: str, order: Sequence[str], label: str) -> tuple[DataFrame, str]:
    """``df`` with ``__rank`` (from 0) and ``__total`` of its rows in their group, and the path of the table it reads.

    A group may span any number of chunks; a chunk numbers its own rows, and starts where the chunks before it end. The table
    of starts has one row for each group in each chunk.
    """
    rows, path = chunked(df, [group, *order], label)
    counts = rows.groupBy(group, CHUNK).agg(F.count(F.lit(1)).alias("__rows"))
    whole = Window.partitionBy(group)
    before = whole.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(group).alias("__of"), F.col(CHUNK).alias("__in"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"),
        F.sum("__rows").over(whole).alias("__total"),
    )
    own = F.row_number().over(Window.partitionBy(CHUNK, group).orderBy(*[F.col(c) for c in order])) - 1
    placed = rows.withColumn("__own", own).join(starts, (F.col(CHUNK) == F.col("__in")) & (F.col(group) == F.col("__of")))
    return placed.withColumn("__rank", F.col("__own") + F.col("__start")).drop("__own", "__start", "__in", "__of", CHUNK), path
