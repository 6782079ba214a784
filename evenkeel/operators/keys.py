"""Key level operators: everything here shuffles counted keys, never whole rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.values import col


def key_counts(
    src: DataFrame, tgt: DataFrame, keys: Sequence[str], tgt_keys: Sequence[str] | None = None,
    labels: tuple[str, str] = ("src_rows", "tgt_rows"),
) -> DataFrame:
    """One row per key with the rows of each side; partial counts are made before the one shuffle."""
    tgt_keys = tgt_keys or keys
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = src.select(*[col(k).alias(k) for k in keys], one.alias("__s"), none.alias("__t")).union(
        tgt.select(*[col(k) for k in tgt_keys], none, one)
    )
    return both.groupBy(*[col(k) for k in keys]).agg(
        F.sum("__s").alias(labels[0]), F.sum("__t").alias(labels[1])
    )


def key_shape(counts: DataFrame) -> DataFrame:
    """One row of totals over :func:`key_counts`: rows, distinct and repeated keys, pairing counts."""
    s, t = F.col("src_rows"), F.col("tgt_rows")
    zero = F.lit(0).cast("bigint")
    total = lambda c: F.coalesce(F.sum(c), zero)
    return counts.agg(
        total(s).alias("src_rows"), total(t).alias("tgt_rows"),
        F.count_if(s > 0).alias("src_distinct"), F.count_if(t > 0).alias("tgt_distinct"),
        F.count_if(s > 1).alias("src_repeated"), F.count_if(t > 1).alias("tgt_repeated"),
        F.count_if(F.greatest(s, t) > 1).alias("repeated"),
        F.coalesce(F.max(s), zero).alias("src_largest"), F.coalesce(F.max(t), zero).alias("tgt_largest"),
        total(F.least(s, t)).alias("common"),
        total(F.greatest(s - t, zero)).alias("only_source"),
        total(F.greatest(t - s, zero)).alias("only_target"),
    )


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[col(k) for k in keys]).distinct()


def dup_keys(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """Keys that occur more than once with their row count; ``limit`` keeps the first in key order."""
    key_cols = [col(k) for k in keys]
    found = df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    found = found if limit is None else found.orderBy(*key_cols).limit(limit)
    return found.withColumnRenamed("__n", "rows")
