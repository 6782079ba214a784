"""Profile of a data set as (column, metric, value) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..frames import stack_rows
from ..functions.values import col, text_mask
from .fingerprint import value_counts
from .ordinal import CHUNK_ROWS, positions
from .sketches import describe, profile_state

QUANTILES = (0.25, 0.5, 0.75)


def _typed(df: DataFrame, kind) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, kind)]


def quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = QUANTILES, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Exact quantiles as (column, metric, value): the smallest value that at least that share of the rows does not exceed.

    Values are counted first and placed by :func:`positions`, so no task holds the values of a whole column.
    """
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("value")) for c in columns
    ]))).where(F.col("value").isNotNull())
    placed = positions(cells, ["column"], ["value"], chunk_rows)
    totals = df.agg(*[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    wanted = stack_rows(totals, [
        {
            "__column": F.lit(c), "metric": F.lit(f"q{p * 100:g}"),
            "__rank": F.greatest(F.ceil(F.lit(p) * F.col(f"c{i}")), F.lit(1)),
        }
        for i, c in enumerate(columns) for p in probabilities
    ])
    # One row per column and probability: small whatever the data size.
    inside = (F.col("__rank") > F.col("__before")) & (F.col("__rank") <= F.col("__before") + F.col("__n"))
    found = placed.join(F.broadcast(wanted), (F.col("column") == F.col("__column")) & inside)
    return found.select("column", "metric", "value")


def profile_numeric(
    df: DataFrame, columns: Sequence[str] | None = None, accuracy: int = 10_000, exact: bool = False
) -> DataFrame:
    """count, nulls, min, max, mean, sd and quartiles of every numeric column, from one aggregate.

    Quartiles are ``percentile_approx`` (rank error at most 1/accuracy of the rows, memory bounded by the accuracy),
    or with ``exact`` come from :func:`quantiles`.
    """
    columns = list(columns or _typed(df, T.NumericType))
    parts, rows = [F.count(F.lit(1)).alias("__rows")], []
    for i, c in enumerate(columns):
        v = col(c)
        measures = {
            "count": F.count(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v), "sd": F.stddev_samp(v),
        }
        if not exact:
            measures["quantiles"] = F.percentile_approx(v, list(QUANTILES), accuracy)
        parts += [m.alias(f"{name}{i}") for name, m in measures.items()]
        show = lambda metric, value, c=c: {
            "column": F.lit(c), "metric": F.lit(metric), "value": value.cast("double")
        }
        rows += [
            show("count", F.col(f"count{i}")), show("nulls", F.col("__rows") - F.col(f"count{i}")),
            show("min", F.col(f"min{i}")), show("max", F.col(f"max{i}")), show("mean", F.col(f"mean{i}")),
            show("sd", F.col(f"sd{i}")),
        ]
        if not exact:
            rows += [show(f"q{q * 100:g}", F.col(f"quantiles{i}")[j]) for j, q in enumerate(QUANTILES)]
    out = stack_rows(df.agg(*parts), rows)
    return out.unionByName(quantiles(df, columns)) if exact else out


def profile_string(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, nulls, blanks, shortest and longest length, smallest and largest value of every text column."""
    columns = list(columns or _typed(df, T.StringType))
    parts, rows = [F.count(F.lit(1)).alias("__rows")], []
    for i, c in enumerate(columns):
        v = col(c)
        parts += [
            F.count(v).alias(f"count{i}"), F.count_if(F.trim(v) == "").alias(f"blank{i}"),
            F.min(F.length(v)).alias(f"short{i}"), F.max(F.length(v)).alias(f"long{i}"),
            F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"),
        ]
        show = lambda metric, value, c=c: {
            "column": F.lit(c), "metric": F.lit(metric), "value": value.cast("string")
        }
        rows += [
            show("count", F.col(f"count{i}")), show("nulls", F.col("__rows") - F.col(f"count{i}")),
            show("blanks", F.col(f"blank{i}")), show("min_length", F.col(f"short{i}")),
            show("max_length", F.col(f"long{i}")), show("min", F.col(f"min{i}")), show("max", F.col(f"max{i}")),
        ]
    return stack_rows(df.agg(*parts), rows)


def profile_distinct(df: DataFrame, exact: bool = False, rsd: float = 0.02) -> DataFrame:
    """Distinct non-NULL values per column; a sketch per column in one pass, or exact from counted values."""
    if not exact:
        totals = df.agg(*[F.approx_count_distinct(col(c), rsd).alias(f"c{i}") for i, c in enumerate(df.columns)])
        return stack_rows(totals, [
            {"column": F.lit(c), "distinct_values": F.col(f"c{i}")} for i, c in enumerate(df.columns)
        ])
    return value_counts(df).groupBy("column").agg(F.count("value").alias("distinct_values"))


def profile_topk(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` most frequent values per column, ties by value; counted first, limited before the last shuffle."""
    counted = value_counts(df.select(*[col(c) for c in columns])).where(F.col("value").isNotNull())
    w = Window.partitionBy("column").orderBy(F.desc("rows"), "value")
    ranked = counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return ranked.select("column", "place", "value", "rows")


def profile_pattern(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text patterns per column with their rows: letters as ``A``, digits as ``9``."""
    masked = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), text_mask(col(c).cast("string")).alias("pattern")) for c in columns
    ])))
    return masked.where(F.col("pattern").isNotNull()).groupBy("column", "pattern").agg(
        F.count(F.lit(1)).alias("rows")
    )


def profile(df: DataFrame, topk: int = 10) -> DataFrame:
    """The whole profile as (column, metric, value) text rows, from one scan; see :mod:`.sketches` for the error bounds."""
    return describe(profile_state(df), topk)
