"""Incremental loads with their high-water marks as stored state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import col
from ..operators.history import changed_since
from ..operators.keys import key_counts
from ..operators.reconcile import Pair, counts, reconcile
from ..sources.sinks import replace_load

_MEASURES = ("src_rows src_distinct src_duplicate tgt_rows tgt_distinct tgt_duplicate common matched mismatched only_source "
             "only_target src_unstamped tgt_unstamped src_late tgt_late").split()
STATE = ", ".join(["source string", "run string", "mark string", "next_mark string", *[f"{m} bigint" for m in _MEASURES]])


def marks(spark: SparkSession, path: str) -> DataFrame:
    """The stored state: one row per source and run; no rows before the first load."""
    try:
        return spark.read.schema(STATE).parquet(path).select(*[f.split()[0] for f in STATE.split(", ")])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE)


def incremental_state(src: DataFrame, tgt: DataFrame, keys: Sequence[str], ts: str, path: str, source: str, run: str) -> DataFrame:
    """Check what changed after the source's last mark, and store the counts together with the new mark; returns that row.

    The mark is the greatest one of the source's other runs, so a run that is repeated starts from the same mark and replaces its row. Rows
    without a timestamp are checked by the first load, which checks all rows, and counted by each load as ``src_unstamped`` and ``tgt_unstamped``. Late rows have a timestamp up to
    the mark and a key that the other side lacks. The new mark is the greatest timestamp of the source, or the old one.
    """
    spark = src.sparkSession
    kind = src.select(col(ts)).schema[0].dataType
    earlier = marks(spark, path).where((F.col("source") == source) & (F.col("run") != run))
    mark = earlier.agg(F.max(F.col("next_mark").cast(kind)).alias("mark")).first()[0]
    pair = Pair(changed_since(src, ts, F.lit(mark).cast(kind)), changed_since(tgt, ts, F.lit(mark).cast(kind)), keys)
    if mark is not None:
        old = lambda df: df.where(col(ts) <= F.lit(mark).cast(kind))
        seen = key_counts(old(src), tgt, keys), key_counts(src, old(tgt), keys)
        late = [
            seen[0].agg(F.coalesce(F.sum(F.when(F.col("tgt_rows") == 0, F.col("src_rows"))), F.lit(0).cast("bigint"))).scalar(),
            seen[1].agg(F.coalesce(F.sum(F.when(F.col("src_rows") == 0, F.col("tgt_rows"))), F.lit(0).cast("bigint"))).scalar(),
        ]
    else:
        late = [F.lit(0).cast("bigint")] * 2
    stamps = lambda df: df.agg(F.count_if(col(ts).isNull())).scalar()
    newest = src.agg(F.greatest(F.max(col(ts)), F.lit(mark).cast(kind)).cast("string")).scalar()
    row = counts(reconcile(pair)).select(
        F.lit(source).alias("source"), F.lit(run).alias("run"), F.lit(mark).cast("string").alias("mark"), newest.alias("next_mark"),
        *_MEASURES[:11], stamps(src).alias("src_unstamped"), stamps(tgt).alias("tgt_unstamped"), late[0].alias("src_late"), late[1].alias("tgt_late"),
    )
    replace_load(row, path, "source", "run")
    return marks(spark, path).where((F.col("source") == source) & (F.col("run") == run))
