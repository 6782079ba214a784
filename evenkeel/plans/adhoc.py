"""Ad-hoc SQL over the data of a side."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import col
from ..sources.readers import manual_query, query_text


def adhoc_sql(
    spark: SparkSession, sql: str, frames: Mapping[str, DataFrame], limit: int | None = 3, order: Sequence[str] = ()
) -> DataFrame:
    """The first rows of a query over named frames: in the query's own order if it has one, else by the given columns or by all."""
    rows = manual_query(spark, sql, **frames)
    if limit is None:
        return rows
    if not order and _has_order(sql):
        return rows.limit(limit)
    return rows.orderBy(*[col(c) for c in (order or rows.columns)]).limit(limit)


def _has_order(sql: str) -> bool:
    """Whether the outermost query is ordered: quoted text, comments and everything in brackets left out."""
    text = re.sub(r"'[^']*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", query_text(sql), flags=re.S)
    while (inner := re.sub(r"\([^()]*\)", " ", text)) != text:
        text = inner
    return re.search(r"\border\s+by\b", text, re.I) is not None


def adhoc_bulk(
    spark: SparkSession, queries: Sequence[str], frames: Mapping[str, DataFrame], limit: int = 3
) -> DataFrame:
    """The first rows of each query as JSON: ``query_no, row_no, sql, row_json``. ``limit`` bounds the rows that are gathered."""
    if limit is None:
        raise ValueError("a bulk preview needs a limit")
    parts = []
    for no, sql in enumerate(queries, start=1):
        first = adhoc_sql(spark, sql, frames, limit)
        # The limit leaves one ordered partition, whose rows are numbered as they come.
        numbered = first.select(F.monotonically_increasing_id().alias("no"), F.struct(*[col(c) for c in first.columns]).alias("row"))
        rows = numbered.agg(F.sort_array(F.collect_list(F.struct("no", "row"))).alias("rows"))
        parts.append(rows.select(F.posexplode("rows.row").alias("row_no", "row")).select(
            F.lit(no).alias("query_no"), (F.col("row_no") + 1).alias("row_no"), F.lit(sql).alias("sql"),
            F.to_json("row").alias("row_json"),
        ))
    return reduce(DataFrame.unionByName, parts)
