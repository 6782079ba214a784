"""Everything a content case reports, from one pass over the joined rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..frames import durable, side_by_side
from ..operators.keys import key_counts, key_shape
from ..operators.reconcile import (
    BOTH, ONLY_SOURCE, ONLY_TARGET, Pair, column_details, column_summary, key_frames, reconcile, sample_keys,
)
from .verdicts import content_verdict


@dataclass(frozen=True)
class ContentReport:
    """Verdict, differing columns, differing cells and the first keys of each kind of difference."""

    verdict: DataFrame
    columns: DataFrame
    cells: DataFrame
    mismatched_keys: DataFrame
    only_source_keys: DataFrame
    only_target_keys: DataFrame
    differences: DataFrame


def content_report(pair: Pair, limit: int | None = 10) -> ContentReport:
    """Run the join once and keep only the rows that differ, in a reliable checkpoint; all reports read those.

    Rows that match are not stored: their number follows from the counted keys and the differences.
    """
    differences = durable(reconcile(pair).where(~F.col("matched")))
    shape = key_shape(key_counts(*key_frames(pair)))
    common = shape.select("common").first()[0]
    mismatched = differences.agg(F.count_if(F.col("status") == BOTH).alias("mismatched"))
    row = side_by_side(shape, mismatched).select(
        *[
            F.col(f"src_{c}").alias(c)
            for c in ("src_rows", "src_distinct", "tgt_rows", "tgt_distinct", "common", "only_source", "only_target")
        ],
        (F.col("src_src_rows") - F.col("src_src_distinct")).alias("src_duplicate"),
        (F.col("src_tgt_rows") - F.col("src_tgt_distinct")).alias("tgt_duplicate"),
        F.col("tgt_mismatched").alias("mismatched"), (F.col("src_common") - F.col("tgt_mismatched")).alias("matched"),
    )
    of = lambda status: differences.where(F.col("status") == status)
    # Rows left out of the differences match in every column.
    columns = column_summary(of(BOTH)).withColumns({
        "rows_common": F.lit(common).cast("bigint"), "rows_matched": F.lit(common) - F.col("rows_mismatched"),
    })
    keys, few = list(pair.keys), limit
    return ContentReport(
        verdict=content_verdict(pair, row), columns=columns, cells=column_details(differences, keys, limit),
        mismatched_keys=sample_keys(of(BOTH), keys, few), only_source_keys=sample_keys(of(ONLY_SOURCE), keys, few),
        only_target_keys=sample_keys(of(ONLY_TARGET), keys, few), differences=differences,
    )
