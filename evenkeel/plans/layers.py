"""Checks of mapped loads: source-except-target per layer hop, and validations after a mapping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..operators.fingerprint import set_difference
from ..operators.mapping import MappingRow, SOURCE_TO_TARGET, apply_mapping, target_select


@dataclass(frozen=True)
class LayerHop:
    """One hop of a layered load: the rows before it, the rows after it, and the mapping in between."""

    name: str
    source: DataFrame
    target: DataFrame
    rows: Sequence[MappingRow]
    hop: str = SOURCE_TO_TARGET
    lookups: dict[str, DataFrame] = field(default_factory=dict)
    where: str | None = None
    target_where: str | None = None
    trim: bool = False

    def sides(self) -> tuple[DataFrame, DataFrame]:
        src = apply_mapping(self.source, self.rows, self.hop, self.lookups, self.where, trim=self.trim)
        return src, target_select(self.target, self.rows, self.target_where)


def data_check(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Distinct rows of the mapped source that the target lacks, and the reverse, with their side."""
    return set_difference(src, tgt)


def layer_report(hops: Sequence[LayerHop]) -> DataFrame:
    """Per hop: distinct rows missing in the target, distinct rows the source does not explain, verdict."""
    out = None
    for i, hop in enumerate(hops, start=1):
        found = data_check(*hop.sides()).agg(
            F.count_if(F.col("side") == "source").alias("missing_in_target"),
            F.count_if(F.col("side") == "target").alias("not_in_source"),
        )
        clean = (F.col("missing_in_target") == 0) & (F.col("not_in_source") == 0)
        row = found.select(
            F.lit(i).alias("hop_no"), F.lit(hop.name).alias("hop"), "missing_in_target", "not_in_source",
            F.when(clean, "Passed").otherwise("Failed").alias("result"),
        )
        out = row if out is None else out.unionByName(row)
    return out
