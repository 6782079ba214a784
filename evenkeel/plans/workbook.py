"""A mapping workbook run from its own sheets: configuration, schema and mapping."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..operators.mapping import SOURCE_TO_TARGET, apply_mapping
from ..sources.readers import read_source
from ..sources.sheets import load_mapping, workbook_header, workbook_sources
from .suite import Case


def workbook_case(spark: SparkSession, folder: str, hop: str = SOURCE_TO_TARGET) -> Case:
    """The workbook in ``folder`` as a case: both sides as its configuration sheet says, compared through its mapping by the target's key.

    Text files take the declared columns, with lengths and scales; the other formats bring their own.
    """
    config, sheets = workbook_header(spark, folder), load_mapping(spark, folder, hop)
    declare = lambda spec, ddl: replace(spec, schema=ddl) if spec.format.lower() in ("delimited", "json") else spec
    source, target = workbook_sources(config, hop)
    return Case(
        name=config.get("mappingname") or "mapping", keys=sheets.keys, source=declare(source, sheets.source_schema),
        target=declare(target, sheets.target_schema), mapping=sheets.rows, hop=hop,
        trim=config.get("trimwhitespaces", "").upper() == "Y",
    )


def mapped_rows(spark: SparkSession, folder: str, hop: str = SOURCE_TO_TARGET) -> DataFrame:
    """The rows that the workbook makes of its source, without repeats if its configuration asks for that."""
    case = workbook_case(spark, folder, hop)
    rows = apply_mapping(read_source(spark, case.source), case.mapping, hop, case.lookups, trim=case.trim)
    return rows.distinct() if workbook_header(spark, folder).get("removeduplicates", "").upper() == "Y" else rows
