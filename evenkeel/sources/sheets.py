"""Sheets: mapping, schema and suite tables kept as CSV, JSON or parquet (workbooks are exported to these)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.mapping import (
    HOPS, SOURCE_TO_STAGE, STAGE_TO_TARGET, MappingRow, mapping_rows, spark_type, with_schemas,
)
from .readers import SourceSpec


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet with its header; every CSV cell is text, blank cells are NULL. A byte-order mark is dropped."""
    if path.endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def suite_header(spark: SparkSession, path: str) -> dict[str, str]:
    """The key/value rows that describe a suite."""
    rows = spark.read.option("header", False).csv(path).collect()
    return {r[0]: r[1] for r in rows if r[0]}


def load_suite(spark: SparkSession, path: str) -> DataFrame:
    """The case rows of a suite; rows without a number are dropped."""
    df = read_sheet(spark, path)
    number = F.col("`Sno.`").cast("string")
    return df.where(F.trim(number) != "")


@dataclass(frozen=True)
class MappingSheets:
    """A mapping workbook for one hop: its rows, the declared schema of both layers, the key of the target."""

    rows: list[MappingRow]
    source_schema: str
    target_schema: str
    keys: list[str]


def declared_ddl(schema: DataFrame, layer: str) -> str:
    """The declared columns of a layer as a Spark DDL string; unknown type names fail when Spark parses it."""
    rows = schema.where(F.lower("tabletype") == layer).select("columnname", "datatype").collect()
    return ", ".join(f"`{r.columnname}` {spark_type(r.datatype)}" for r in rows)


# Declared types that take a length and a scale.
_SIZED = ("number", "numeric", "decimal", "dec")


def sized(schema: DataFrame) -> DataFrame:
    """A schema sheet whose number types carry their declared length and scale: ``number``, 12, 2 is ``decimal(12,2)``.

    Lengths over 38 are 38, the most Spark has; a number without a length keeps its name. Lengths of text are not types in Spark.
    """
    if "length" not in schema.columns:
        return schema
    cell = lambda name: F.col(name).cast("double").cast("int") if name in schema.columns else F.lit(None).cast("int")
    length = F.least(cell("length"), F.lit(38))
    scale = F.least(F.coalesce(cell("scale"), F.lit(0)), length)
    wide = F.lower(F.trim("datatype")).isin(*_SIZED) & (length > 0)
    return schema.withColumn("datatype", F.when(wide, F.format_string("decimal(%d,%d)", length, scale)).otherwise(F.col("datatype")))


def workbook_header(spark: SparkSession, folder: str) -> dict[str, str]:
    """The key/value rows of ``config.csv``; blank cells are empty text."""
    rows = spark.read.csv(f"{folder}/config.csv").collect()
    return {r[0].strip().lower(): (r[1] or "").strip() for r in rows if r[0]}


def workbook_sources(config: dict[str, str], hop: str) -> tuple[SourceSpec, SourceSpec]:
    """The two sides of a hop as the configuration sheet describes them: connection, format, file or table, delimiter, header flag,
    timestamp format. A file name wins over a table name, as a path is the more exact of the two."""
    if hop not in HOPS:
        raise ValueError(f"unknown hop: {hop!r}")

    def side(layer: str) -> SourceSpec:
        cell = lambda name: config.get(f"{layer}{name}", "")
        name = cell("filename")
        path = "/".join(x for x in (cell("filepath").rstrip("/"), name) if x) if name else ""
        table = ".".join(x for x in (cell("databaseschemaname"), cell("databasetablename")) if x) if not name else ""
        if not path and not table:
            raise ValueError(f"the configuration names neither a file nor a table for {layer!r}")
        return SourceSpec(
            connection=cell("connectiontype") or "local", format=cell("fileformat") or "table", path=path, table=table,
            alias=cell("aliasname") or layer, delimiter=cell("filedelimiter") or ",",
            header=cell("filehasheader").upper() == "Y", timestamp_format=cell("timestampformat"),
        )

    return side(_before(hop)), side(_after(hop))


def _before(hop: str) -> str:
    return "stage" if hop == STAGE_TO_TARGET else "source"


def _after(hop: str) -> str:
    return "stage" if hop == SOURCE_TO_STAGE else "target"


def load_mapping(spark: SparkSession, folder: str, hop: str) -> MappingSheets:
    """Read ``schema.csv`` and ``target_mapping.csv`` (or ``stage_mapping.csv``) from a folder, for one hop."""
    if hop not in HOPS:
        raise ValueError(f"unknown hop: {hop!r}")
    before, after = _before(hop), _after(hop)
    schema = sized(read_sheet(spark, f"{folder}/schema.csv"))
    sheet = read_sheet(spark, f"{folder}/{after}_mapping.csv")
    layer = lambda name: schema.where(F.lower("tabletype") == name)
    keys = layer(after).where(F.upper("primarykey") == "Y").select("columnname").collect()
    return MappingSheets(
        rows=mapping_rows(with_schemas(sheet, layer(after), layer(before))),
        source_schema=declared_ddl(schema, before), target_schema=declared_ddl(schema, after),
        keys=[r.columnname for r in keys],
    )
