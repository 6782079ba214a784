"""Schemas as rows, and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..frames import passed
from .fingerprint import null_counts


def schema_rows(df: DataFrame, observed: bool = False) -> DataFrame:
    """(position, columnname, datatype, nullable) in lower case; reads no data.

    With ``observed`` the nullability is what the data shows: one aggregate adds the null count of each column.
    """
    rows = [(i, f.name.lower(), f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    declared = df.sparkSession.createDataFrame(
        rows, "position int, columnname string, datatype string, nullable boolean"
    )
    if not observed:
        return declared
    types = F.create_map(*[F.lit(x) for r in rows for x in (r[1], r[2])])
    name = F.lower("column")
    return null_counts(df).select(
        "position", name.alias("columnname"), types[name].alias("datatype"),
        (F.col("nulls") > 0).alias("nullable"), "nulls",
    )


def declared_schema(sheet: DataFrame, layer: str) -> DataFrame:
    """The columns a mapping sheet declares for a layer, the type written ``type(length,scale)`` when sized."""
    size = lambda c: F.regexp_replace(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), r"\..*$", "")
    sized = F.concat(F.col("datatype"), F.lit("("), size("length"), F.lit(","), size("scale"), F.lit(")"))
    return sheet.where(F.lower("tabletype") == layer.lower()).select(
        F.lower("columnname").alias("columnname"), F.lower(F.coalesce(sized, F.col("datatype"))).alias("datatype")
    )


def schema_compare(src_rows: DataFrame, tgt_rows: DataFrame, nullability: bool = False) -> DataFrame:
    """Full outer comparison of two schemas by column name.

    Status: ``match``, ``type mismatch``, ``only source``, ``only target``; with ``nullability`` also
    ``nullability mismatch`` where the types agree.
    """
    extra = ["nullable"] if nullability else []
    side = lambda df, p: df.select(
        F.lower("columnname").alias("columnname"), F.lower("datatype").alias(f"{p}_type"),
        *[F.col(c).alias(f"{p}_{c}") for c in extra], F.lit(True).alias(f"__{p}"),
    )
    joined = side(src_rows, "src").join(side(tgt_rows, "tgt"), "columnname", "full_outer")
    status = (
        F.when(F.col("__tgt").isNull(), "only source")
        .when(F.col("__src").isNull(), "only target")
        .when(F.col("src_type") != F.col("tgt_type"), "type mismatch")
    )
    if nullability:
        status = status.when(F.col("src_nullable") != F.col("tgt_nullable"), "nullability mismatch")
    return joined.withColumn("status", status.otherwise("match")).drop("__src", "__tgt")


def schema_verdict(compared: DataFrame) -> DataFrame:
    """Column counts per status; passes when nothing differs."""
    is_ = lambda s: F.col("status") == s
    differs = F.col("status") != "match"
    return compared.agg(
        F.count_if(~is_("only target")).alias("src_columns"), F.count_if(~is_("only source")).alias("tgt_columns"),
        F.count_if(is_("match")).alias("matched"), F.count_if(is_("only source")).alias("only_source"),
        F.count_if(is_("only target")).alias("only_target"), F.count_if(is_("type mismatch")).alias("type_mismatch"),
        F.count_if(differs).alias("__bad"),
    ).select(
        F.lit("schema").alias("test"), passed(F.col("__bad") == 0).alias("result"),
        F.when(F.col("__bad") == 0, "Schema matched").otherwise("Schema mismatched").alias("reason"),
        "src_columns", "tgt_columns", "matched", "only_source", "only_target", "type_mismatch",
    )


def combo_allowed(cases: DataFrame, allowed: DataFrame, columns: list[str]) -> DataFrame:
    """The cases whose combination of connection types and formats is on the allow list, ignoring case and blanks."""
    clean = lambda c: F.lower(F.trim(F.col(c)))
    listed = allowed.select(*[clean(c).alias(f"__{c}") for c in columns]).distinct()
    on = [clean(c) == F.col(f"__{c}") for c in columns]
    return cases.join(listed, on, "left_semi")
