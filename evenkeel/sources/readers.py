"""One reader for every connection type and format. Readers only build frames; none of them starts a job,
except where Spark itself samples a file to infer its schema."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.parsing import predicate
from ..operators.flatten import flatten
from ..operators.mapping import like_select
from ..operators.schema_compare import schema_rows


@dataclass(frozen=True)
class SourceSpec:
    """Where a side of a comparison comes from.

    ``options`` are passed to the reader as they are (credentials included); so is ``conf``, the access settings of an object
    store, which hold for this read alone and never reach the other side. ``query`` is SQL text or the path of a
    ``.sql`` file that names the data by ``alias``; databases run it themselves. ``header`` and ``timestamp_format`` are for
    delimited files; without a header the columns of ``schema`` are taken by position.
    """

    connection: str
    format: str
    path: str = ""
    table: str = ""
    alias: str = "source"
    query: str = ""
    exclude: Sequence[str] | str = ()
    where: str = ""
    schema: str | None = None
    delimiter: str = ","
    header: bool = True
    timestamp_format: str = ""
    multiline: bool = False
    flatten: bool = True
    partition_column: str = ""
    partition_bounds: tuple | None = None
    partitions: int = 0
    options: Mapping[str, str] = field(default_factory=dict)
    conf: Mapping[str, str] = field(default_factory=dict)


# Connection types and formats of the inventory.
FILE_STORES = ("adls", "aws-s3", "databricks", "local")
FILE_FORMATS = ("parquet", "delimited", "json", "avro", "delta")
JDBC_DRIVERS = {
    "oracle": "oracle.jdbc.driver.OracleDriver",
    "teradata": "com.teradata.jdbc.TeraDriver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "postgres": "org.postgresql.Driver",
}
WAREHOUSES = {"snowflake": "net.snowflake.spark.snowflake", "bigquery": "bigquery", "redshift": "redshift"}


def read_source(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """The rows of a source: its query, or all but the excluded columns (alphabetical) after its filter."""
    kind, fmt = spec.connection.lower().split()[0], spec.format.lower()
    if kind in FILE_STORES and fmt in FILE_FORMATS:
        df = _FILES[fmt](spark, spec)
        if spec.flatten and fmt in ("json", "avro"):
            df = flatten(df)
        return manual_query(spark, query_text(spec.query), **{spec.alias: df}) if spec.query else _like(df, spec)
    if fmt != "table" or (kind not in JDBC_DRIVERS and kind not in WAREHOUSES):
        raise ValueError(f"no reader for connection {spec.connection!r} with format {spec.format!r}")
    name, options = database_options(spec)
    df = spark.read.format(name).options(**options).load()
    return df if spec.query else _like(df, spec)


def _like(df: DataFrame, spec: SourceSpec) -> DataFrame:
    return like_select(df, spec.exclude, spec.where)


def _parquet(spark, spec):
    return _reader(spark, spec).parquet(spec.path)


def _delimited(spark, spec):
    reader = _reader(spark, spec).option("sep", spec.delimiter).option("header", spec.header)
    if spec.timestamp_format:
        reader = reader.option("timestampFormat", spec.timestamp_format).option("dateFormat", spec.timestamp_format)
    return reader.csv(spec.path)


def _json(spark, spec):
    return _reader(spark, spec).option("multiLine", spec.multiline).json(spec.path)


def _avro(spark, spec):
    try:
        return _reader(spark, spec).format("avro").load(spec.path)
    except Exception as error:
        if not _no_source(error):
            raise
        raise RuntimeError("reading Avro needs the spark-avro package on the session") from error


def _delta(spark, spec):
    """By path through the Delta package, by name through the catalog."""
    if spec.table:
        return spark.table(spec.table)
    try:
        return _reader(spark, spec).format("delta").load(spec.path)
    except Exception as error:
        if not _no_source(error):
            raise
        raise RuntimeError("reading a Delta path needs the delta package on the session") from error


def _no_source(error: Exception) -> bool:
    """Whether a package is missing; a missing path, a refused access or a bad schema is told as it is."""
    return re.search(r"DATA_SOURCE_NOT_FOUND|[Ff]ind (the )?data source", str(error)) is not None


def _reader(spark, spec):
    # Settings of a store are options of the read: Spark adds them to the Hadoop configuration of this read only.
    access = {name.removeprefix("spark.hadoop."): value for name, value in spec.conf.items()}
    reader = spark.read.options(**access).options(**spec.options)
    return reader.schema(spec.schema) if spec.schema else reader


_FILES = {"parquet": _parquet, "delimited": _delimited, "json": _json, "avro": _avro, "delta": _delta}


def query_text(query: str) -> str:
    """SQL text, or the lines of a ``.sql`` file; line breaks stay, so a ``--`` comment ends with its line."""
    text = query.strip()
    if text.lower().endswith(".sql"):
        text = "\n".join(line.strip() for line in _lines(text) if line.strip())
    return text.rstrip(";").strip()


def _lines(path: str) -> list[str]:
    """The lines of a file in any store that Spark reads."""
    spark = SparkSession.active()
    rows = spark.read.text(path, wholetext=True).collect()  # one small SQL file
    return rows[0].value.lstrip("\ufeff").splitlines() if rows else []


def manual_query(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """Run SQL that calls the given frames by name, without registering views under those names."""
    quoted = query_text(sql).replace("{", "{{").replace("}", "}}")
    parts = ", ".join(f"{name} AS (SELECT * FROM {{{name}}})" for name in frames)
    return spark.sql(f"WITH {parts} SELECT * FROM ({quoted}\n)", **frames)


def remote_query(spec: SourceSpec) -> str:
    """The query a database runs: the manual one, or the whole table with the filter, in the database's own SQL."""
    if spec.query:
        return query_text(spec.query)
    where = predicate(spec.where)
    return f"SELECT * FROM {spec.table}" + (f" WHERE {where}" if where else "")


def database_options(spec: SourceSpec) -> tuple[str, dict[str, str]]:
    """Reader name and options of a database source. Filters and queries run in the database.

    With a partition column and bounds a JDBC table is read by many tasks; without them JDBC reads in one task,
    which is only fit for small tables.
    """
    kind = spec.connection.lower().split()[0]
    if kind in WAREHOUSES:
        options = dict(spec.options)
        if kind == "snowflake":
            options.setdefault("autopushdown", "on")
            options["query"] = remote_query(spec)
        elif kind == "bigquery":
            if spec.query or predicate(spec.where):
                options.update(query=remote_query(spec), viewsEnabled="true")
            else:
                options["table"] = spec.table
        else:
            options["query"] = remote_query(spec)
        return WAREHOUSES[kind], options
    options = {"driver": JDBC_DRIVERS[kind], **spec.options}
    if kind == "oracle":
        options.setdefault("oracle.jdbc.timezoneAsRegion", "false")
    if spec.partition_column:
        lo, hi = spec.partition_bounds
        options.update(
            dbtable=f"({remote_query(spec)}) t", partitionColumn=spec.partition_column, lowerBound=str(lo),
            upperBound=str(hi), numPartitions=str(spec.partitions or 200),
        )
    elif kind in ("sqlserver", "postgres") and not spec.query and not predicate(spec.where):
        options["dbtable"] = spec.table
    else:
        options["query"] = remote_query(spec)
    return "jdbc", options


# Catalog queries that list the columns of a table; {table} is the name without its schema.
_CATALOG = {
    "oracle": "SELECT column_name AS columnname, data_type AS datatype FROM all_tab_columns WHERE upper(table_name) = upper('{table}')",
    "bigquery": "SELECT column_name AS columnname, data_type AS datatype FROM {schema}.INFORMATION_SCHEMA.COLUMNS WHERE lower(table_name) = lower('{table}')",
}
_INFORMATION_SCHEMA = (
    "SELECT column_name AS columnname, data_type AS datatype FROM information_schema.columns "
    "WHERE lower(table_name) = lower('{table}')"
)


def catalog_query(spec: SourceSpec) -> str:
    schema, _, table = spec.table.rpartition(".")
    return _CATALOG.get(spec.connection.lower().split()[0], _INFORMATION_SCHEMA).format(schema=schema, table=table)


def source_schema(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """(columnname, datatype, …) of a source: from its files' metadata, or from the database's catalog."""
    kind = spec.connection.lower().split()[0]
    if kind in FILE_STORES:
        return schema_rows(read_source(spark, spec))
    name, options = database_options(replace(spec, query=catalog_query(spec), partition_column=""))
    rows = spark.read.format(name).options(**options).load()
    return rows.select(*[F.lower(c).alias(c.lower()) for c in rows.columns])


__all__ = ["SourceSpec", "catalog_query", "database_options", "manual_query", "read_source", "remote_query", "source_schema"]
