"""Sinks: run history, run tables, samples."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import col
from ..operators.fingerprint import row_hash

# Columns of the run history and of the two run tables.
HISTORY = (
    "testcase_name string, test_result string, runtime string, testcase_type string, run_created_time string, "
    "protocol_start_time string, protocol_end_time string, protocol_total_run_time string, db_stored_time string"
)
RUN_SUMMARY = (
    "Product_Name string, Testing_Layer string, No_of_Test_Cases_Errored int, No_of_Test_Cases_Failed int, "
    "No_of_Test_Cases_Passed int, Protocol_File_Path string, Test_Environment string, Test_Protocol_End_Time string, "
    "Test_Protocol_Name string, Test_Protocol_Start_Time string, Test_Protocol_Version string, Testcase_Type string, "
    "Testcases_Executed string, Total_No_of_Test_Cases int, Total_Protocol_Run_Time string, "
    "Test_Protocol_Run_ID string, Test_Protocol_Run_Name string, Check_Name string"
)
RUN_DETAIL = (
    "Test_Protocol_Run_ID string, Test_Protocol_Run_Name string, Check_Name string, Testcase_Name string, "
    "No_of_Rows_in_Source bigint, No_of_Rows_in_Target bigint, Distinct_Rows_Matched bigint, "
    "Distinct_Rows_Mismatched bigint, No_of_Distinct_Rows_in_Source bigint, No_of_Distinct_Rows_in_Target bigint, "
    "No_of_Records bigint, Total_No_of_Checks int, No_of_Checks_Passed int, No_of_Checks_Failed int, "
    "Test_Result string, Reason string, Runtime string"
)


def _shaped(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a declared table in its order and types; missing ones are NULL."""
    have = {c.lower(): c for c in df.columns}
    fields = [f.strip().rsplit(" ", 1) for f in ddl.split(",")]
    return df.select(*[
        (col(have[n.lower()]) if n.lower() in have else F.lit(None)).cast(t).alias(n) for n, t in fields
    ])


def load_name(rows: DataFrame) -> str:
    """A name for what the rows hold: the number and the order-free sum of their hashes. The same rows have the same name."""
    hashed = F.conv(F.substring(row_hash(rows, nulls="mark"), 1, 15), 16, 10).cast("decimal(20,0)")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(hashed), F.lit(0))).first()
    return f"{n}-{int(total) % (1 << 60):015x}"


def append_history(rows: DataFrame, path: str, load: str | None = None) -> None:
    """Append verdicts to the history, partitioned by load and test type so that reports on one type read only theirs.

    Verdicts need a name, a result and a type; without a stored time they get the time of this call. A load that is appended again
    replaces itself, so an append can be retried; without a name a load is named by its rows.
    """
    have = {c.lower() for c in rows.columns}
    lost = [c for c in ("testcase_name", "test_result", "testcase_type") if c not in have]
    if lost:
        raise ValueError(f"verdicts without {lost}")
    load = load or load_name(rows)
    if "db_stored_time" not in have:
        rows = rows.withColumn("db_stored_time", F.lit(datetime.now(timezone.utc).isoformat()))
    replace_load(_shaped(rows, HISTORY).withColumn("load", F.lit(load)), path, "load", "testcase_type")


def replace_load(rows: DataFrame, path: str, *partitions: str) -> None:
    """Write rows so that they replace what their partitions held, and nothing else."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_run_table(rows: DataFrame, ddl: str, path: str, mode: str = "append") -> None:
    """Append rows to the run summary or run detail table."""
    _shaped(rows, ddl).write.mode(mode).parquet(path)


def read_table(spark: SparkSession, ddl: str, path: str, csv: bool = False) -> DataFrame:
    """A history or run table; ``csv`` loads an exported file with a header."""
    reader = spark.read.schema(ddl)
    if csv:
        return reader.option("header", True).csv(path)
    return reader.parquet(path).select(*[f.strip().rsplit(" ", 1)[0] for f in ddl.split(",")])


def export_samples(
    src: DataFrame, tgt: DataFrame, keys: Sequence[str], path: str, limit: int | None = None, fmt: str = "parquet"
) -> dict[str, str]:
    """Write the first rows of both sides in key order (100 unless told otherwise); returns the two paths."""
    paths = {}
    for side, df in (("source", src), ("target", tgt)):
        rest = [c for c in df.columns if c not in keys]
        first = df.orderBy(*[col(c) for c in [*keys, *rest]]).limit(100 if limit is None else int(limit))
        paths[side] = f"{path}/{side}"
        first.write.mode("overwrite").format(fmt).save(paths[side])
    return paths
